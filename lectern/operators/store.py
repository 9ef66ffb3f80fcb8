"""The document store: dedup by checksum, vector upsert, and batches that are visible only once committed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def deduplicated(docs: DataFrame, key: str) -> DataFrame:
    """One row for each checksum: the smallest key, and the number of copies."""
    return docs.groupBy("checksum").agg(F.min(key).alias(key), F.count("*").alias("copies"))


def unseen(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """docs whose checksum isn't stored."""
    return docs.join(stored.select("checksum").distinct(), "checksum", "left_anti")


def missing(asked: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows of asked without a stored row."""
    return asked.join(stored.select(key), key, "left_anti")


def upserted_vectors(stored: DataFrame, new: DataFrame, key: str, vector: str = "embedding", check: bool = True) -> DataFrame:
    """stored with the vectors of new.  All new vectors must have one length, and every key a stored row."""
    if check:
        sizes = new.select(F.size(vector).alias("n")).distinct().limit(2).collect()
        if len(sizes) > 1:
            raise ValueError("vectors of several lengths")
        if lost := missing(new, stored, key).select(key).limit(5).collect():
            raise KeyError(f"no stored rows for {[r[0] for r in lost]}")
    fresh = new.select(key, F.col(vector).alias("new__"))
    return stored.join(fresh, key, "left").withColumn(vector, F.coalesce("new__", vector)).drop("new__")


def commit(tables: dict[str, DataFrame], path: str) -> str:
    """Writes tables as one batch: its folder is staged first and counts once its marker is written.  Returns the batch's id."""
    batch = uuid.uuid4().hex
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}/batch={batch}")
    spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(f"{path}/_committed")
    return batch


def committed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table's rows of committed batches."""
    done = spark.read.schema("batch string").parquet(f"{path}/_committed")
    return spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}").join(done, "batch", "left_semi").drop("batch")
