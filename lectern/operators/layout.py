"""Entitlement by layout: rows lie in folders by tag set and quarantine, so a user's query lists only folders that it may read.

The distinct tag sets are a dictionary of numbered sets; a user's tags become the numbers of the sets they meet, and these a filter on the
partition column.  Rows have far fewer tag sets than rows; a table with more than MOST of them is refused, as its folders would be as many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.acl import PUBLIC

#: Distinct tag sets of a table, at most: each is a folder, and all are read by the driver.
MOST = 10_000


class ByTagSet:
    """A table at a path, its rows in folders by tag set and quarantine.  A null or empty tag set is one set, which no user meets."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def write(rows: DataFrame, path: str) -> ByTagSet:
        """Lays rows (acl_tags, quarantined, ...) out; quarantined is kept null for null, which no user sees."""
        where = path.rstrip("/")
        sets = F.array_sort(F.array_distinct(F.coalesce("acl_tags", F.array().cast("array<string>"))))
        told = rows.withColumn("tags__", sets)
        known = sorted((tuple(r[0]) for r in told.select("tags__").distinct().limit(MOST + 1).collect()), key=lambda t: [(x is not None, x) for x in t])
        if len(known) > MOST:
            raise ValueError(f"more than {MOST} tag sets")
        names = rows.sparkSession.createDataFrame([(i, list(t)) for i, t in enumerate(known)], "tag_set int, tags__ array<string>")
        names.withColumnRenamed("tags__", "tags").coalesce(1).write.parquet(f"{where}/sets")
        held = F.coalesce("quarantined", F.lit(True))
        laid = told.join(F.broadcast(names), "tags__").drop("tags__").withColumn("held", held)
        laid.repartition("tag_set", "held", F.rand(7)).write.partitionBy("tag_set", "held").parquet(f"{where}/rows")
        return ByTagSet(rows.sparkSession, where)

    def numbers(self, tags: list[str] | None) -> list[int]:
        """The sets that a user with tags meets.  None: a public user; []: none.  A tag with a control character names no set."""
        mine = list(PUBLIC) if tags is None else [t for t in tags if not any(ord(c) < 32 or ord(c) == 127 for c in t)]
        return sorted(r.tag_set for r in self.spark.read.parquet(f"{self.path}/sets").collect() if set(r.tags or ()) & set(mine))

    def visible(self, tags: list[str] | None = None) -> DataFrame:
        """The rows that a user may see; only their folders are listed in the plan."""
        rows = self.spark.read.parquet(f"{self.path}/rows")
        return rows.where(F.col("tag_set").isin(self.numbers(tags)) & ~F.col("held")).drop("tag_set", "held")
