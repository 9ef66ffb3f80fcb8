"""A hash-chained audit ledger: rows (seq, kind, request_id, payload, prev_hash, hash).

A row's hash covers the hash before it and its own fields, as a JSON array.  Appending is serial by nature; verifying looks at each row
and its predecessor only and is parallel.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lectern.functions.folders import shared_dir
from lectern.functions.shipping import map_arrow

GENESIS = "0" * 64
#: Rows that one task sorts and chains, or meets with their predecessors, about.
SEGMENT = 250_000
SCHEMA = "seq long, kind string, request_id string, payload string, prev_hash string, hash string"


def canonical(payload: dict) -> str:
    """Sorted keys, no spaces, text as it is; NaN is refused."""
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


_array = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False).encode


def row_hash(prev: str, kind: str, request_id: str | None, payload: str) -> str:
    return hashlib.sha256(_array([prev, kind, request_id, payload]).encode()).hexdigest()


def hash_column(prev: Column, kind: Column, request_id: Column, payload: Column) -> Column:
    return F.sha2(F.to_json(F.array(prev, kind, request_id, payload)), 256)


def append(spark: SparkSession, entries: list[tuple[str, str | None, dict | str]], head: tuple[int, str] = (0, GENESIS)) -> DataFrame:
    """Ledger rows for entries (kind, request_id, payload) after head (seq, hash).  One writer appends at a time."""
    seq, prev, rows = *head, []
    for kind, request_id, payload in entries:
        if not isinstance(kind, str) or not kind:
            raise ValueError("a ledger row needs a kind")
        told = payload if isinstance(payload, str) else canonical(payload)
        found = row_hash(prev, kind, request_id, told)
        seq += 1
        rows.append((seq, kind, request_id, told, prev, found))
        prev = found
    return spark.createDataFrame(rows, SCHEMA)


def _chain(rows: DataFrame, head: tuple[int | None, str]) -> DataFrame:
    """The rows of one partition, in their order, chained after head (seq, hash); without a seq they are numbered from the first one's on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, prev = head
        for b in batches:
            out: list[tuple] = []
            for at, kind, request_id, payload in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if not kind:
                    raise ValueError("a ledger row needs a kind")
                seq = at if seq is None else seq + 1
                found = row_hash(prev, kind, request_id, payload)
                out.append((seq, kind, request_id, payload, prev, found))
                prev = found
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k else pa.int64()) for k, c in enumerate(columns)], ["seq", "kind", "request_id", "payload", "prev_hash", "hash"])

    return map_arrow(rows, run, SCHEMA)


def chained(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """rows (seq, kind, request_id, payload) as a ledger, numbered from the first seq on.

    Every hash needs the one before it, so time is that of one writer.  Rows are dealt out in ranges of about `segment` rows; one after the other
    each is sorted and chained by a task of its own, which needs only the last row before it, and kept in the shared folder.
    """
    columns = ["seq", "kind", "request_id", "payload"]
    spark, rows = rows.sparkSession, rows.select(*columns)
    n = rows.count()
    if n <= segment:
        return _chain(rows.repartition(1).sortWithinPartitions(*columns), (None, GENESIS))
    top = f"{shared_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    dealt = rows.repartitionByRange(-(-n // segment), *columns).withColumn("part", F.spark_partition_id())
    dealt.write.partitionBy("part").parquet(f"{top}/dealt")
    schema, head, made = rows.schema, (None, GENESIS), []
    for part in sorted(r[0] for r in spark.read.parquet(f"{top}/dealt").select("part").distinct().collect()):
        told = Observation()
        one = spark.read.schema(schema).parquet(f"{top}/dealt/part={part}").coalesce(1).sortWithinPartitions(*columns)
        made.append(f"{top}/chained/{part}")
        _chain(one, head).observe(told, F.max(F.struct("seq", "hash")).alias("last")).write.parquet(made[-1])
        head = tuple(told.get["last"])
    return spark.read.schema(SCHEMA).parquet(*made)


def _fine(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("fine__", hash_column(F.col("prev_hash"), F.col("kind"), F.col("request_id"), F.col("payload")) == F.col("hash"))


def _met(rows: DataFrame, parts: int) -> DataFrame:
    """rows (seq, prev_hash, hash, fine__, ...) with problem, dealt out by seq in parts."""
    dealt = rows.repartition(parts, "seq")
    same = dealt.groupBy("seq").agg(F.min("hash").alias("least"), F.count("*").alias("own"))
    before = same.select((F.col("seq") + 1).alias("seq"), F.col("least").alias("before")).repartition(parts, "seq")
    met = dealt.join(same.drop("least"), "seq").join(before, "seq", "left")
    expected = F.when(F.col("seq") == 1, GENESIS).otherwise(F.col("before"))
    problem = F.when((F.col("own") > 1) | (F.col("seq") < 1), "order").when(expected.isNull() | (F.col("prev_hash") != expected), "prev").when(~F.col("fine__"), "hash")
    return met.withColumn("problem", problem)


def _parts(ledger: DataFrame) -> int:
    return max(int(ledger.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-ledger.count() // SEGMENT))


def checked(ledger: DataFrame) -> DataFrame:
    """ledger with problem: null, `order` (a seq that isn't one of 1, 2, 3, ... or repeats), `prev` or `hash`.

    Each row meets its predecessor by an equi-join on seq, so verification is as parallel as the table.
    """
    return _met(_fine(ledger), _parts(ledger)).select(*ledger.columns, "problem")


def verify(ledger: DataFrame) -> DataFrame:
    """One row: ok, checked (rows up to the first bad one, it included), first_bad_seq, reason.

    A row's own hash is looked at where it lies; only seq and hashes are shuffled.
    """
    rows = _met(_fine(ledger).select("seq", "prev_hash", "hash", "fine__"), _parts(ledger))
    bad = rows.agg(F.min(F.when(F.col("problem").isNotNull(), F.col("seq"))).alias("first_bad_seq"), F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("seq"))).alias("reason"))
    until = F.count_if(F.col("first_bad_seq").isNull() | (F.col("seq") <= F.col("first_bad_seq")))
    seqs = ledger.select("seq").where("seq is not null").crossJoin(F.broadcast(bad))
    return bad.crossJoin(F.broadcast(seqs.agg(until.alias("checked")))).select(F.col("first_bad_seq").isNull().alias("ok"), "checked", "first_bad_seq", "reason")


def head(ledger: DataFrame) -> DataFrame:
    """seq and hash of the last row."""
    return ledger.agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))


def export(ledger: DataFrame, path: str) -> None:
    """JSON lines in order of seq, in one file."""
    rows = ledger.orderBy("seq").select(F.to_json(F.struct("seq", "kind", "request_id", "payload", "prev_hash", "hash"), {"ignoreNullFields": "false"}).alias("value"))
    rows.coalesce(1).write.text(path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """The ledger of an export with `line`, its number in its file, and `unreadable`, the text of a line that isn't a row (else null)."""
    fields = "seq long, kind string, request_id string, payload string, prev_hash string, hash string"
    files = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", "^\\x{FEFF}", ""), "\r?\n").alias("lines"))
    lines = files.select(F.posexplode("lines").alias("at", "text")).where(F.trim("text") != "")
    parsed = lines.withColumn("r", F.from_json("text", fields))
    return parsed.select("r.*", (F.col("at") + 1).alias("line"), F.when(F.col("r.hash").isNull(), F.col("text")).alias("unreadable"))


def verdict(spark: SparkSession, path: str) -> tuple[int, str]:
    """Exit code (0 sound, 1 broken, 2 unreadable) and a sentence for an exported ledger."""
    rows = read_export(spark, path)
    bad = rows.where("unreadable is not null").agg(F.min("line")).first()[0]
    if bad is not None:
        return 2, f"line {bad}: unreadable"
    found = verify(rows.drop("line", "unreadable")).first()
    return (0, f"{found.checked} rows are sound") if found.ok else (1, f"row {found.first_bad_seq}: {found.reason}")
