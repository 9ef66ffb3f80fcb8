"""Several tables that change together: Parquet parts and a log of versions, each written whole or not at all.

A version is one small JSON file that names every table's parts.  A writer stages its parts, which nobody sees, and then claims the next
number; the claim fails if another writer has it, and the change is built again on what that writer left.  Readers keep the version they
opened.  Parts that no kept version names, left by a crash or by replaced data, go with `vacuum`.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Lost(RuntimeError):
    """Another writer claimed the version."""


@dataclass(frozen=True)
class Part:
    """A folder of Parquet files; the bucket it holds, if its table has buckets."""

    path: str
    bucket: int | None = None


@dataclass
class Version:
    number: int = 0
    parts: dict[str, list[Part]] = field(default_factory=dict)
    schemas: dict[str, dict] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)


@dataclass
class Change:
    """What a writer wants: parts to add and to drop, tables' schemas, and facts (numbers or texts kept with the version)."""

    add: dict[str, list[Part]] = field(default_factory=dict)
    drop: set[str] = field(default_factory=set)
    schemas: dict[str, dict] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)


class TableLog:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        p = self._hadoop(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._hadoop(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def number(self) -> int:
        """The last version's number, 0 before the first."""
        return max((int(n[:-5]) for n in self._names("_log") if n.endswith(".json")), default=0)

    def version(self, number: int | None = None) -> Version:
        number = self.number() if number is None else number
        if not number:
            return Version()
        told = json.loads(self._read(f"{self.path}/_log/{number:012d}.json"))
        return Version(number, {t: [Part(*p) for p in parts] for t, parts in told["parts"].items()}, told["schemas"], told["facts"])

    def read(self, table: str, version: Version, buckets: set[int] | None = None) -> DataFrame:
        """A table's rows in a version, of some buckets alone if they are given."""
        schema = T.StructType.fromJson(version.schemas[table])
        paths = [f"{self.path}/{p.path}" for p in version.parts.get(table, []) if buckets is None or p.bucket in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def stage(self, table: str, rows: DataFrame, bucket: Column | None = None, order: str | None = None, spread: str | None = None, ways: int = 8) -> Change:
        """Writes rows as new parts of a table, one for each bucket, sorted by `order`; they count once the change is committed.

        A bucket is one task's work, or that of `ways` tasks among which its rows are dealt by the column spread.
        """
        folder = f"{table}/{uuid.uuid4().hex}"
        schema = {table: json.loads(rows.schema.json())}
        if bucket is None:
            rows.write.parquet(f"{self.path}/{folder}")
            return Change({table: [Part(folder)]}, schemas=schema)
        rows = rows.withColumn("bucket__", bucket).repartition("bucket__", *([place(spread, ways)] if spread else [])).sortWithinPartitions("bucket__", *([order] if order else []))
        rows.write.partitionBy("bucket__").parquet(f"{self.path}/{folder}")
        found = [n for n in self._names(folder) if n.startswith("bucket__=")]
        return Change({table: [Part(f"{folder}/{n}", int(n[9:])) for n in found]}, schemas=schema)

    def _claim(self, number: int, body: str) -> None:
        """Puts a version's file where none is, whole, or raises Lost."""
        log = self._hadoop(f"{self.path}/_log")
        self._fs.mkdirs(log)
        target, made = f"{self.path}/_log/{number:012d}.json", self._hadoop(f"{self.path}/_log/.{uuid.uuid4().hex}")
        stream = self._fs.create(made, True)
        stream.write(bytearray(body.encode()))
        stream.close()
        try:
            if self._fs.getScheme() == "file":
                # A local rename replaces its target; a hard link doesn't.
                os.link(self._fs.makeQualified(made).toUri().getPath(), self._fs.makeQualified(self._hadoop(target)).toUri().getPath())
                return
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(log.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(made, self._hadoop(target), none)
        except FileExistsError as e:
            raise Lost(number) from e
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                raise Lost(number) from e
            raise
        finally:
            self._fs.delete(made, False)

    def put(self, base: Version, change: Change) -> Version:
        """The version after base with the change; raises Lost if another has that number."""
        parts = {t: [p for p in ps if p.path not in change.drop] for t, ps in base.parts.items()}
        for table, more in change.add.items():
            parts[table] = parts.get(table, []) + more
        made = Version(base.number + 1, parts, base.schemas | change.schemas, base.facts | change.facts)
        body = {"parts": {t: [[p.path, p.bucket] for p in ps] for t, ps in parts.items()}, "schemas": made.schemas, "facts": made.facts}
        self._claim(made.number, json.dumps(body))
        return made

    def commit(self, build: Callable[[Version], Change], tries: int = 20) -> Version:
        """Builds a change on the last version and puts it, again on a newer version whenever another writer was first."""
        for k in range(tries):
            base = self.version()
            try:
                return self.put(base, build(base))
            except Lost:
                time.sleep(min(0.05 * 2**k, 2))
        raise Lost(f"no version claimed in {tries} tries")

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes the parts that none of the last `keep` versions names, and older versions.  No writer may be at work."""
        last = self.number()
        kept = [n for n in range(max(1, last - keep + 1), last + 1)]
        named = {p.path for n in kept for ps in self.version(n).parts.values() for p in ps}
        gone = []
        for table in (t for t in self._names("") if t != "_log"):
            for folder in self._names(table):
                path = f"{table}/{folder}"
                inner = [f"{path}/{n}" for n in self._names(path) if n.startswith("bucket__=")]
                unused = [p for p in inner if p not in named] if any(p in named for p in inner) else [path] * (path not in named)
                for p in unused:
                    self._fs.delete(self._hadoop(f"{self.path}/{p}"), True)
                    gone.append(p)
        for name in self._names("_log"):
            if not name.endswith(".json") or int(name[:-5]) not in kept:
                self._fs.delete(self._hadoop(f"{self.path}/_log/{name}"), False)
        return gone


def together(*changes: Change) -> Change:
    """One change of several."""
    every = Change()
    for c in changes:
        for table, parts in c.add.items():
            every.add[table] = every.add.get(table, []) + parts
        every.drop |= c.drop
        every.schemas |= c.schemas
        every.facts |= c.facts
    return every


def place(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def merged(log: TableLog, table: str, base: Version, rows: DataFrame, key: str, sequence: str, buckets: int = 16, delete: str | None = None) -> Change:
    """The change that upserts rows by key: of each key the row of the highest sequence stays, of equal ones the new one.

    Only buckets that rows fall into are read and written again; parts of all others keep their files.  delete names a boolean column of
    rows, not stored, that removes the key: a row of the key that comes later counts again.  Null keys are one key.
    """
    rows = rows.withColumn("bucket__", place(key, buckets)).persist()
    try:
        hit = {r[0] for r in rows.select("bucket__").distinct().collect()}
        if not hit:
            return Change()
        fresh = rows.drop("bucket__").withColumn("gone__", F.coalesce(F.col(delete), F.lit(False)) if delete else F.lit(False))
        if delete:
            fresh = fresh.drop(delete)
        fresh = fresh.withColumn("new__", F.lit(1))
        both = fresh
        if table in base.schemas:
            both = log.read(table, base, hit).withColumns({"gone__": F.lit(False), "new__": F.lit(0)}).unionByName(fresh, allowMissingColumns=True)
        names = [c for c in both.columns if c not in ("gone__", "new__")]
        best = both.groupBy(F.col(key).alias("key__")).agg(F.max_by(F.struct(*names, "gone__"), F.struct(F.col(sequence), F.col("new__"))).alias("row"))
        kept = best.where("not row.gone__").select(*(F.col("row")[n].alias(n) for n in names))
        change = log.stage(table, kept, place(key, buckets), key)
        change.drop = {p.path for p in base.parts.get(table, []) if p.bucket in hit}
        return change
    finally:
        rows.unpersist()
