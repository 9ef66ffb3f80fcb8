"""The request log and its daily rollup, kept in one table log: a batch changes the rollup by the difference that it makes.

Partial states are counts and sums by day and mode.  Sums are decimals, so what is taken back leaves nothing behind, and the rollup
after any batches equals one made from the log's last rows.  Values are taken to twelve decimals; those that are no finite number count as none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators import observe
from lectern.operators.tablelog import Change, TableLog, Version, merged, place, together

REQUESTS, DAYS = "requests", "days"
MEANS = ("avg_latency_ms", "groundedness", "relevance")
COUNTS = ("requests", "refused", *(f"{m}_n" for m in MEANS))
SUMS = tuple(f"{m}_sum" for m in MEANS)
EXACT = "decimal(38,12)"


def _value(mean: str) -> Column:
    return (F.col("latency_ms") if mean == "avg_latency_ms" else observe.judged(mean)).try_cast(EXACT)


def states(log: DataFrame) -> DataFrame:
    """A row for each day and mode of log: how many requests, refusals and values there are, and the values' sums (0 without any)."""
    told = [F.count("*").alias("requests"), F.count_if("refused").alias("refused"), *(F.count(_value(m)).alias(f"{m}_n") for m in MEANS)]
    return log.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "mode").agg(*told, *(_exact(_value(m)).alias(f"{m}_sum") for m in MEANS))


def _exact(value: Column) -> Column:
    return F.coalesce(F.sum(value).cast(EXACT), F.lit(0).cast(EXACT))


def added(parts: DataFrame) -> DataFrame:
    """The sum of states; a day and mode without requests is gone."""
    return parts.groupBy("day", "mode").agg(*(F.sum(c).alias(c) for c in COUNTS), *(_exact(F.col(c)).alias(c) for c in SUMS))


def difference(new: DataFrame, old: DataFrame) -> DataFrame:
    """The states by which new rows differ from old ones, where they do."""
    back = states(old).select("day", "mode", *((-F.col(c)).alias(c) for c in (*COUNTS, *SUMS)))
    rows = added(states(new).unionByName(back))
    return rows.where(" or ".join(f"{c} <> 0" for c in (*COUNTS, *SUMS)))


def apply(log: TableLog, batch: DataFrame, key: str = "request_id", sequence: str = "id", delete: str | None = None, buckets: int = 16) -> Version:
    """Upserts a batch of requests (key, sequence, ts, mode, refused, latency_ms, judge, ...) and the rollup, as one version.

    Of each key the row of the highest sequence stays, so rows that come late and rows that come twice change nothing; delete names a
    boolean column that removes the key.  Only buckets that the batch falls into are read, of requests and of days.
    """

    def build(base: Version) -> Change:
        change = merged(log, REQUESTS, base, batch, key, sequence, buckets, delete)
        if not change.add:
            return change
        new = log.read(REQUESTS, Version(parts=change.add, schemas=change.schemas))
        before = [p for p in base.parts.get(REQUESTS, []) if p.path in change.drop]
        old = log.read(REQUESTS, Version(parts={REQUESTS: before}, schemas=base.schemas | change.schemas))
        moved = difference(new, old).persist()
        try:
            hit = {r[0] for r in moved.select(place("day", buckets)).distinct().collect()}
            if not hit:
                return change
            rows = log.read(DAYS, base, hit).unionByName(moved) if DAYS in base.schemas else moved
            days = log.stage(DAYS, added(rows).where("requests <> 0"), place("day", buckets), "day")
            days.drop = {p.path for p in base.parts.get(DAYS, []) if p.bucket in hit}
            return together(change, days)
        finally:
            moved.unpersist()

    return log.commit(build)


def daily(log: TableLog, version: Version | None = None, mode: str | None = None) -> DataFrame:
    """What `observe.daily` gives for the log's rows of a version (the last), from the states alone; of one mode if named."""
    version = version or log.version()
    rows = log.read(DAYS, version)
    if mode is not None:
        rows = rows.where(F.col("mode") == mode)
    means = [F.round(F.sum(f"{m}_sum").cast("double") / F.nullif(F.sum(f"{m}_n"), F.lit(0)), observe.DIGITS).alias(m) for m in MEANS]
    return rows.groupBy("day").agg(F.sum("requests").alias("requests"), F.sum("refused").alias("refused"), *means)
