"""The request log: upsert, totals, daily rollup, gap-filled trend, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 9


def upserted(log: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """One row for each key: of every field the latest value that isn't null."""
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields]
    return log.groupBy(key).agg(*latest, F.count("*").alias("writes"))


def attached(log: DataFrame, scores: DataFrame, key: str, column: str) -> DataFrame:
    """log with column taken from scores (key, column) where they have it."""
    new = scores.select(key, F.col(column).alias("new__"))
    return log.join(new, key, "left").withColumn(column, F.coalesce("new__", column)).drop("new__")


def totals(log: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return log.agg(
        F.count("*").alias("requests"), F.coalesce(F.count_if("refused"), zero).alias("refused"), F.coalesce(F.round(F.avg("latency_ms"), DIGITS), F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce(F.sum("prompt_tokens"), zero).alias("prompt_tokens"), F.coalesce(F.sum("output_tokens"), zero).alias("output_tokens"),
    )


def judged(name: str) -> Column:
    return F.get_json_object("judge", f"$.{name}").try_cast("double")


def daily(log: DataFrame) -> DataFrame:
    """A row for each day: requests, refused, mean latency and mean judge scores where there are any."""
    return log.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("requests"), F.count_if("refused").alias("refused"), F.round(F.avg("latency_ms"), DIGITS).alias("avg_latency_ms"), F.round(F.avg(judged("groundedness")), DIGITS).alias("groundedness"), F.round(F.avg(judged("relevance")), DIGITS).alias("relevance")
    )


def trend(log: DataFrame, last_day: str, days: int = 14) -> DataFrame:
    """A row for each of the days that end with last_day: requests (0 without), refusal rate in percent, latency and judge scores (null without)."""
    spine = log.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(last_day).cast("date"), days - 1), F.lit(last_day).cast("date"))).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("day"))
    rows = spine.join(daily(log), "day", "left")
    return rows.select("day", F.coalesce("requests", F.lit(0)).alias("requests"), F.round(100.0 * F.col("refused") / F.col("requests"), 1).alias("refusal_rate"), F.round("avg_latency_ms", 0).alias("latency"), F.round("groundedness", 3).alias("groundedness"), F.round("relevance", 3).alias("relevance"))


def sparkline(rows: DataFrame, order: str, value: str, width: int = 120, height: int = 32, pad: int = 2) -> DataFrame:
    """rows with x and y of a line through the values that are there; a flat line is at mid-height."""
    every, here = Window.partitionBy(), Window.orderBy(order)
    low, high, n = F.min(value).over(every), F.max(value).over(every), F.count("*").over(every)
    x = F.when(n > 1, pad + (width - 2 * pad) * (F.row_number().over(here) - 1) / (n - 1)).otherwise(pad + (width - 2 * pad) / 2)
    y = F.when(high > low, pad + (height - 2 * pad) * (1 - (F.col(value) - low) / (high - low))).otherwise(pad + (height - 2 * pad) / 2)
    return rows.withColumn("x", F.round(x, 1)).withColumn("y", F.when(F.col(value).isNotNull(), F.round(y, 1)))


def recent(log: DataFrame, n: int, order: str = "id", mode: str | None = None) -> DataFrame:
    """The newest n rows, of one mode if named, oldest first."""
    rows = log.where(F.col("mode") == mode) if mode else log
    return rows.orderBy(F.col(order).desc()).limit(n).orderBy(order)
