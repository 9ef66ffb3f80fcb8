"""Evaluation of answers: hits, ranks, summary, gate, golden-set checks, judge scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.folders import checkpoint
from lectern.functions.text import squashed

DIGITS = 9
#: How far each metric may fall against the baseline.
THRESHOLDS = {"hit_at_3": -0.05, "groundedness": -0.05, "refusal_correct": -0.05, "must_not_include_pass": 0.0}


def title_matches(expected: Column, title: Column) -> Column:
    """Whether any expected substring occurs in the title, case and white space aside."""
    return F.exists(expected, lambda e: (squashed(F.lower(e)) != "") & F.contains(squashed(F.lower(title)), squashed(F.lower(e))))


def scored(golden: DataFrame, hits: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """golden (query_id, expected, ...) with first rank, hit_at_k and reciprocal_rank over hits (query_id, doc_id, rank).

    Without expected documents these are null; with some but no hit, false and 0.
    """
    met = golden.select("query_id", F.explode("expected").alias("doc_id")).join(hits, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    rows = golden.join(met, "query_id", "left")
    some = F.size("expected") > 0
    rows = rows.withColumns({f"hit_at_{k}": F.when(some, F.coalesce(F.col("first") <= k, F.lit(False))) for k in ks})
    return rows.withColumn("reciprocal_rank", F.when(some, F.coalesce(1.0 / F.col("first"), F.lit(0.0))))


def _rate(name: str) -> Column:
    return F.round(F.avg(F.col(name).cast("int")), DIGITS).alias(name)


def _mean(name: str) -> Column:
    return F.round(F.avg(name), DIGITS)


def exact_percentiles(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """group and a column for each share (name: share from 0 to 1): its exact percentile of value, between two values by their distance.

    Distinct values with their counts are dealt out in ranges of (group, value); sums of ranges, then of values within a range, give every value
    its places, and only the values at the asked places are kept.  So a huge group is the work of many tasks, and no task holds a group.
    Nulls don't count; a group without a value has nulls.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    # Which range a value is in must not change between uses.
    dealt = checkpoint(counts.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("g", "part").agg(F.sum("n").alias("all")).withColumns({"offset": F.coalesce(F.sum("all").over(before), F.lit(0)), "total": F.sum("all").over(Window.partitionBy("g"))})
    told = dealt.alias("d").join(sums.alias("s"), (F.col("d.g").eqNullSafe(F.col("s.g"))) & (F.col("d.part") == F.col("s.part"))).select("d.g", "d.part", "v", "n", "offset", "total")
    inside = Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = told.withColumn("end", F.col("offset") + F.sum("n").over(inside))

    def at(place: Column) -> Column:
        return F.max(F.when((place < F.col("end")) & (place >= F.col("end") - F.col("n")), F.col("v")))

    def percentile(share: float) -> Column:
        place = F.lit(share) * (F.max("total") - 1)
        low, high = (at(f(F.lit(share) * (F.col("total") - 1))) for f in (F.floor, F.ceil))
        return F.when(F.floor(place) == F.ceil(place), low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    found = placed.groupBy("g").agg(*(percentile(share).alias(name) for name, share in shares.items()))
    every = rows.select(F.col(group).alias("key")).distinct()
    return every.join(found, F.col("key").eqNullSafe(F.col("g")), "left").select(F.col("key").alias(group), *shares)


def summary(items: DataFrame) -> DataFrame:
    """One row over all items: counts, rates over the items that a check applies to, latency and tokens."""
    passed = F.coalesce("must_include_pass", F.lit(True)) & F.coalesce("must_not_include_pass", F.lit(True)) & F.col("error").isNull()
    return items.agg(
        F.count("*").alias("items"), F.count("error").alias("errors"), F.count("hit_at_3").alias("retrieval_items"), *map(_rate, ("hit_at_1", "hit_at_3", "hit_at_5")), _mean("reciprocal_rank").alias("mrr"), _rate("refusal_correct"),
        F.count_if("expect_refusal").alias("refusals_expected"), F.count_if("refused").alias("refusals_actual"), _rate("must_include_pass"), _rate("must_not_include_pass"), F.round(F.avg(passed.cast("int")), DIGITS).alias("checks_pass"), F.count("groundedness").alias("judged"),
        *(_mean(m).alias(m) for m in ("groundedness", "relevance", "correctness")), F.percentile("latency_ms", 0.5).alias("latency_p50_ms"), F.round(F.percentile("latency_ms", 0.95), DIGITS).alias("latency_p95_ms"), _mean("latency_ms").alias("latency_mean_ms"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), F.round((F.sum("prompt_tokens") + F.sum("output_tokens")) / F.count("*"), DIGITS).alias("tokens_per_item"),
    )


def compared(current: DataFrame, baseline: dict[str, float | None], thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """metric, baseline, current, delta, threshold, status (passed, regressed, skipped) of a one-row summary."""
    names = list(thresholds)
    now = current.select(F.explode(F.create_map(*[x for m in names for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "current"))
    base = current.sparkSession.createDataFrame([(m, baseline.get(m), thresholds[m]) for m in names], "metric string, baseline double, threshold double")
    delta = F.col("current") - F.col("baseline")
    status = F.when(delta.isNull(), "skipped").when(delta < F.col("threshold") - 1e-9, "regressed").otherwise("passed")
    return base.join(now, "metric", "left").select("metric", "baseline", "current", F.round(delta, DIGITS).alias("delta"), "threshold", status.alias("status"))


def judge_score(raw: Column) -> Column:
    """A judge's score as 0 to 1: percent signs, scales of 100 and 10 are folded back; anything else is null."""
    clean = F.trim(raw)
    number = F.when(F.endswith(clean, F.lit("%")), F.regexp_replace(clean, "%+$", "").try_cast("double") / 100).otherwise(clean.try_cast("double"))
    folded = F.when(number > 10, number / 100).when((number > 1) & (number == F.floor(number)), number / 10).otherwise(number)
    return F.when(number.isNotNull() & ~F.isnan(number), F.greatest(F.lit(0.0), F.least(F.lit(1.0), folded)))


def merged_judges(rows: DataFrame, item: str, judge: str, scores: list[str]) -> DataFrame:
    """One row for each item: mean of the scores, reason of the first judge that gives one, all tokens."""
    first = F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col(judge)))
    return rows.groupBy(item).agg(*(_mean(s).alias(s) for s in scores), first.alias("reason"), F.sum("tokens").alias("tokens"))


def sampled(chunks: DataFrame, n: int, seed: int = 7, key: str = "doc_id", column: str = "text", least: int = 40) -> DataFrame:
    """n chunks for drafts of golden items, the same for a seed: out of quarantine, with more than `least` characters."""
    rows = chunks.where(~F.col("quarantined") & (F.length(F.trim(column)) > least))
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def problems(golden: DataFrame, order: str) -> DataFrame:
    """golden with problems: what keeps an item from being run."""
    again = F.row_number().over(Window.partitionBy("id").orderBy(order)) > 1
    overlap = F.size(F.array_intersect(F.transform("must_include", F.lower), F.transform("must_not_include", F.lower))) > 0
    told = F.array(
        F.when(F.col("id") == "", "id is missing").when(F.col("again"), "id is used more than once"),
        F.when(F.col("question") == "", "question is empty"),
        F.when(F.size("user_tags") == 0, "user_tags is empty"),
        F.when(F.col("expected_answer") == "", "expected_answer is empty"),
        F.when(F.col("expect_refusal") & (F.size("must_include") > 0), "a refusal item has must_include"),
        F.when(~F.col("expect_refusal") & (F.size("expected_sources") == 0), "expected_sources is empty"),
        F.when(overlap, "must_include and must_not_include overlap"),
    )
    return golden.withColumn("again", again).withColumn("problems", F.filter(told, lambda p: p.isNotNull())).drop("again")
