"""Read-only SQL over allowed tables: one SELECT, checked before and after parsing, with caps on rows, time and size.

The text is checked for its form; Spark's parser then gives the plan, whose relations and functions must be on allowlists.  Functions that
make large values out of small ones (repeat, space, lpad, sequence, array_repeat, ...) aren't.  The query runs over temporary views of the allowed
tables in a session of its own.

Before it runs, its plan is priced: bytes of the files that it reads, and pairs of rows that its joins without an equality compare.  What costs more
than its `Budget` is refused.  Joins with an equality count as the larger side; a key that repeats on both sides makes more, which the time bounds.
"""

from __future__ import annotations

import json
import math
import re
import threading
from dataclasses import dataclass

from pyspark.errors import SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS, SECONDS, RESULT_CHARS, VALUE_CHARS = 50, 60, 2_000_000, 1_000_000
#: Functions that a query may call: they read rows alone, and what they make isn't larger than what they are given, or not by much.
ALLOWED = frozenset("""
abs acos asin atan atan2 avg bigint boolean bround cast ceil ceiling char_length character_length chr coalesce concat concat_ws contains cos cot count count_if cume_dist
current_date date date_add date_diff date_format date_sub date_trunc datediff day dayofmonth dayofweek dayofyear decimal degrees dense_rank div double endswith every exp
extract first first_value float floor format_number format_string greatest grouping grouping_id hour if ifnull initcap instr int isnan isnotnull isnull json_array_length
get_json_object lag last last_day last_value lcase lead least left len length ln locate log log10 log2 lower ltrim make_date max max_by mean median min min_by minute mod mode month
months_between nanvl negative now ntile nth_value nullif nvl nvl2 percent_rank percentile percentile_approx pmod position positive pow power quarter radians rank regexp
regexp_extract regexp_like regexp_replace replace reverse right rint rlike round row_number rtrim second sign signum sin smallint some split_part sqrt startswith std
stddev stddev_pop stddev_samp string substr substring substring_index sum tan timestamp tinyint to_date to_timestamp translate trim trunc try_add try_cast try_divide
try_multiply try_subtract ucase unix_timestamp upper var_pop var_samp variance weekday weekofyear when year
any between bool_and bool_or corr covar_pop covar_samp
""".split())
_COMMENT = re.compile(r"/\*.*?\*/|--[^\n]*", re.S)


class Refused(ValueError):
    """A query that isn't run."""


@dataclass(frozen=True)
class Budget:
    """What a query may cost: bytes of files (as they are stored, all columns) and compared pairs."""

    read_bytes: int = 1 << 44
    pairs: int = 10**9


@dataclass
class Cost:
    """What a query costs, at most: bytes of the files it reads, pairs that joins without an equality compare, and rows of the result if there is such a join."""

    read_bytes: int = 0
    pairs: float = 0
    rows: float = 0


def problem(sql: str, tables: list[str] | None, spark: SparkSession | None = None) -> str | None:
    """Why a query is refused, or None.  tables None: any."""
    text = _COMMENT.sub(" ", sql).strip()
    if not re.match(r"(?i)select\b", text):
        return "only SELECT statements are allowed"
    if ";" in text:
        return "semicolons are not allowed; send one statement"
    if spark is None:
        return None
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:  # noqa: BLE001
        return f"the query can't be parsed: {str(e).splitlines()[0][:200]}"
    known = {t.lower() for t in tables} if tables is not None else None
    stack = [plan]
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name == "UnresolvedRelation":
            table = node.tableName().replace("`", "")
            if known is not None and table.lower() not in known:
                return f"table '{table}' is outside the allowlist"
        elif name == "UnresolvedTableValuedFunction" and known is not None:
            return "table functions are not allowed"
        for group in (node.children(), node.innerChildren()) if name != "UnresolvedWith" else (node.children(),):
            stack += [group.apply(i) for i in range(group.size())]
        found = node.expressions()
        inner = [found.apply(i) for i in range(found.size())]
        while inner:
            e = inner.pop()
            kind = e.getClass().getSimpleName()
            if kind == "LambdaFunction":
                return "lambda functions are not allowed"
            if kind == "UnresolvedFunction":
                called = e.nameParts().mkString(".").lower()
                if called not in ALLOWED:
                    return f"function '{called}' is not allowed"
            if kind in ("ScalarSubquery", "LateralSubquery", "Exists", "ListQuery"):
                stack.append(e.plan())
            below = e.children()
            inner += [below.apply(i) for i in range(below.size())]
    return None


_ONE_ROW, _LIMITS = ("HashAggregateExec", "SortAggregateExec", "ObjectHashAggregateExec"), ("LocalLimitExec", "GlobalLimitExec", "CollectLimitExec", "TakeOrderedAndProjectExec")
_UNKEYED = ("CartesianProductExec", "BroadcastNestedLoopJoinExec")


def _all(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def cost(df: DataFrame) -> Cost:
    """A bound of what df costs, from its physical plan.

    Rows of tables are counted only if a join without an equality needs them: of Parquet files that reads footers, of other tables what a
    count reads.  Filters don't lower a bound, limits and aggregates without groups do.
    """
    told, seen = Cost(), {}
    session = df.sparkSession._jsparkSession
    rows_of = df.sparkSession._jvm.org.apache.spark.sql.classic.Dataset.ofRows
    done = df._jdf.queryExecution()
    # Subqueries that the optimiser didn't make joins are plans of their own.
    plans = [done.sparkPlan(), *(rows_of(session, p).queryExecution().sparkPlan() for p in _all(done.optimizedPlan().subqueriesAll()))]

    def kind(node) -> str:
        return node.getClass().getSimpleName()

    every, stack = [], list(plans)
    while stack:
        node = stack.pop()
        every.append(node)
        stack += _all(node.children())
        if kind(node) == "FileSourceScanExec":
            told.read_bytes += node.relation().location().sizeInBytes()
    counting = any(kind(n) in _UNKEYED for n in every)

    def table_rows(node) -> float:
        if kind(node) == "LocalTableScanExec":
            return node.rows().size()
        if kind(node) == "FileSourceScanExec":
            key = tuple(sorted(node.relation().location().inputFiles()))
            if key not in seen:
                seen[key] = session.baseRelationToDataFrame(node.relation()).count()
            return seen[key]
        link = node.logicalLink()
        if link.isEmpty():
            return math.inf
        return rows_of(session, link.get()).count()

    def rows(node) -> float:
        name, below = kind(node), [rows(c) for c in _all(node.children())]
        if name in _UNKEYED:
            pairs = below[0] * below[1]
            told.pairs += pairs
            return pairs if node.joinType().sql() != "FULL OUTER" else pairs + sum(below)
        if not below:
            return table_rows(node)
        if name == "UnionExec":
            return sum(below)
        if name in _ONE_ROW and node.groupingExpressions().isEmpty():
            return 1
        if name in _LIMITS:
            return min(below[0], node.limit()) if node.limit() >= 0 else below[0]
        if name == "ExpandExec":
            return below[0] * node.projections().size()
        if name in ("GenerateExec", "UnionLoopExec"):
            return math.inf
        return max(below)

    if counting:
        told.rows = [rows(p) for p in plans][0]
    return told


def within(df: DataFrame, budget: Budget) -> DataFrame:
    """df, if its cost is within the budget; raises Refused."""
    price = cost(df)
    if price.read_bytes > budget.read_bytes:
        raise Refused(f"the query reads {price.read_bytes} bytes; {budget.read_bytes} are allowed")
    if price.pairs > budget.pairs:
        raise Refused(f"joins without an equality compare up to {price.pairs:.0f} pairs; {budget.pairs} are allowed")
    return df


def admitted(spark: SparkSession, sql: str, views: dict[str, DataFrame], budget: Budget = Budget()) -> DataFrame:  # noqa: B008
    """The query's DataFrame over the views alone; raises Refused."""
    if why := problem(sql, list(views), spark):
        raise Refused(why)
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    for name, df in views.items():
        rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.queryExecution().analyzed())
        DataFrame(rows, own).createOrReplaceTempView(name)
    return within(own.sql(_COMMENT.sub(" ", sql).strip()), budget)


def _small(df: DataFrame) -> DataFrame:
    """df that fails on a value, or a row, that is too large, before it reaches the driver."""
    told = []
    for i, field in enumerate(df.schema):
        c = F.col(f"c{i}")
        if field.dataType.typeName() in ("string", "binary"):
            c = F.when(F.length(c) > VALUE_CHARS, F.raise_error(F.lit("a value is too large")).cast(field.dataType)).otherwise(c)
        told.append(c.alias(f"c{i}"))
    rows = df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(*told)
    size = F.length(F.to_json(F.struct(*rows.columns)))
    return rows.where(F.when(F.coalesce(size, F.lit(0)) > RESULT_CHARS, F.raise_error(F.lit("the result is too large")).cast("boolean")).otherwise(True)) if rows.columns else rows


def capped(df: DataFrame, rows: int = ROWS) -> tuple[list, bool]:
    """The first rows, and whether there are more."""
    found = df.limit(rows + 1).collect()
    return found[:rows], len(found) > rows


def run(spark: SparkSession, sql: str, views: dict[str, DataFrame], rows: int = ROWS, seconds: float = SECONDS, budget: Budget = Budget()) -> dict:  # noqa: B008
    """The answer: columns, rows, row_count, truncated.  The job is cancelled after the given time."""
    df = admitted(spark, sql, views, budget)
    tag, own = f"guarded-{threading.get_ident()}", df.sparkSession
    timer = threading.Timer(seconds, lambda: own.interruptTag(tag))
    own.addTag(tag)
    timer.start()
    try:
        found, more = capped(_small(df.limit(rows + 1)), rows)
    except SparkRuntimeException as e:
        for why in ("a value is too large", "the result is too large"):
            if why in str(e):
                raise Refused(why) from e
        raise
    finally:
        timer.cancel()
        own.removeTag(tag)
    told = {"columns": df.columns, "rows": [list(r) for r in found], "row_count": len(found), "truncated": more}
    if len(json.dumps(told, default=str)) > RESULT_CHARS:
        raise Refused("the result is too large")
    return told
