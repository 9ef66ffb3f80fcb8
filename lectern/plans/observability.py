"""Queries of the request log, the ledger, policy and approvals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.folders import shared_dir
from lectern.operators import ledger, observe, policy, rollup
from lectern.operators.tablelog import TableLog
from lectern.plans.registry import query
from lectern.plans.tables import LEDGER, LEDGER_ALL, REQLOG, ledger_all, ledger_rows, reqlog, table

DAILY = f"""{REQLOG}, da as (select strftime(ts, '%Y-%m-%d') as day, count(*) as requests, count(*) filter (refused) as refused, round(avg(latency_ms), 9) as avg_latency_ms, round(avg(k / 100), 9) as groundedness, round(avg(1 - k / 200), 9) as relevance from reqlog group by 1)"""


@query(f"with {REQLOG} select request_id, arg_max(mode, id) as mode, arg_max(latency_ms, id) filter (latency_ms is not null) as latency_ms, arg_max(case when id % 2 = 0 then user_id end, id) filter (id % 2 = 0) as user_id, count(*) as writes from reqlog group by request_id")
def log_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = reqlog(spark, d).withColumn("user_id", F.when(F.col("id") % 2 == 0, F.col("user_id")))
    return observe.upserted(rows, "request_id", "id", ["mode", "latency_ms", "user_id"])


@query(f"with {REQLOG} select id, case when id % 10 = 0 then 'new' when k is not null then 'old' end as judge from reqlog")
def judge_attach(spark: SparkSession, d: str) -> DataFrame:
    rows = reqlog(spark, d).select("id", F.when(F.col("judge").isNotNull() & F.get_json_object("judge", "$.groundedness").isNotNull(), "old").alias("judge"))
    scores = reqlog(spark, d).where("id % 10 = 0").select("id", F.lit("new").alias("judge"))
    return observe.attached(rows, scores, "id", "judge").select("id", "judge")


@query(f"with {REQLOG} select count(*) as requests, count(*) filter (refused) as refused, round(avg(latency_ms), 9) as avg_latency_ms, sum(prompt_tokens)::bigint as prompt_tokens, sum(output_tokens)::bigint as output_tokens from reqlog")
def log_totals(spark: SparkSession, d: str) -> DataFrame:
    return observe.totals(reqlog(spark, d))


@query(f"with {DAILY} select * from da")
def log_daily(spark: SparkSession, d: str) -> DataFrame:
    return observe.daily(reqlog(spark, d))


@query(f"""with {REQLOG.replace("reqlog as (", "every as (", 1)}, reqlog as (select * from every qualify row_number() over (partition by request_id order by id desc) = 1 and id % 6 <> 5), {DAILY[len(REQLOG) + 2 :]} select * from da""")
def log_rollup(spark: SparkSession, d: str) -> DataFrame:
    """The daily rollup kept through three batches, of which the second is older than the first, and through deletions."""
    rows = reqlog(spark, d).select("request_id", "id", "ts", "mode", "refused", "latency_ms", "judge")
    log = TableLog(spark, f"{shared_dir(spark).rstrip('/')}/rollup-{uuid.uuid4().hex}")
    for k in (1, 0, 2):
        rollup.apply(log, rows.where(F.col("id") % 3 == k))
    rollup.apply(log, log.read(rollup.REQUESTS, log.version()).where("id % 6 = 5").withColumn("gone", F.lit(True)), delete="gone")
    return rollup.daily(log)


TREND = f"""{DAILY}, spine as (select strftime(unnest(generate_series(timestamp '2024-01-23', timestamp '2024-02-05', interval 1 day)), '%Y-%m-%d') as day),
    tr as (select day, coalesce(requests, 0) as requests, round(100.0::double * refused / requests, 1) as refusal_rate, round(avg_latency_ms, 0) as latency, round(groundedness, 3) as groundedness, round(relevance, 3) as relevance from spine left join da using (day))"""


@query(f"with {TREND} select * from tr")
def log_trend14(spark: SparkSession, d: str) -> DataFrame:
    return observe.trend(reqlog(spark, d), "2024-02-05")


@query(f"""with {TREND} select day, round(2 + 116.0::double * (row_number() over (order by day) - 1) / 13, 1) as x, case when latency is not null then round(case when max(latency) over () > min(latency) over () then 2 + 28.0::double * (1 - (latency - min(latency) over ()) / (max(latency) over () - min(latency) over ())) else 16 end, 1) end as y from tr""")
def log_sparkline(spark: SparkSession, d: str) -> DataFrame:
    return observe.sparkline(observe.trend(reqlog(spark, d), "2024-02-05"), "day", "latency").select("day", "x", "y")


@query(f"with {REQLOG} select id, mode, latency_ms from reqlog where mode = 'error' order by id desc limit 25")
def log_recent(spark: SparkSession, d: str) -> DataFrame:
    return observe.recent(reqlog(spark, d), 25, mode="error").select("id", "mode", "latency_ms")


@query("with c as (select count(*) as documents, count(distinct source) as sources, count(*) filter (doc_id % 17 = 0) as quarantined from documents), l as (select count(*) as requests, max(event_id) as last from events) select * from c cross join l")
def store_status(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"), F.count_if(F.col("doc_id") % 17 == 0).alias("quarantined"))
    return docs.crossJoin(F.broadcast(table(spark, d, "events").agg(F.count("*").alias("requests"), F.max("event_id").alias("last"))))


@query(f"with {LEDGER} select seq, sha256(json_array(repeat('0', 64), kind, request_id, payload)::varchar) as hash from ledger_rows")
def ledger_hash(spark: SparkSession, d: str) -> DataFrame:
    return ledger_rows(spark, d).select("seq", ledger.hash_column(F.lit(ledger.GENESIS), F.col("kind"), F.col("request_id"), F.col("payload")).alias("hash"))


@query(f"with {LEDGER} select true as ok, count(*) as checked, null::bigint as first_bad_seq, null::varchar as reason from ledger_rows")
def ledger_verify(spark: SparkSession, d: str) -> DataFrame:
    return ledger.verify(ledger.chained(ledger_rows(spark, d)))


@query("select false as ok, 57::bigint as checked, 57::bigint as first_bad_seq, 'hash' as reason")
def ledger_tamper(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger.chained(ledger_all(spark, d))
    return ledger.verify(rows.withColumn("payload", F.when(F.col("seq") == 57, F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))))


@query(f"with {LEDGER} select max(seq) as seq, count(*) as rows from ledger_rows")
def ledger_head(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger.chained(ledger_rows(spark, d))
    return ledger.head(rows).select("seq").crossJoin(F.broadcast(rows.agg(F.count("*").alias("rows"))))


@query(f"with {LEDGER_ALL} select seq, sha256(json_array(repeat('0', 64), kind, request_id, payload)::varchar) as hash from ledger_rows")
def ledger_hash_all(spark: SparkSession, d: str) -> DataFrame:
    return ledger_all(spark, d).select("seq", ledger.hash_column(F.lit(ledger.GENESIS), F.col("kind"), F.col("request_id"), F.col("payload")).alias("hash"))


@query(f"with {LEDGER_ALL} select true as ok, count(*) as checked, null::bigint as first_bad_seq, null::varchar as reason from ledger_rows")
def ledger_verify_all(spark: SparkSession, d: str) -> DataFrame:
    return ledger.verify(ledger.chained(ledger_all(spark, d)))


@query(f"with {LEDGER_ALL} select max(seq) as seq, count(*) as rows from ledger_rows")
def ledger_head_all(spark: SparkSession, d: str) -> DataFrame:
    return ledger.chained(ledger_all(spark, d)).agg(F.max("seq").alias("seq"), F.count("*").alias("rows"))


def _calls(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.when(F.col("event_id") % 5 == 0, "ftp://").otherwise("https://"), F.when(F.col("event_id") % 3 == 0, "Intranet.example").otherwise("other.example"), F.lit("/x"))
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("request_id"), F.col("event_type").alias("tool"), url.alias("url"))


CALLS = "calls as (select event_id, user_id as request_id, event_type as tool, case when event_id % 5 = 0 then 'not a full http or https address' when event_id % 3 <> 0 then 'host outside the allowlist' end as problem from events)"


@query(f"with {CALLS} select event_id, case when tool not in ('view', 'click', 'purchase') or (tool = 'view' and problem is not null) then 'denied' when tool = 'purchase' then 'approval' else 'allowed' end as decision from calls")
def policy_decide(spark: SparkSession, d: str) -> DataFrame:
    problem = F.when(F.col("tool") == "view", policy.host_problem(F.col("url"), ["intranet.example"]))
    return policy.decided(_calls(spark, d), ["view", "click", "purchase"], ["purchase"], problem=problem).select("event_id", "decision")


@query(f"with {CALLS} select event_id, problem from calls")
def host_allowlist(spark: SparkSession, d: str) -> DataFrame:
    return _calls(spark, d).select("event_id", policy.host_problem(F.col("url"), ["intranet.example"]).alias("problem"))


@query(f"with {CALLS} select event_id, row_number() over (partition by request_id order by event_id) as call_no, row_number() over (partition by request_id order by event_id) > 6 as over from calls")
def call_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = policy.budgeted(_calls(spark, d), "request_id", "event_id").select("event_id", F.col("call_no").cast("long").alias("call_no"), "over")
    return rows


STATES = "case event_type when 'view' then 'pending' when 'click' then 'approved' when 'error' then 'rejected' else 'executed' end"


@query(f"""with e as (select user_id % 500 as approval_id, event_id as seq, {STATES} as status from events), b as (select *, lag(status) over (partition by approval_id order by seq) as before from e)
    select approval_id, arg_max(status, seq) as status, bool_and(case when before is null then status = 'pending' when before = 'pending' then status in ('approved', 'rejected') when before = 'approved' then status = 'executed' else false end) as legal from b group by approval_id""")
def approval_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select((F.col("user_id") % 500).alias("approval_id"), F.col("event_id").alias("seq"), F.expr(STATES).alias("status"))
    return policy.approvals(rows)


@query("select doc_id, case when doc_id % 3 = 0 then ['staff'] else ['public'] end as acl_tags, doc_id % 17 = 0 and doc_id not in (0, 17, 34) as quarantined from documents")
def retag_release(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.array(F.lit("public")).alias("acl_tags"), (F.col("doc_id") % 17 == 0).alias("quarantined"))
    changes = docs.where("doc_id % 3 = 0").select("doc_id", F.array(F.lit("staff")).alias("new_tags"))
    return policy.retagged(policy.released(docs, [0, 17, 34], "doc_id"), changes, "doc_id")
