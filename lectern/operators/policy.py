"""Tool policy, call budgets, approvals, host allowlist, quarantine release and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_CALLS = 6


def decided(calls: DataFrame, allowed: list[str], writes: list[str], approval: bool = True, problem: Column | None = None) -> DataFrame:
    """calls (tool, ...) with decision: `denied` off the allowlist or for a problem with the arguments, `approval` for tools that write, else `allowed`."""
    bad = ~F.col("tool").isin(allowed) if allowed else F.lit(True)
    if problem is not None:
        bad = bad | problem.isNotNull()
    waits = F.col("tool").isin(writes) if writes and approval else F.lit(False)
    return calls.withColumn("decision", F.when(bad, "denied").when(waits, "approval").otherwise("allowed"))


def budgeted(calls: DataFrame, request: str, order: str, most: int = MOST_CALLS) -> DataFrame:
    """calls with call_no and over: whether a call is beyond its request's budget."""
    number = F.row_number().over(Window.partitionBy(request).orderBy(order))
    return calls.withColumn("call_no", number).withColumn("over", number > most)


def approvals(events: DataFrame) -> DataFrame:
    """The latest state of each approval_id of events (approval_id, seq, status), and whether every step was a legal one.

    pending leads to approved or rejected, approved to executed.
    """
    before = F.lag("status").over(Window.partitionBy("approval_id").orderBy("seq"))
    step = F.when(before.isNull(), F.col("status") == "pending").when(before == "pending", F.col("status").isin("approved", "rejected")).when(before == "approved", F.col("status") == "executed").otherwise(False)
    return events.withColumn("legal", step).groupBy("approval_id").agg(F.max_by("status", "seq").alias("status"), F.min("legal").alias("legal"))


def host_problem(url: Column, hosts: list[str] | None) -> Column:
    """Why a URL is refused, or null: http or https to a host of the allowlist."""
    scheme, host = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    partial = ~scheme.isin("http", "https") | (host == "")
    outside = F.lit(False) if hosts is None else (~host.isin([h.lower() for h in hosts]) if hosts else F.lit(True))
    return F.when(partial, "not a full http or https address").when(outside, "host outside the allowlist")


def quarantined(chunks: DataFrame, documents: DataFrame, columns: list[str]) -> DataFrame:
    """chunk_id, doc_id, acl_tags of the chunks in quarantine, with columns of their documents; null ones for a document that isn't there."""
    held = chunks.where("quarantined").select("chunk_id", "doc_id", "acl_tags")
    return held.join(documents.select("doc_id", *columns), "doc_id", "left").select("chunk_id", "doc_id", "acl_tags", *columns)


def released(chunks: DataFrame, ids: list[int], key: str = "chunk_id") -> DataFrame:
    """chunks with the given ones out of quarantine; the reason stays."""
    return chunks.withColumn("quarantined", F.col("quarantined") & ~F.col(key).isin(ids) if ids else F.col("quarantined"))


def retagged(rows: DataFrame, changes: DataFrame, key: str = "document_id") -> DataFrame:
    """rows with acl_tags replaced where changes (key, new_tags) has their document."""
    return rows.join(changes, key, "left").withColumn("acl_tags", F.coalesce("new_tags", "acl_tags")).drop("new_tags")


def trail(requests: DataFrame, ledger: DataFrame, approvals: DataFrame) -> DataFrame:
    """request_id, origin (ledger or approval), seq, kind of everything that the ledger (request_id, seq, kind) and the approvals (request_id, approval_id, status) hold of the requests (request_id)."""
    rows = ledger.select("request_id", F.lit("ledger").alias("origin"), F.col("seq").cast("long").alias("seq"), "kind")
    rows = rows.union(approvals.select("request_id", F.lit("approval"), F.col("approval_id").cast("long"), "status"))
    return rows.join(requests.select("request_id").distinct(), "request_id")


def recorded(changed: DataFrame, kind: str, key: str, detail: list[str]) -> DataFrame:
    """kind, request_id, payload: the ledger entries of rows that an administrator changed, in no order yet."""
    return changed.select(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("request_id"), F.to_json(F.struct(*sorted({key, *detail}))).alias("payload"))
