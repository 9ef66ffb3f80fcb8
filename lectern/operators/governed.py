"""The governed store: documents, chunks and their ledger rows change in one version (`tablelog`), or not at all.

Documents (doc_id, checksum, acl_tags, ...) and chunks (chunk_id, doc_id, acl_tags, quarantined, ...) lie in buckets by their key; a change
rewrites the buckets it touches.  The ledger's head is a fact of the version, so two writers can't both follow the same row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import ledger, tablelog
from lectern.operators.tablelog import Change, TableLog, Version

BUCKETS = 16


def _entries(log: TableLog, base: Version, entries: list[tuple[str, str | None, dict]]) -> Change:
    """The ledger rows of what an administrator or a batch did, after the version's head."""
    rows = ledger.append(log.spark, entries, (base.facts.get("ledger_seq", 0), base.facts.get("ledger_hash", ledger.GENESIS)))
    last = rows.collect()[-1]
    change = log.stage("ledger", rows.coalesce(1))
    change.facts = {"ledger_seq": last.seq, "ledger_hash": last.hash}
    return change


def ingest(log: TableLog, documents: DataFrame, chunks: DataFrame, by: str) -> Version:
    """Stores the documents whose checksum isn't stored, the first of each checksum by doc_id, with their chunks and one ledger row.

    Stored again, a batch changes nothing but adds its row.  Rows without a checksum are refused.
    """

    def build(base: Version) -> Change:
        fresh = documents.groupBy("checksum").agg(F.min_by(F.struct(*documents.columns), "doc_id").alias("d")).select("d.*")
        if "documents" in base.schemas:
            fresh = fresh.join(log.read("documents", base).select("checksum"), "checksum", "left_anti").select(*documents.columns)
        fresh = fresh.withColumn("version", F.lit(base.number + 1).cast("long")).persist()
        try:
            if fresh.where("checksum is null or doc_id is null").limit(1).count():
                raise ValueError("a document has no checksum or no id")
            new = chunks.join(fresh.select("doc_id"), "doc_id", "left_semi").select(*chunks.columns).withColumn("version", F.lit(base.number + 1).cast("long"))
            stored = [tablelog.merged(log, "documents", base, fresh, "doc_id", "version", BUCKETS), tablelog.merged(log, "chunks", base, new, "chunk_id", "version", BUCKETS)]
            told = {"action": "ingest", "by": by, "documents": fresh.count(), "chunks": new.count()}
        finally:
            fresh.unpersist()
        return tablelog.together(*stored, _entries(log, base, [("ingest", None, told)]))

    return log.commit(build)


def _named(rows: DataFrame, key: str, ids: list[int]) -> DataFrame:
    found = rows.where(F.col(key).isin(ids))
    lost = sorted(set(ids) - {r[0] for r in found.select(key).collect()})
    if lost:
        raise KeyError(f"not stored: {lost[:5]}")
    return found


def release(log: TableLog, ids: list[int], by: str) -> Version:
    """Takes chunks out of quarantine, with a ledger row each.  KeyError for an unknown chunk, ValueError for one that isn't in quarantine."""

    def build(base: Version) -> Change:
        found = _named(log.read("chunks", base), "chunk_id", ids)
        if found.where("not quarantined").limit(1).count():
            raise ValueError("a chunk is already out of quarantine")
        rows = found.withColumns({"quarantined": F.lit(False), "version": F.lit(base.number + 1).cast("long")})
        told = [("quarantine", None, {"action": "release", "chunk_id": i, "by": by}) for i in ids]
        return tablelog.together(tablelog.merged(log, "chunks", base, rows, "chunk_id", "version", BUCKETS), _entries(log, base, told))

    return log.commit(build)


def retag(log: TableLog, tags: dict[int, list[str]], by: str) -> Version:
    """Replaces the tags of documents and of all their chunks, with a ledger row each.  KeyError for an unknown document, ValueError for no tags."""
    if any(not t for t in tags.values()):
        raise ValueError("a document needs a tag")

    def build(base: Version) -> Change:
        version = F.lit(base.number + 1).cast("long")
        given = F.create_map(*(x for i, t in tags.items() for x in (F.lit(i).cast("long"), F.array(*map(F.lit, t)))))
        docs = _named(log.read("documents", base), "doc_id", list(tags))
        before = {r.doc_id: list(r.acl_tags) for r in docs.collect()}
        parts = [(t, k, rows.withColumns({"acl_tags": given[F.col("doc_id")], "version": version})) for t, k, rows in (("documents", "doc_id", docs), ("chunks", "chunk_id", log.read("chunks", base).where(F.col("doc_id").isin(list(tags)))))]
        told = [("retag", None, {"acl_tags": t, "by": by, "document_id": i, "previous_acl_tags": before[i]}) for i, t in tags.items()]
        return tablelog.together(*(tablelog.merged(log, t, base, rows, k, "version", BUCKETS) for t, k, rows in parts), _entries(log, base, told))

    return log.commit(build)

