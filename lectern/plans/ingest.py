"""Queries of loading, text functions, chunking, dedup and storing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import html, text
from lectern.functions.folders import shared_dir
from lectern.operators import chunker, governed, ledger, store
from lectern.operators.tablelog import TableLog, merged
from lectern.plans.registry import query
from lectern.plans.tables import table
from lectern.sources import loaders


@query("""select page_id, case page_id % 5 when 0 then 'html' when 1 then 'md' when 2 then 'txt' when 3 then 'pdf' else 'html' end as kind from pages""")
def fmt_detect(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 5
    suffix = F.when(k == 1, ".MD").otherwise("")
    kind = F.when(k == 2, "text/plain; charset=utf-8").otherwise(F.lit(None).cast("string"))
    raw = F.when(k == 3, F.lit("%PDF-1.7")).otherwise(F.concat(F.lit("  "), "html")).cast("binary")
    return table(spark, d, "pages").select("page_id", text.detect_kind(suffix, kind, raw).alias("kind"))


@query("select doc_id, replace(replace(text, chr(10), chr(10) || chr(10)), ' the ', chr(10) || 'the ') as body from documents")
def text_normalise(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("﻿"), F.replace(F.replace("text", F.lit("\n"), F.lit("\r\n\r")), F.lit(" the "), F.lit("\rthe "))).cast("binary")
    return table(spark, d, "documents").select("doc_id", text.decoded(raw).alias("body"))


@query("select doc_id, case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then 'Top ' || doc_id else 'Sub ' || doc_id end as title from documents")
def md_title(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    made = F.when(F.col("doc_id") % 3 == 0, "plain").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("## Sub "), i, F.lit("\n\n# Top "), i, F.lit(" ##\nx"))).otherwise(F.concat(F.lit("x\n### Sub "), i, F.lit("\n## b")))
    return table(spark, d, "documents").select("doc_id", text.markdown_title(made).alias("title"))


@query("select min(doc_id) as doc_id, sha256(text) as checksum, count(*) as copies from documents group by text")
def dedup_checksum(spark: SparkSession, d: str) -> DataFrame:
    return store.deduplicated(table(spark, d, "documents").withColumn("checksum", F.sha2("text", 256)), "doc_id").select("doc_id", "checksum", "copies")


@query("select doc_id from documents d where not exists (select 1 from documents e where e.text = d.text and e.doc_id % 4 = 0)")
def dedup_probe(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("checksum", F.sha2("text", 256))
    return store.unseen(docs, docs.where("doc_id % 4 = 0")).select("doc_id")


@query("select e.event_id from events e where not exists (select 1 from documents d where d.doc_id = e.user_id * 7)")
def missing_ids(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "events").select("event_id", (F.col("user_id") * 7).alias("doc_id"))
    return store.missing(asked, table(spark, d, "documents"), "doc_id").select("event_id")


@query("select source, count(*) as chunks, count(*) filter (doc_id % 17 = 0) as quarantined from documents group by source")
def document_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("chunks"), F.count_if(F.col("doc_id") % 17 == 0).alias("quarantined"))


@query("select v.vec_id, case when v.vec_id % 3 = 0 then n.embedding[1] else v.embedding[1] end as first from embeddings v join embeddings n on n.vec_id = (v.vec_id // 3) * 3")
def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Vectors stored in buckets, then every third upserted: only the buckets it falls into are written again."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    log = TableLog(spark, _store(spark))
    for k, part in enumerate((rows, rows.where("vec_id % 3 = 0"))):
        log.commit(lambda base, k=k, part=part: merged(log, "vectors", base, part.withColumn("seq", F.lit(k)), "vec_id", "seq"))
    return log.read("vectors", log.version()).select("vec_id", F.col("embedding")[0].alias("first"))


def _store(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"


@query("""with kept as (select doc_id from (select doc_id, row_number() over (partition by sha256(text) order by doc_id % 2, doc_id) as place from documents) where place = 1),
    freed as (select doc_id from kept where doc_id % 17 = 0 order by doc_id limit 3), moved as (select doc_id from kept order by doc_id desc limit 3)
    select doc_id, case when doc_id in (select doc_id from moved) then ['staff'] else ['public'] end as acl_tags, doc_id % 17 = 0 and doc_id not in (select doc_id from freed) as quarantined,
        2 + (select count(*) from freed) + (select count(*) from moved) as ledger_rows, true as ledger_ok from kept""")
def governed_store(spark: SparkSession, d: str) -> DataFrame:
    """Documents and chunks ingested in two batches of which the second repeats the first, then chunks released and documents retagged: each a version with its ledger rows."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"), F.array(F.lit("public")).alias("acl_tags"))
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", "acl_tags", (F.col("doc_id") % 17 == 0).alias("quarantined"))
    log = TableLog(spark, _store(spark))
    governed.ingest(log, docs.where("doc_id % 2 = 0"), chunks, "nightly")
    governed.ingest(log, docs, chunks, "nightly")
    stored = log.read("chunks", log.version())
    governed.release(log, [r[0] for r in stored.where("quarantined").orderBy("chunk_id").limit(3).select("chunk_id").collect()], "admin")
    governed.retag(log, {r[0]: ["staff"] for r in stored.orderBy(F.desc("doc_id")).limit(3).select("doc_id").collect()}, "admin")
    now = log.version()
    told = ledger.verify(log.read("ledger", now)).select(F.col("checked").alias("ledger_rows"), F.col("ok").alias("ledger_ok"))
    return log.read("chunks", now).select("doc_id", "acl_tags", "quarantined").crossJoin(F.broadcast(told))


@query("select 'r' || (event_id % 4000) as request_id, max(event_id) as id, arg_max(event_type, event_id) as mode from events group by 1 having max(event_id) % 6 <> 5")
def log_merge(spark: SparkSession, d: str) -> DataFrame:
    """A request log kept by keyed merges in three batches, of which the second is older than the first; some requests are deleted by their last row."""
    rows = table(spark, d, "events").select(F.concat(F.lit("r"), (F.col("event_id") % 4000).cast("string")).alias("request_id"), F.col("event_id").alias("id"), F.col("event_type").alias("mode"))
    log = TableLog(spark, _store(spark))
    for k in (1, 0, 2):
        part = rows.where(F.col("id") % 3 == k)
        log.commit(lambda base, part=part: merged(log, "requests", base, part, "request_id", "id"))
    last = log.read("requests", log.version()).where("id % 6 = 5").withColumn("gone", F.lit(True))
    log.commit(lambda base: merged(log, "requests", base, last, "request_id", "id", delete="gone"))
    return log.read("requests", log.version())


@query("select doc_id, case when doc_id % 4 = 2 then [2] else [(doc_id % 4)::int, 2] end as cited from documents")
def citations_extract(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.lit("As said ["), (F.col("doc_id") % 4).cast("string"), F.lit(" , 2], and [2] but not [x] or [ ]."))
    return table(spark, d, "documents").select("doc_id", text.citations(made).alias("cited"))


@query("select doc_id, doc_id % 2 = 0 as bare, doc_id % 3 = 0 as refusal from documents")
def answer_shape(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    bare = F.when(i % 2 == 0, "[1] [2, 3].").otherwise("yes [1]")
    refusal = F.when(i % 3 == 0, " the documents  available to you do NOT answer this question [1]. Sorry").otherwise("The documents say so.")
    return table(spark, d, "documents").select("doc_id", text.is_bare_citation(bare).alias("bare"), text.is_refusal(refusal).alias("refusal"))


SQUASH = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


@query(f"select doc_id, case when length({SQUASH.format('text')}) <= 240 then {SQUASH.format('text')} else rtrim(substr({SQUASH.format('text')}, 1, 239)) || '…' end as snippet from documents")
def snippet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


LABELS = "select doc_id, case when doc_id % 2 = 0 then 'Guide' else '' end as title, 'dir\\sub/file' || doc_id || '.md' as path, case when doc_id % 3 = 0 then doc_id % 7 end as page, case when doc_id % 5 = 0 then lang end as heading from documents"
NAME = "case when title <> '' then title else regexp_extract(replace(path, '\\', '/'), '[^/]*$') end"


def _labels(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", F.when(i % 2 == 0, "Guide").otherwise("").alias("title"), F.concat(F.lit("dir\\sub/file"), i.cast("string"), F.lit(".md")).alias("path"), F.when(i % 3 == 0, i % 7).alias("page"), F.when(i % 5 == 0, F.col("lang")).alias("heading"))


@query(f"with l as ({LABELS}) select doc_id, concat_ws(', ', {NAME}, case when page <> 0 then 'p.' || page end, heading) as label from l")
def source_label(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("doc_id", text.source_label(F.col("title"), F.col("path"), F.col("page"), F.col("heading")).alias("label"))


@query(f"with l as ({LABELS}) select doc_id, concat_ws(' · ', {NAME}, heading, case when page <> 0 then 'p.' || page end) as label from l")
def chip_label(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("doc_id", text.chip_label(F.col("title"), F.col("path"), F.col("page"), F.col("heading")).alias("label"))


@query("select conv_id, string_agg('[' || turn || '] ' || role || chr(10) || trim(text), chr(10) || chr(10) order by turn) as block from conversations group by conv_id")
def source_block(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("turn").alias("rank"), F.col("role").alias("label"), "text")).alias("r"))
    return rows.select("conv_id", text.source_block(F.col("r")).alias("block"))


@query("select doc_id, list_distinct(list_filter(string_split(lang || ',' || source || ' ' || lang, ' '), lambda x: x <> '')) as raw from documents where false union all select doc_id, [lang, source] from documents")
def split_tags(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.lit(" "), "lang", F.lit(", "), "source", F.lit(" ,"), "lang")
    return table(spark, d, "documents").select("doc_id", text.split_tags(made).alias("raw"))


@query("""select page_id, replace(replace(replace(replace(replace(substr(html, 1, 200), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;'), '''', '&#39;') || ' <a class="cite" href="#source-1">[1]</a>' as body from pages""")
def cite_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.linked_citations(F.concat(F.substring("html", 1, 200), F.lit(" [1]"))).alias("body"))


@query("""select page_id, regexp_replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;'), '''', '&#39;'), '\\[\\s*(\\d+)\\s*\\]', '<a class="cite" href="#source-\\1">[\\1]</a>', 'g') || ' <a class="cite" href="#source-1">[1]</a>' as body from pages""")
def cite_links_whole(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.linked_citations(F.concat("html", F.lit(" [1]"))).alias("body"))


@query("select page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '') as title from pages")
def html_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query("select page_id, regexp_extract_all(html, '(?i)<a [^>]*href=\"([^\"]*)\"', 1) as links from pages")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", html.links(F.col("html")).alias("links"))


@query("select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) as body from pages")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", html.stripped(F.col("html")).alias("body"))


@query()
def html_markdown(spark: SparkSession, d: str) -> DataFrame:
    return html.rendered(table(spark, d, "pages").select("page_id", "html")).select("page_id", "title", "text")


@query("select doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') as sentences from documents")
def chunk_sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.filter(F.split("text", "(?<=[.!?])\\s+"), lambda s: s != "").alias("sentences"))


@query()
def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    return chunker.chunked(table(spark, d, "documents"))


@query()
def chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    return chunker.chunked(table(spark, d, "pages").select("page_id", "html"), "page_id", "html", read=html.body_text)


@query("select page_id, sha256(html) as checksum, octet_length(encode(html)) as bytes from pages")
def load_checksum(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("checksum"), F.octet_length("html").cast("long").alias("bytes"))


@query()
def load_files(spark: SparkSession, d: str) -> DataFrame:
    """The input folder's own files through the binary source, without their content."""
    return loaders.listed(spark, d, "*.parquet").select("name", "suffix", "length")
