"""A content-addressed archive of web records.

Payload bytes are stored once, in `payloads` (digest, payload; bucketed by digest), under their SHA-256; the exact header bytes of every record are
kept in `records`.  Equal payloads have one response, the record with the largest page_id; the others are revisits
that refer to it.  Original records come back by joining headers to payloads on the digest; each payload is verified by
recomputing its digest and length before it is used.  Both tables are Parquet in one folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import HEAVY, bucketed, checkpoint, entries, partitions, remove, scratch, spread_join

#: Payloads shorter than this many bytes are responses each.
LEAST_BYTES = 0
#: Copies of a payload that very many records have, when they are read.
SALTS = 16
PAYLOADS = "digest string, payload binary"
#: Every record bears this date, so that archives of equal rows are equal.
DATE = "2024-01-01T00:00:00Z"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a hex digest whose bits are a multiple of 40, as SHA-1's are."""
    groups = [F.lpad(F.conv(F.substring(hex_digest, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header(kind: str, url: Column, page_id: Column, digest: Column, length: Column, refers_to: Column | None = None) -> Column:
    lines = [
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce(url, F.lit("")), "[\\r\\n]", "")),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
    ]
    if refers_to is not None:
        lines += [F.concat(F.lit("WARC-Refers-To: <urn:page:"), refers_to.cast("string"), F.lit(">")), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    lines += [F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), length.cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))


def store(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Writes the archive of pages (page_id, url, html) to path.

    A null html is an empty payload.  Rows that repeat page_id and payload are the same capture: all are responses.  A
    null page_id can't be referred to: it is a response unless an equal payload has one.  Other columns aren't used; an empty
    table gives an empty archive.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    # Every payload is hashed once; from here on only ids and digests move, until the owners' payloads are written.
    ids = rows.select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"), base32(F.sha1("payload")).alias("sha1"))
    ids = checkpoint(ids)
    owners = checkpoint(ids.groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")))
    joined = spread_join(ids, owners.select("digest", "owner"), "digest", owners)
    again = (F.col("bytes") >= least_bytes) & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    plain = _header("response", F.col("url"), F.col("page_id"), F.col("sha1"), F.col("bytes"))
    revisit = _header("revisit", F.col("url"), F.col("page_id"), F.col("sha1"), F.lit(0), F.col("owner"))
    records = joined.select("page_id", "digest", "bytes", F.encode(F.when(again, revisit).otherwise(plain), "UTF-8").alias("header"))
    records.write.parquet(f"{path}/records")
    # One row for each digest keeps its payload; copies are dropped before anything is shuffled.
    n = partitions(pages.sparkSession)
    once = rows.select(F.sha2("payload", 256).alias("digest"), "payload").dropDuplicates(["digest"])
    once.write.insertInto(bucketed(pages.sparkSession, f"{path}/payloads-{n}", PAYLOADS, "digest", n))


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """digest, payload of each stored payload, bucketed by digest; fails on one that doesn't have its digest."""
    name = next(x for x in entries(spark, path) if x.startswith("payloads-"))
    rows = spark.table(bucketed(spark, f"{path}/{name}", PAYLOADS, "digest", int(name.split("-")[1])))
    sound = F.sha2("payload", 256) == F.col("digest")
    return rows.select("digest", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "digest")).cast("binary")).alias("payload"))


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract(F.decode("header", "UTF-8"), f"\\r\\n{name}: ([^\\r]*)", 1), F.lit(""))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """Every record's exact header and what it says."""
    page = F.regexp_extract(F.decode("header", "UTF-8"), "\\r\\nWARC-Record-ID: <urn:page:(-?[0-9]*)", 1)
    refers = F.regexp_extract(F.decode("header", "UTF-8"), "\\r\\nWARC-Refers-To: <urn:page:(-?[0-9]+)>", 1)
    return spark.read.parquet(f"{path}/records").select(
        page.try_cast("long").alias("page_id"),
        "digest",
        "bytes",
        "header",
        _field("WARC-Type").alias("record_type"),
        _field("WARC-Payload-Digest").alias("said_digest"),
        refers.try_cast("long").alias("refers_to"),
    )


def records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, digest, bytes, said_digest, payload, warc: every original record, header and payload joined again.

    warc has the record's bytes as an archive file holds them: a revisit's block is empty, its payload is
    that of the record it refers to.  Headers meet the payloads bucket by bucket; those of a digest that many records have are
    salted, with a copy of its payload for each salt.
    """
    heads, body = headers(spark, path), payloads(spark, path)
    counts = heads.groupBy("digest").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    # At most twice as many digests as partitions are heavy.
    most = max(HEAVY, total // (2 * partitions(spark)))
    heavy = [(r[0],) for r in counts.where(F.col("n") > most).select("digest").collect()]
    if heavy:
        keys = F.broadcast(spark.createDataFrame(heavy, "digest string"))
        salted = heads.join(keys, "digest", "left_semi").withColumn("salt", F.pmod(F.xxhash64("header"), F.lit(SALTS)))
        copies = body.join(keys, "digest", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        both = heads.join(keys, "digest", "left_anti").join(body, "digest").unionByName(salted.join(copies, ["digest", "salt"]).drop("salt"))
    else:
        both = heads.join(body, "digest")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return both.select("page_id", "record_type", "refers_to", "digest", "bytes", "said_digest", "payload", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("warc"))


def summary(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records read back from the archive.

    Length and digest are those of each record's payload; one whose header says otherwise fails.
    """
    told = records(spark, path).select("page_id", "record_type", "refers_to", "digest", "bytes", "said_digest", F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("sha1"))
    same = (F.col("said_digest") == F.concat(F.lit("sha1:"), "sha1")) & (F.col("bytes") == F.col("payload_bytes"))
    digest = F.when(same, F.col("sha1")).otherwise(F.raise_error(F.concat(F.lit("header and payload differ: "), "digest")))
    return told.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def archived(pages: DataFrame, path: str | None = None, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The summary of pages after a round trip through an archive at path (default: a folder in the shared one)."""
    spark = pages.sparkSession
    path = path or scratch(spark, "archive")
    store(pages, path, least_bytes)
    return summary(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Removes an archive."""
    for name in entries(spark, path):
        if name.startswith("payloads-"):
            spark.sql(f"drop table if exists {bucketed(spark, f'{path}/{name}', PAYLOADS, 'digest', int(name.split('-')[1]))}")
    remove(spark, path)
