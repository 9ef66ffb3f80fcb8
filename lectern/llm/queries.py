"""The queries of this folder and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import archive, bytepairs, language, licenses, mixing, neardup_vectors, packing, periodic, phrases, simhash, spotsigs, substrings, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op1_license_scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_all(table(spark, sf_dir, "documents"))


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compared(table(spark, sf_dir, "documents"))


def op2_spotsigs_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.near_duplicates(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(tokenizer))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.archived(table(spark, sf_dir, "pages"))


def op7_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_mixing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_shards(table(spark, sf_dir, "documents")).select("shard", "place", "doc_id", "source", "text")


def op9_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op11_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    return bytepairs.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(ranks), public_tokenizers.PATTERN)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.repeated(table(spark, sf_dir, "documents")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op1_license_scan_all": op1_license_scan_all,
    "op2_spotsigs": op2_spotsigs,
    "op2_spotsigs_classes": op2_spotsigs_classes,
    "op3_packing": op3_packing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_warc_archive": op6_warc_archive,
    "op7_embedding_neardup": op7_embedding_neardup,
    "op8_mixing": op8_mixing,
    "op8_mixing_shards": op8_mixing_shards,
    "op9_simhash_neardup": op9_simhash_neardup,
    "op10_language_id": op10_language_id,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op1_license_scan": licenses.oracle(),
    "op2_spotsigs": spotsigs.oracle(),
    "op5_url_filter": urls.oracle(),
    "op13_collocations": phrases.oracle(),
    "op6_warc_archive": """
        with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as h from pages),
        o as (select h, max(page_id) as owner from p group by h)
        select p.page_id, octet_length(encode(p.body)) as payload_bytes,
            array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((cast('0x' || substr(p.h, 5 * (k // 4) + 1, 5) as bigint) >> (15 - 5 * (k % 4))) & 31)::int + 1, 1) for k in range(32)], '') as payload_digest,
            case when p.page_id = o.owner then 'response' else 'revisit' end as record_type,
            case when p.page_id = o.owner then null else o.owner end as refers_to
        from p join o on p.h = o.h""",
}
