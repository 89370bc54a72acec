"""Registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import (
    bpe, fingerprint, hnsw, importance, langid, lexical, licenses, minhash, packing, quality, toxicity, urlfilter, zarchive,
)
from linkloom.llm.common import held_out, table
from linkloom.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digest(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"))


def _marked(scores: DataFrame, fold: tuple[int, int]) -> DataFrame:
    return scores.withColumn("held_out", held_out(F.col("doc_id"), *fold))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = _marked(langid.predict(docs, langid.train_on(docs)), langid.HELD_OUT)
    return rows.select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = _marked(toxicity.predict(docs, toxicity.train(docs, labels)), toxicity.HELD_OUT)
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = _marked(quality.predict(docs, quality.train(docs, labels)), quality.HELD_OUT)
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.classify(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    zarchive.write_archive(table(spark, sf_dir, "pages"), path)
    return zarchive.read_archive(spark, path, with_payload=False).select(
        zarchive.key_of("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest",
        F.col("warc_type").alias("record_type"), zarchive.key_of("refers_to").cast("long").alias("refers_to"),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_document_fingerprints, op2_byte_bpe, op3_embedding_near_dedup, op4_best_fit_packing,
        op5_minhash_near_dedup, op6_language_id, op7_license_scan, op8_toxicity, op9_quality, op10_url_filter,
        op11_lexical_search, op12_importance_resampling, op13_warc_zstd,
    )
}
_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op11_lexical_search": f"""
        WITH words AS (
            SELECT doc_id, unnest(regexp_extract_all({_LOWER.format('text')}, '{_TERMS}')) AS term FROM documents
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
        ), total AS (
            SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS length FROM sizes
        ), wanted AS (
            SELECT item_id, term, count(*) AS repeats FROM (
                SELECT item_id, unnest(regexp_extract_all({_LOWER.format('text')}, '{_TERMS}')) AS term FROM benchmark
            ) GROUP BY item_id, term
        ), holding AS (
            SELECT doc_id, term, count(*) AS tf FROM words SEMI JOIN wanted USING (term) GROUP BY doc_id, term
        ), weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * documents + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM holding, total GROUP BY term, documents
        ), impacts AS (
            SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * documents) // length)) AS impact
            FROM holding JOIN sizes USING (doc_id), total
        ), scores AS (
            SELECT item_id, doc_id, CAST(sum(repeats * w * impact) AS BIGINT) AS score
            FROM wanted JOIN weights USING (term) JOIN impacts USING (term) GROUP BY item_id, doc_id
        )
        SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
        WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
        QUALIFY row_number() OVER best <= 10
    """,
    "op13_warc_zstd": """
        WITH captured AS (
            SELECT page_id, coalesce(html, '') AS payload FROM pages
        ), sized AS (
            SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha256(payload) AS payload_digest FROM captured
        ), firsts AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM sized
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
        FROM firsts
    """,
}
