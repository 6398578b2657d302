"""Queries of the training-data operators and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from policyspark.llm import alignment, decontam, fingerprints, langid, licenses, ngrams, quality, runs, secret_scan, sentpiece, simhash, toxicity, warc
from policyspark.llm.common import table


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"), secret_scan.learn(secret_scan.labelled_findings(spark)))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.learn(docs))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentpiece.sampled(table(spark, sf_dir, "documents"), sentpiece.load())


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.search_counts(fingerprints.document_fingerprints(table(spark, sf_dir, "documents")))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), alignment.load())


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(table(spark, sf_dir, "documents"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.scored(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_language_id": op2_language_id,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_license_scans": op4_license_scans,
    "op5_warc": op5_warc,
    "op6_toxicity": op6_toxicity,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_document_fingerprints": op10_document_fingerprints,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_lm_scoring": op13_lm_scoring,
}

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = " || ".join(f"substr('{_ALPHABET}', 1 + (((('0x' || substr(sha, {1 + 5 * i}, 5))::INTEGER >> {s}) & 31)), 1)" for i in range(8) for s in (15, 10, 5, 0))

ORACLES: dict[str, str] = {
    "op5_warc": f"""
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
             m AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS top,
                          lower(regexp_extract(url, '^[A-Za-z]+://(?:www\\.)?([^/:?#]*)', 1)) AS host,
                          lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1)) AS rest FROM p)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < top THEN top END AS refers_to,
               array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || rest AS url_key,
               strftime(make_timestamp((1704067200 + page_id % 31536000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured_at
        FROM m""",
}
