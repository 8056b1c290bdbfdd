"""Thin opN queries of the training-data operators, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.llm import decontaminate, language_id, mixing, pii, secret_scan, simhash, substring_dedup, syncmers, url_filter, warc
from siftwood.llm.common import read


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read(spark, sf_dir, "documents"), ["doc_id"]))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup_substrings(read(spark, sf_dir, "documents"), min_words=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS gram
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13)),
least AS (SELECT gram, min(doc_id) AS low FROM windows GROUP BY gram),
hit AS (SELECT DISTINCT doc_id, i FROM windows JOIN least USING (gram) WHERE low < doc_id),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS spots FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(spots), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN spots IS NULL THEN w ELSE [x FOR x, k IN w IF NOT list_contains(spots, k)] END, ' ')) AS kept_sha256
FROM docs LEFT JOIN gone USING (doc_id)
"""


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, radius=4)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find(read(spark, sf_dir, "documents"), ["doc_id"]))


def op6_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_edits(read(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(read(spark, sf_dir, "pages"), revisit_bytes=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda b:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (5 * g + 1)::INT, 5))::BIGINT >> b) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM d
"""


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), ["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_personal_data": op2_personal_data,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_simhash": op4_simhash,
        "op5_secrets": op5_secrets,
        "op6_syncmers": op6_syncmers,
        "op7_warc": op7_warc,
        "op8_url_filter": op8_url_filter,
        "op9_mixing": op9_mixing,
        "op10_decontamination": op10_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": OP3_SQL, "op7_warc": OP7_SQL, "op9_mixing": mixing.sql()}
