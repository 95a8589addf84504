"""The queries of the training-data operators, each over its whole table, and SQL where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ._common import documents
from .bpe import bpe_round_trip
from .decontamination import ORACLE as DECONTAMINATION_ORACLE
from .decontamination import decontaminate
from .jaccard_join import ORACLE as JACCARD_ORACLE
from .jaccard_join import similar_groups
from .language_id import identify_languages
from .licenses import scan_licenses
from .quality_rules import ORACLE as QUALITY_ORACLE
from .quality_rules import quality_rules
from .secrets import ORACLE as SECRETS_ORACLE
from .secrets import scan_secrets
from .substring_dedup import repeated_passages
from .token_counts import token_counts
from .warc import archive_round_trip


def byte_bpe() -> str:
    """Place of the byte-level vocabulary; driver and executors have it installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(documents(spark, sf_dir))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_groups(documents(spark, sf_dir), width=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(documents(spark, sf_dir), byte_bpe())


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), byte_bpe())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_license_scan": op3_license_scan,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_secrets": op5_secrets,
    "op6_bpe": op6_bpe,
    "op7_token_counts": op7_token_counts,
    "op8_quality_rules": op8_quality_rules,
    "op9_decontamination": op9_decontamination,
    "op10_warc": op10_warc,
}
ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard": JACCARD_ORACLE,
    "op5_secrets": SECRETS_ORACLE,
    "op8_quality_rules": QUALITY_ORACLE,
    "op9_decontamination": DECONTAMINATION_ORACLE,
    "op10_warc": """
        WITH payloads AS (SELECT page_id, encode(coalesce(html, '')) AS p FROM pages),
        hashed AS (SELECT page_id, octet_length(p) AS payload_bytes, sha1(p) AS h, min(page_id) OVER (PARTITION BY p) AS first FROM payloads)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
                   (CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM hashed""",
}
