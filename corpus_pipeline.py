"""A corpus pipeline over documents: each stage applies one operator to all rows that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagerefine.llm._common import documents, stored
from pagerefine.llm.bpe import bpe_round_trip
from pagerefine.llm.decontamination import clean_documents
from pagerefine.llm.jaccard_join import keep_one_of_each
from pagerefine.llm.language_id import fit_profiles, held_out, keep_identified
from pagerefine.llm.queries import byte_bpe
from pagerefine.llm.secrets import redact_secrets


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn the languages from the documents that aren't held out; documents that no learned language fits go."""
    return keep_identified(docs, fit_profiles(docs.where(~held_out(docs["doc_id"]))))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by five-word shingles with a similarity of 0.8 or more."""
    return keep_one_of_each(docs, width=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; no document goes."""
    return redact_secrets(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode every kept text; return its id, token count and digests."""
    return bpe_round_trip(docs, byte_bpe())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("bpe", encode_stage),
]
#: SQL can't express language profiles or byte-pair merges; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each stored as Parquet in the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
