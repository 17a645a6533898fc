"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

A stage is a function of (spark, docs, sf_dir). All but the last return documents with the columns they were given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spindlewatch.llm import decontamination, pii, rules, sentences, simhash
from spindlewatch.llm.parameters import PSEUDONYM_KEY, tokenizer
from spindlewatch.shared import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return rules.judged(spark, docs).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at 2 or fewer differing SimHash bits, the one with the smallest doc_id."""
    return simhash.keep_one(spark, docs, shingle=3, most=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark."""
    return decontamination.clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with pseudonyms for personal data; n_chars follows the text."""
    return pii.pseudonymised(docs, PSEUDONYM_KEY).select("row.*")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    return sentences.encoded(docs, tokenizer("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("pii", pseudonymise),
    ("sentencepiece", tokenise),
]

# Fingerprints, templates, keyed permutations and merges have no SQL: tests/llm/test_pipeline.py holds run() against
# brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
