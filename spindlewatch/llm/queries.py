"""The operators as queries over the shared tables, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from spindlewatch.llm import (
    collocations,
    conversations,
    decontamination,
    languages,
    pii,
    quality,
    rules,
    sentences,
    sharding,
    simhash,
    substrings,
    token_files,
    warc,
)
from spindlewatch.llm.parameters import PSEUDONYM_KEY, tokenizer

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 20-word windows that begin earlier."""
    found = substrings.without_repeats(spark, _table(spark, sf_dir, "documents"), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of the rule cascade for every document."""
    found = rules.judged(spark, _table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", *_COUNTS, "base_failed", "kept")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learnt from the labels that are not held out."""
    return quality.classified(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document whether it holds benchmark items, and the numbers of those items."""
    found = decontamination.judged(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", F.array_join("items", ",").alias("items"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by jump consistent hashing of doc_id."""
    return sharding.sharded(spark, _table(spark, sf_dir, "documents"), shards=16)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back from the archives."""
    return warc.read_archives(spark, warc.write_archives(spark, _table(spark, sf_dir, "pages")))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, read back from Simple-8b files."""
    files = token_files.write_tokens(spark, _table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end=2)
    return token_files.read_tokens(files).drop("ids")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms for its personal data, and how many values there were."""
    found = pii.pseudonymised(_table(spark, sf_dir, "documents"), PSEUDONYM_KEY)
    return found.select("row.doc_id", "row.text", F.size("found").alias("n_values"), F.col("found.kind").alias("kinds"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    return sentences.encoded(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 3-word shingles, links at 2 or fewer bits."""
    found = simhash.near_duplicates(spark, _table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged, with its faults, its cheapest repair and a digest of the repaired turns."""
    rows = conversations.damaged(_table(spark, sf_dir, "conversations"))
    return conversations.summaries(conversations.repaired(spark, rows))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of two to four words of each language."""
    return collocations.collocations(spark, _table(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learnt from those that are not held out."""
    return languages.identified(spark, _table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_decontamination": op4_decontamination,
    "op5_sharding": op5_sharding,
    "op6_warc": op6_warc,
    "op7_token_files": op7_token_files,
    "op8_pii": op8_pii,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_simhash": op10_simhash,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_collocations": op12_collocations,
    "op13_language_id": op13_language_id,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op2_quality_rules": rules.ORACLE.replace("@columns", f"doc_id, {', '.join(_COUNTS)}, base_failed, {rules.KEPT} AS kept"),
    "op12_collocations": collocations.ORACLE,
}
