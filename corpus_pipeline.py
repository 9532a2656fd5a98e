"""A corpus pipeline: language ID, line dedup, near-duplicates, mixing to target weights, tokens.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns the columns of
documents; the last returns token counts and digests. No stage can be put in SQL as a whole (profiles, sampling,
rounding and merges are not expressible), so ORACLE_SQL is None and tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segue.llm import bpe, language_id, line_dedup, minhash, mixing
from segue.llm.common import written
from segue.llm.queries import learned_limits, learned_profiles, vocabulary_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters, and those unlike the profile of any language."""
    learned = learned_profiles(docs)
    return language_id.accepted(docs, learned, limits=learned_limits(docs, learned))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every line of repeated multi-line passages from texts; documents stay, n_chars follows."""
    shorter = line_dedup.without_passages(docs)
    return shorter.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return minhash.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every document as often as its source's target asks for."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of the mix."""
    return bpe.digests(docs, vocabulary_path())


STAGES = [("language ID", language), ("line dedup", lines), ("near-duplicates", near_duplicates), ("mixing", mix), ("tokens", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each result but the last written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
