"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import compression_bands, piece_matching, simhash_pivots, suffix_dedup, winnowing
from terrane.llm._spark import keep, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the base rules or the compression bands reject."""
    return compression_bands.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (four fifths of five-word shingles shared), the one of the least id."""
    return simhash_pivots.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 250 bytes (50 words) and more out that another row holds too; a document of which nothing is left goes.

    Each row stays one row, told apart from others by id and text: rows that share an id, or
    have none, count as texts of their own, and rows equal in both leave each other whole.
    """
    cut = suffix_dedup.remaining_text(docs, suffix_dedup.Suffixes(length=250, elsewhere="row"), carry=True).where(F.length(F.trim("text")) > 0)
    return cut.select(*(F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    return winnowing.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode each document: (doc_id, n_tokens, ids)."""
    return piece_matching.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", tokens),
]

#: Zstandard ratios, XXH64 and piece merging have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
