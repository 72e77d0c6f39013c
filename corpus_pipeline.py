"""A training-data pipeline over documents: each stage takes what its predecessor kept and returns the same columns, but
for the last, which returns the ids of tokens. Between stages the table is written as Parquet and read again.

Defined results: null, empty and short texts fail the quality rules and go in the first stage, so do rows without an id only
if their text does; rows repeated with id and text are near copies of each other, of which one stays; of a tie between near
copies the smallest id stays; very long texts pass every stage whole; an empty table gives no rows; further columns of
documents, whatever their names, pass all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import bpe, decontam, near_dup, pii, quality_rules
from inkveil.llm.common import scratch, stored, table
from inkveil.llm.queries import PATTERN, PII_KEY, RANKS


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and short texts are among them."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document of the smallest id stays."""
    return near_dup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item (0.8 or more of its five-word shingles) go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by surrogates; n_chars follows the text."""
    out = pii.replace(docs, PII_KEY, count_col=None)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's tokens, and whether they decode to the text's bytes."""
    out = bpe.decode(bpe.encode(docs.select("doc_id", "text"), RANKS, PATTERN), RANKS)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("bpe", tokens),
]

#: The label model, near-duplicate components, surrogates and encoding are not for SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch():  # what a stage stored on its way goes when its result is written
            docs = stored(stage(spark, docs, sf_dir), name, outer=True)
    return STAGES[-1][1](spark, docs, sf_dir)
