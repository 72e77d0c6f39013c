"""Token counts from an exact length histogram.

Documents are encoded (see ``bpe``), aggregated by their encoded length, and the suffix sums of that histogram answer,
for every context limit at once: how many documents and tokens exceed it, what a cut at the limit keeps, and which
quantile the limit is. The histogram has a row for each distinct length, however many documents there are. Sums run
over blocks of lengths, and over the totals of blocks, so no task gets more than a block.

Defined results: a null or empty text has length 0; an empty table gives no rows; repeated rows count each time; very
long texts are encoded whole; texts of equal length share a row, so there are no ties; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from inkveil.llm.bpe import encode
from inkveil.llm.common import stored

#: Lengths of a block.
BLOCK = 4096


def length_histogram(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs): one row for each encoded length that occurs."""
    texts = df.select(F.col(f"`{text_col}`").alias("_text"))
    lengths = encode(texts, ranks_path, pattern, "_text", "_ids").select(F.size("_ids").cast("long").alias("n_tokens"))
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """For every length that occurs, taken as a limit: documents and tokens up to it and beyond it, the tokens that a
    cut at the limit keeps and loses, and the share of documents that fit whole."""
    histogram = stored(histogram, "lengths")  # read twice below: the texts are encoded once
    rows = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("_t"), F.floor(F.col("n_tokens") / BLOCK).alias("_b"))
    later = W.orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)  # over blocks of lengths: one row each
    blocks = rows.groupBy("_b").agg(F.sum("n_docs").alias("_bd"), F.sum("_t").alias("_bt"))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    blocks = blocks.select("_b", F.coalesce(F.sum("_bd").over(later), F.lit(0)).alias("_ld"), F.coalesce(F.sum("_bt").over(later), F.lit(0)).alias("_lt"), F.sum("_bd").over(everything).alias("total_docs"), F.sum("_bt").over(everything).alias("total_tokens"))
    longer = W.partitionBy("_b").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, -1)
    out = rows.join(blocks, "_b")  # blocks: a row for each block of lengths
    out = out.withColumn("docs_longer", F.coalesce(F.sum("n_docs").over(longer), F.lit(0)) + F.col("_ld")).withColumn("tokens_longer", F.coalesce(F.sum("_t").over(longer), F.lit(0)) + F.col("_lt"))
    kept = F.col("total_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")
    return out.select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        (F.col("total_docs") - F.col("docs_longer")).alias("docs_fit"),
        "docs_longer",
        (F.col("total_tokens") - F.col("tokens_longer")).alias("tokens_fit"),
        "tokens_longer",
        kept.alias("truncated_total"),
        (F.col("total_tokens") - kept).alias("tokens_lost"),
        "total_docs",
        "total_tokens",
        ((F.col("total_docs") - F.col("docs_longer")) / F.col("total_docs")).alias("quantile"),
    )


def quantile(limits: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least the share q of the documents doesn't exceed."""
    return limits.where(F.col("docs_fit") >= F.lit(q) * F.col("total_docs")).agg(F.min("context_limit").alias("n_tokens"))
