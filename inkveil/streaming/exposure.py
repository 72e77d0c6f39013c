"""Matching over streams. Spans are found in the row of their document, so the stream keeps no state for them; counts by
window keep a row for each open window and rule, closed by the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.operators import spans


def match_stream(documents: DataFrame, text_col: str = "text", rules: list[str] | None = None) -> DataFrame:
    """Matches of a stream of documents, as of a table."""
    return spans.match(documents, text_col, rules)


def counts_by_window(matches: DataFrame, time_col: str, window: str = "1 hour", late: str = "10 minutes", spans_col: str = "matches") -> DataFrame:
    """(start, rule, n, n_ok) of matches by event time; rows later than the watermark are left out."""
    rows = matches.withWatermark(time_col, late).select(time_col, F.inline(spans_col))
    counts = rows.groupBy(F.window(time_col, window).alias("w"), "rule").agg(F.count("*").alias("n"), F.count_if("valid").alias("n_ok"))
    return counts.select(F.col("w.start").alias("start"), "rule", "n", "n_ok")
