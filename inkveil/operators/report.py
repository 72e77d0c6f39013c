"""Reports over matches: counts, totals, exposure. Input rows: (key, rule, s, e, value, valid, fail_reason), one a match.

Every one is a grouped aggregation with partial sums; a corpus needs one shuffle of a row for each rule and task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.operators.spans import covered, rule_label, union_ranges

# Kinds by what the rule's name contains, the first that fits.
KINDS = [("rrn", "id"), ("fgn", "id"), ("passport", "id"), ("driver", "id"), ("card", "card"), ("email", "email"), ("phone", "phone")]


def kind(rule: Column) -> Column:
    out = F.lit("other")
    for part, name in reversed(KINDS):
        out = F.when(F.lower(rule).contains(part), F.lit(name)).otherwise(out)
    return out


def rule_counts(matches: DataFrame) -> DataFrame:
    """By rule: all matches, valid ones, and those that failed."""
    return matches.groupBy("rule").agg(F.count("*").alias("n"), F.count_if("valid").alias("n_ok"), F.count_if(~F.col("valid")).alias("n_fail"))


def kind_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy(kind(F.col("rule")).alias("kind"), rule_label(F.col("rule")).alias("label")).agg(F.count("*").alias("n"), F.count_if("valid").alias("n_ok"))


def reason_counts(matches: DataFrame) -> DataFrame:
    return matches.where(~F.col("valid")).groupBy(F.concat(kind(F.col("rule")), F.lit(": "), F.coalesce("fail_reason", F.lit("?"))).alias("reason")).agg(F.count("*").alias("n"))


def totals(matches: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """One row: matches, valid, failed, and the mean score of entities to two decimals."""
    out = matches.agg(F.count("*").alias("n"), F.count_if("valid").alias("n_ok"), F.count_if(~F.col("valid")).alias("n_fail"))
    return out if entities is None else out.join(entities.agg(F.round(F.avg("score"), 2).alias("mean_score")))


def _share(df: DataFrame) -> DataFrame:
    share = F.when(F.col("total_chars") > 0, F.col("exposed_chars") * 100 / F.col("total_chars")).otherwise(0.0)
    return df.withColumn("exposure", F.round(share, 6))


def exposure(documents: DataFrame, matches: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """By document: characters under valid matches (rows), each once, of all, and their share in per cent. documents: the
    corpus itself, not what the matches were made in, which would be made once more."""
    merged = union_ranges(matches.where("valid").select(key, "s", "e"), [key], "s", "e")
    sizes = documents.select(key, F.length(F.coalesce(text_col, F.lit(""))).alias("total_chars"))
    part = F.when(F.col("e").isNotNull(), F.greatest(F.lit(0), F.least(F.col("e"), F.col("total_chars")) - F.greatest(F.col("s"), F.lit(0))))
    return _share(sizes.join(merged, key, "left").groupBy(key, "total_chars").agg(F.coalesce(F.sum(part), F.lit(0)).cast("long").alias("exposed_chars")))


def exposure_of(df: DataFrame, keys: list[str], text_col: str = "text", matches: str = "matches") -> DataFrame:
    """The same in the row of a document with its list of matches: no shuffle."""
    n = F.length(F.coalesce(text_col, F.lit("")))
    exposed = covered(F.filter(matches, lambda x: x["valid"]), n)
    return _share(df.select(*keys, n.alias("total_chars"), exposed.alias("exposed_chars")))


def overlap_rate(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """By document: spans, merged ranges, and how many per cent of spans merge away, 0 to 100."""
    raw = matches.groupBy(key).agg(F.count("*").alias("n_raw"))
    merged = union_ranges(matches.select(key, "s", "e"), [key], "s", "e").groupBy(key).agg(F.count("*").alias("n_merged"))
    rate = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.col("n_raw") - F.col("n_merged")) * 100 / F.col("n_raw")))
    return raw.join(merged, key).withColumn("overlap_rate", F.round(rate, 6))
