"""From a token classifier's numbers to entities: windows of tokens that overlap, chances by temperature, runs of tokens, and what
is merged, split and left out after. The classifier itself is a provider's; a row is a token (keys, start, end, logits)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from inkveil.operators import entities
from inkveil.operators.spans import let


# Settings and what they are without one; their names in the environment begin with NER_.
@dataclass(frozen=True)
class Settings:
    max_length: int = 384
    stride: int = 64
    batch_size: int = 8
    merge_gap: int = 0
    score_threshold: float = 0.0
    temperature: float = 3.0
    mask_markdown: bool = True
    soft_gap_max: int = 8
    force_cpu: bool = False

    @classmethod
    def of(cls, environment: Mapping[str, str]) -> Settings:
        """Settings of an environment; a truth value is true if it is 1."""
        given = {f.name: (f.type, environment[f"NER_{f.name.upper()}"]) for f in fields(cls) if f"NER_{f.name.upper()}" in environment}
        return cls(**{name: {"int": int, "float": float, "bool": lambda v: v == "1"}[kind](value) for name, (kind, value) in given.items()})


#: Tokens of a window that aren't the text's.
SPECIAL = 2


def windows(tokens: DataFrame, keys: list[str], max_length: int = 384, stride: int = 64) -> DataFrame:
    """Adds tok (place from 0 in the text) and window: a token is in each window that it belongs to; neighbours share stride tokens."""
    most = max_length - SPECIAL
    step = most - stride
    if step < 1:
        raise ValueError("stride: less than a window")
    every = W.partitionBy(*keys)
    placed = tokens.withColumn("tok", F.row_number().over(every.orderBy("start", "end")) - 1).withColumn("_n", F.count("*").over(every))
    last = F.greatest(F.lit(0), F.ceil((F.col("_n") - most) / step)).cast("int")
    first = F.greatest(F.lit(0), F.ceil((F.col("tok") - most + 1) / step)).cast("int")
    return placed.withColumn("window", F.explode(F.sequence(first, F.least(last, F.floor(F.col("tok") / step).cast("int"))))).drop("_n")


def likeliest(logits: Column, labels: list[str], temperature: float = 3.0) -> Column:
    """struct<label, score>: the label of the greatest number (the first of several), and its chance at a temperature."""
    names = F.array(*[F.lit(x) for x in labels])
    t = max(1e-6, temperature)

    def of(own: Column) -> Column:
        top = F.array_max(own)
        total = F.aggregate(F.transform(own, lambda x: F.exp((x - top) / t)), F.lit(0.0), lambda a, x: a + x)
        return F.struct(F.get(names, F.array_position(own, top).cast("int") - 1).alias("label"), (1 / total).alias("score"))

    return let(logits, of)


def infer(tokens: DataFrame, keys: list[str], labels: list[str], text_col: str = "text", exclude: str | None = None, wanted: list[str] | None = None, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(keys, label, start, end, score) of tokens (keys, start, end, logits, text of the document, and ranges to leave out): by window
    runs of tokens; merged over windows; those that meet a range left out; persons split, places in parentheses joined."""
    seen = windows(tokens, keys, settings.max_length, settings.stride).withColumn("_x", likeliest(F.col("logits"), labels, settings.temperature))
    seen = seen.withColumn("label", F.when(F.col("_x.label") == "LABEL_0", "O").otherwise(F.col("_x.label"))).withColumn("score", F.col("_x.score"))
    runs = entities.token_spans(seen, [*keys, "window"], text_col, settings.score_threshold, wanted, settings.soft_gap_max)
    lists = runs.groupBy(*keys).agg(F.collect_list(F.struct("label", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "score")).alias("_e"))
    docs = tokens.groupBy(*keys).agg(F.first(text_col).alias(text_col), *([F.first(exclude).alias("_out")] if exclude else []))
    merged = lists.join(docs, keys).withColumn("_m", entities.merge(F.col("_e"), settings.merge_gap))
    if exclude:
        merged = merged.withColumn("_m", F.filter("_m", lambda e: ~F.exists("_out", lambda r: (e["start"] < r["end"]) & (r["start"] < e["end"]))))
    each = merged.select(*keys, text_col, F.inline("_m"))
    split = entities.split_persons(each, [*keys, text_col], text_col)
    return entities.merge_parentheses(split, [*keys, text_col], text_col).drop(text_col)
