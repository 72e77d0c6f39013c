"""Entities: from tokens to spans, their clean-up, and their reconciliation with matches. A model is a provider: a function
on pandas batches that yields token or entity rows; without one there are no entities."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from inkveil.functions.text import blank_tables
from inkveil.operators.chunks import chunk_windows
from inkveil.operators.spans import blank_ranges, greatest_before, let, meets

ENTITY = "array<struct<label:string,start:int,end:int,score:double>>"
#: Labels whose tokens join over a few blanks; others must touch.
SOFT, SOFT_GAP = ("LC", "OG", "DT"), 8


class NerProvider(Protocol):
    """Yields (doc_id, label, start, end, score) rows for batches of (doc_id, text)."""

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]: ...


def no_entities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The provider where there is no model."""
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[:0], "label": [], "start": [], "end": [], "score": []}).astype({"label": str, "start": "int32", "end": "int32", "score": float})


def dictionary(entries: dict[str, str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A provider that finds the words of a dictionary (word to label); for tests and for known names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        rx = re.compile("|".join(sorted(map(re.escape, entries), key=len, reverse=True)) or r"(?!)")
        for batch in batches:
            rows = [(d, entries[m.group()], m.start(), m.end(), 1.0) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for m in rx.finditer(t or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "label", "start", "end", "score"])

    return run


def run(documents: DataFrame, provider: NerProvider = no_entities) -> DataFrame:
    return documents.select("doc_id", "text").mapInPandas(provider, "doc_id long, label string, start int, end int, score double")


def recognise(documents: DataFrame, provider: NerProvider = no_entities, exclude: str | None = None, without_tables: bool = False, size: int = 1500, overlap: int = 200, labels: list[str] | None = None, gap: int = 0) -> DataFrame:
    """(doc_id, entities): a provider's entities of (doc_id, text): ranges to leave out (a column of structs start, end) and, if
    asked for, table lines are blanked; the text goes in chunks that overlap; labels lose their prefixes; an entity is clipped to
    its chunk, and of a label's overlapping ones in a chunk the first stays; those of all chunks merge, sorted. One shuffle, by
    document; a provider sees batches of (doc_id, text) whose doc_id is a number of the chunk."""
    text = F.coalesce(F.col("text"), F.lit(""))
    if exclude:
        text = blank_ranges(text, F.col(exclude))
    if without_tables:
        text = blank_tables(text)
    chunks = chunk_windows(documents.select("doc_id", text.alias("text")), ["doc_id"], size=size, overlap=overlap)

    def of_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = pd.DataFrame({"doc_id": range(len(batch)), "text": batch["text"]})
            for found in provider(iter([asked])):
                at = found["doc_id"].astype(int).to_numpy()
                yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[at], "chunk": batch["chunk"].to_numpy()[at], "begin": batch["start"].to_numpy()[at], "n": batch["text"].str.len().to_numpy()[at], "label": found["label"].to_numpy(), "start": found["start"].to_numpy(), "end": found["end"].to_numpy(), "score": found["score"].to_numpy()})

    kind = dict(documents.select("doc_id").dtypes)["doc_id"]
    raw = chunks.mapInPandas(of_chunks, f"doc_id {kind}, chunk int, begin int, n int, label string, start int, end int, score double")
    label = normal_label(F.col("label"))
    own = raw.select("doc_id", "chunk", label.alias("label"), F.greatest(F.lit(0), F.least(F.col("n"), F.col("start"))).alias("s"), F.greatest(F.lit(0), F.least(F.col("n"), F.col("end"))).alias("e"), "begin", "score")
    own = own.where((F.col("e") > F.col("s")) & (F.col("label") != "") & (F.col("label").isin(*[x.upper() for x in labels]) if labels else F.lit(True)))
    one = F.struct((F.col("begin") + F.col("s")).alias("start"), (F.col("begin") + F.col("e")).alias("end"), "label", "score")
    lists = own.groupBy("doc_id", "chunk").agg(F.sort_array(F.collect_list(one)).alias("x"))
    plain = F.transform("x", lambda x: F.struct(x["label"].alias("label"), x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["score"].cast("double").alias("score")))
    docs = lists.select("doc_id", first_wins(plain).alias("x")).groupBy("doc_id").agg(F.flatten(F.collect_list("x")).alias("x"))
    ordered = F.transform(F.sort_array(F.transform(merge(F.col("x"), gap), lambda x: F.struct(x["start"], x["end"], x.alias("x")))), lambda k: k["x"])
    return docs.select("doc_id", ordered.alias("entities"))


def label_distribution(entities: DataFrame, most: int = 12) -> DataFrame:
    """The most frequent labels and how often each occurs; ties by label."""
    return entities.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(most)


def within_text(entities: Column, text: Column) -> Column:
    """Entities clipped to their text, those that hold nothing but white space left out."""
    n = F.length(text)
    clipped = F.transform(entities, lambda x: F.struct(x["label"].alias("label"), F.greatest(F.lit(0), F.least(n, x["start"])).cast("int").alias("start"), F.greatest(F.lit(0), F.least(n, x["end"])).cast("int").alias("end"), x["score"].alias("score")))
    return F.filter(clipped, lambda x: (x["end"] > x["start"]) & F.substring(text, x["start"] + 1, x["end"] - x["start"]).rlike(r"\S"))


def normal_label(label: Column) -> Column:
    """Without the prefix of a tagging scheme, upper-case."""
    return F.upper(F.regexp_replace(F.coalesce(label, F.lit("")), r"(?i)^[BIES][-_]", ""))


def token_spans(tokens: DataFrame, keys: list[str], text_col: str = "text", threshold: float = 0.0, labels: list[str] | None = None, soft_gap: int = SOFT_GAP) -> DataFrame:
    """(keys, label, start, end, score): runs of tokens (keys, tok, label, start, end, score, text of the document). Other
    tokens (label O, too low a score, a label not asked for) end a run; so does a gap: of more than
    soft_gap blanks, or of anything else, for SOFT labels, of any characters for others."""
    label = normal_label(F.col("label"))
    out = (label == "O") | (label == "") | (F.col("score") < threshold) | (~label.isin(*labels) if labels else F.lit(False))
    w = W.partitionBy(*keys).orderBy("tok")
    t = tokens.where(F.col("end") > F.col("start")).withColumn("_l", label).withColumn("_out", out)
    t = t.withColumn("_pl", F.lag("_l").over(w)).withColumn("_po", F.lag("_out").over(w))
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    t = t.withColumn("_pe", reach)
    gap = F.substring(F.col(text_col), F.col("_pe") + 1, F.col("start") - F.col("_pe"))
    near = (F.col("start") <= F.col("_pe")) | (F.col("_l").isin(*SOFT) & (F.col("start") - F.col("_pe") <= soft_gap) & gap.rlike(r"^[ \t]*$"))
    new = F.col("_pl").isNull() | F.col("_po") | (F.col("_l") != F.col("_pl")) | ~near
    t = t.where(~F.col("_out") | F.lit(True)).withColumn("_run", F.sum(F.when(F.coalesce(new, F.lit(True)) | F.col("_out"), 1).otherwise(0)).over(w))
    found = t.where(~F.col("_out")).groupBy(*keys, "_run").agg(F.first("_l").alias("label"), F.min("start").alias("start"), F.max("end").alias("end"), F.avg("score").alias("score"))
    return found.drop("_run")


def merge(entities: Column, gap: int = 0) -> Column:
    """Entities of a label that overlap, touch or lie within the gap become one; scores are means weighted by length, in
    order: each joins the merged one so far with that one's length."""
    length = lambda x: F.greatest(F.lit(1), x["end"] - x["start"])
    as_entity = lambda x: F.struct(x["label"].alias("label"), x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["score"].cast("double").alias("score"))

    def joined(a: Column, x: Column) -> Column:
        score = (a["score"] * length(a) + x["score"] * length(x)) / (length(a) + length(x))
        return F.struct(x["label"].alias("label"), F.coalesce(a["start"], x["start"]).alias("start"), F.greatest(F.coalesce(a["end"], x["end"]), x["end"]).alias("end"), F.coalesce(score, x["score"]).alias("score"))

    def of_label(own: Column) -> Column:
        reach = greatest_before(F.transform(own, lambda x: x["end"]))

        def islands(r: Column) -> Column:
            firsts = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: (i == 0) | (F.get(own, i)["start"] > F.get(r, i) + gap))
            cut = lambda f: F.transform(f, lambda i, k: F.slice(own, i + 1, F.coalesce(F.get(f, k + 1), F.size(own)) - i))
            none = F.lit(None).cast("struct<label:string,start:int,end:int,score:double>")
            return let(firsts, lambda f: F.transform(cut(f), lambda isle: F.aggregate(isle, none, joined)))

        return let(reach, islands)

    ordered = F.sort_array(F.transform(entities, as_entity))
    kinds = F.array_distinct(F.transform(ordered, lambda x: x["label"]))
    each = lambda every: F.flatten(F.transform(kinds, lambda k: of_label(F.filter(every, lambda x: x["label"].eqNullSafe(k)))))
    return F.when(F.size(entities) == 0, F.array().cast(ENTITY)).otherwise(let(ordered, each))


def first_wins(entities: Column) -> Column:
    """Of a label's overlapping entities the first in the list stays."""
    step = lambda acc, x: F.when(F.exists(acc, lambda y: (y["label"] == x["label"]) & (x["start"] < y["end"]) & (y["start"] < x["end"])), acc).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(entities, F.array().cast(ENTITY), step)


def beside_matches(entities: Column, matches: Column) -> Column:
    """Entities that overlap no match, nor an entity that was kept before. Matches are met in a sweep; entities, of which there are few
    beside each other, one by one in their order."""
    entry = lambda x, i, e: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), i.alias("i"), e.alias("e"))
    none = F.lit(None).cast("struct<label:string,start:int,end:int,score:double>")
    plain = lambda x: F.struct(x["label"].alias("label"), x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["score"].cast("double").alias("score"))
    both = F.concat(F.transform(entities, lambda x, i: entry(x, i, plain(x))), F.transform(matches, lambda m: entry(m, F.lit(-1), none)))
    beside = lambda own: let(meets(own, lambda x: x["i"] < 0), lambda hit: F.sort_array(F.transform(F.filter(own, lambda x, k: (x["i"] >= 0) & ~F.get(hit, k)), lambda x: F.struct(x["i"].alias("i"), x["e"].alias("e")))))
    free = F.transform(let(F.sort_array(both), beside), lambda x: x["e"])
    step = lambda acc, x: F.when(F.exists(acc, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])), acc).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(free, F.array().cast(ENTITY), step)


def split_persons(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Persons (keys, label, start, end, score, text) split at blanks and commas, numbers left out; other labels stay."""
    person = (F.col("label") == "PS") & (F.col("end") > F.col("start"))
    part = F.substring(F.col(text_col), F.col("start") + 1, F.col("end") - F.col("start"))
    gaps, words = F.split(part, r"[^\s,]+", -1), F.regexp_extract_all(part, F.lit(r"[^\s,]+"), F.lit(0))
    a = df.withColumn("_g", gaps).withColumn("_w", F.when(person, words).otherwise(F.array().cast("array<string>")))
    whole = a.where(F.size("_w") == 0).select(*keys, "label", "start", "end", "score")
    each = a.where(F.size("_w") > 0).select("*", F.posexplode("_w").alias("_i", "_word"))
    before = F.aggregate(F.slice("_w", F.lit(1), F.col("_i")), F.lit(0), lambda acc, x: acc + F.length(x)) + F.aggregate(F.slice("_g", F.lit(1), F.col("_i") + 1), F.lit(0), lambda acc, x: acc + F.length(x))
    at = F.col("start") + before
    parts = each.where(~F.col("_word").rlike("^[0-9]+$")).select(*keys, "label", at.alias("start"), (at + F.length("_word")).alias("end"), "score")
    return whole.unionByName(parts)


def merge_parentheses(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """A place followed by another one in parentheses becomes one, with the closing one; pairs from the left, not chains."""
    w = W.partitionBy(*keys).orderBy("start", "end")
    nxt = lambda c: F.lead(c).over(w)
    a = df.withColumn("_l", nxt("label")).withColumn("_s", nxt("start")).withColumn("_e", nxt("end")).withColumn("_c", nxt("score"))
    gap = F.substring(F.col(text_col), F.col("end") + 1, F.col("_s") - F.col("end"))
    joins = (F.col("label") == "LC") & (F.col("_l") == "LC") & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("_s")) & (F.col("_s") < F.col("_e")) & gap.rlike(r"^\s*\(\s*$")
    a = a.withColumn("_j", F.coalesce(joins, F.lit(False)))
    # within a chain of joining neighbours every other one starts a pair
    a = a.withColumn("_n", F.row_number().over(w)).withColumn("_stop", F.max(F.when(~F.col("_j"), F.col("_n"))).over(w.rowsBetween(W.unboundedPreceding, -1)))
    a = a.withColumn("_takes", F.col("_j") & (F.pmod(F.col("_n") - F.coalesce("_stop", F.lit(0)), F.lit(2)) == 1)).withColumn("_taken", F.coalesce(F.lag("_takes").over(w), F.lit(False)))
    closing = F.when(F.substring(F.col(text_col), F.col("_e") + 1, F.lit(1)) == ")", F.col("_e") + 1).otherwise(F.col("_e"))
    n, m = F.greatest(F.lit(1), F.col("end") - F.col("start")), F.greatest(F.lit(1), F.col("_e") - F.col("_s"))
    score = (F.col("score") * n + F.col("_c") * m) / (n + m)
    return a.where(~F.col("_taken")).select(*keys, "label", "start", F.when(F.col("_takes"), closing).otherwise(F.col("end")).alias("end"), F.when(F.col("_takes"), score).otherwise(F.col("score")).alias("score"))


def widen_persons(df: DataFrame, text_col: str = "text", most: int = 12) -> DataFrame:
    """Persons grow over the Hangul next to them while they are no longer than the limit."""
    t = F.col(text_col)
    left = F.length(F.regexp_extract(F.substring(t, F.lit(1), F.col("start")), "[가-힣]*$", 0))
    right = F.length(F.regexp_extract(F.substring(t, F.col("end") + 1, F.length(t)), "^[가-힣]*", 0))
    a, b = F.col("start") - left, F.col("end") + right
    fits = (F.col("label") == "PS") & (b - a <= most)
    return df.withColumns({"start": F.when(fits, a).otherwise(F.col("start")), "end": F.when(fits, b).otherwise(F.col("end"))})


def metrics(gold: DataFrame, pred: DataFrame, key: str = "doc_id") -> DataFrame:
    """Exact agreement of spans (key, label, start, end), by label: counts, precision, recall, F1."""
    on = [key, "label", "start", "end"]
    both = gold.select(*on).distinct().withColumn("_g", F.lit(1)).join(pred.select(*on).distinct().withColumn("_p", F.lit(1)), on, "full_outer")
    c = both.groupBy("label").agg(F.count_if((F.col("_g") == 1) & (F.col("_p") == 1)).alias("tp"), F.count_if(F.col("_g").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))
    rate = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    return c.withColumn("precision", rate(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", rate(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("f1", rate(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
