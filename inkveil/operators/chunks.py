"""Chunks and pages of texts, and what a viewer of detections shows."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W


#: A chunk may end this many characters early, behind a line feed or a blank.
BACK = 80
#: A page is cut at an empty line, or a line's end, that leaves it so many characters.
EMPTY_LINE, LINE = 600, 300
LEAST_PAGE = 800


def places(text: str, sign: str, behind: bool) -> np.ndarray:
    """Where a sign begins in a text, or where it ends; occurrences may overlap."""
    return np.fromiter((m.end(1) if behind else m.start() for m in re.finditer(f"(?=({re.escape(sign)}))", text)), np.int64)


def latest(choices: list[tuple[np.ndarray, int]], limit: int) -> int:
    """Of the first choice (sorted places, the least that serves) with a place up to the limit, the last such place; else the
    limit itself."""
    for sorted_places, least in choices:
        k = int(np.searchsorted(sorted_places, limit, side="right"))
        if k and sorted_places[k - 1] >= least:
            return int(sorted_places[k - 1])
    return limit


def chunk_bounds(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Chunks of a text for a model: each ends behind a line feed, else a blank, of its last BACK characters if there is one;
    the next one starts the overlap earlier, and at least one character on."""
    size, overlap = max(size, 1), max(overlap, 0)
    kinds = [places(text, sign, behind=True) for sign in ("\n", " ")]
    begins, ends = [0], []
    while (limit := begins[-1] + size) < len(text):
        ends.append(latest([(own, max(begins[-1], limit - BACK) + 1) for own in kinds], limit))
        begins.append(max(begins[-1] + 1, ends[-1] - overlap))
    return list(zip(begins, [*ends, len(text)], strict=True)) if text else []


def chunk_windows(df: DataFrame, keys: list[str], text_col: str = "text", size: int = 1500, overlap: int = 200) -> DataFrame:
    """(keys, chunk, start, end, text): a row for each chunk, to spread a model's work."""

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
    def bounds(texts: pa.Array) -> pa.Array:
        rows = [[{"start": a, "end": b} for a, b in chunk_bounds(t or "", size, overlap)] for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    each = df.select(*keys, F.col(text_col).alias("_t"), F.posexplode(bounds(F.col(text_col))).alias("chunk", "_b"))
    return each.select(*keys, "chunk", F.col("_b.start").alias("start"), F.col("_b.end").alias("end"), F.substring("_t", F.col("_b.start") + 1, F.col("_b.end") - F.col("_b.start")).alias("text"))


def page_bounds(text: str, most: int) -> list[tuple[int, int]]:
    """Pages of a text: cut at the last empty line that leaves EMPTY_LINE characters, else at the last line end that leaves LINE,
    else at the most."""
    most = max(most, LEAST_PAGE)
    empty, line = places(text, "\n\n", behind=False), places(text, "\n", behind=False)
    cuts = [0]
    while len(text) - cuts[-1] > most:
        cuts.append(latest([(empty, cuts[-1] + EMPTY_LINE), (line, cuts[-1] + LINE)], cuts[-1] + most))
    return list(zip(cuts, [*cuts[1:], len(text)], strict=True))


def pages(df: DataFrame, keys: list[str], text_col: str = "text", most: int = 3200) -> DataFrame:
    """(keys, page, text): blank pages left out, but for a text that is blank as a whole, which is one empty page."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def split(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            t = (t or "").replace("\r\n", "\n")
            own = page_bounds(t, most)
            parts = [t[a:b].rstrip() if b < len(t) else t[a:b] for a, b in own]
            out.append([""] if not t.strip() else [p for p in parts if p.strip()] if len(own) > 1 else parts)
        return pa.array(out, pa.list_(pa.string()))

    return df.select(*keys, F.posexplode(split(F.col(text_col))).alias("page", "text"))


# What may stand between two characters of a needle in a page's text, twice at most, and how many characters such
# gaps may hold in all.
_GAP = "(?:[\\s\u200b\u200c\u200d\ufeff]{0,2}|__TAG_[0-9]+__){0,2}"
LEAST_GAP, MOST_GAP, GAP_SHARE = 6, 24, 0.6


def _place(hay: str, needle: str, taken: list[tuple[int, int]]) -> tuple[int, int] | None:
    """The first free place of a needle, as it is if it occurs from there on, else (four characters or more) with gaps."""
    loose = re.compile(_GAP.join(map(re.escape, needle)) if len(needle) >= 4 else r"(?!)")
    most = len(needle) + min(MOST_GAP, max(LEAST_GAP, int(len(needle) * GAP_SHARE)))
    at = 0
    while True:
        first = hay.find(needle, at)
        m = None if first >= 0 else loose.search(hay, at)
        if first < 0 and (m is None or len(m.group()) > most):
            return None
        a, b = (first, first + len(needle)) if first >= 0 else m.span()
        if all(b <= x or y <= a for x, y in taken):
            return a, b
        at = a + 1


def place_needles(text: str, needles: list[dict]) -> list[tuple[int, int, int]]:
    """(number, start, end) of needles (value, source, label, valid) in a text whose tags don't count: valid ones first, then
    matches before entities, then the longest; no two share a character."""
    tags = [m.span() for m in re.finditer("<[^>]+>", text)]
    hay, origin, last = "", [], 0
    for k, (a, b) in enumerate(tags):
        sign = f"__TAG_{k}__"
        hay += text[last:a] + sign
        origin += [*range(last, a), *[a] * len(sign)]
        last = b
    hay += text[last:]
    origin += range(last, len(text) + 1)
    trimmed = [(x["value"] or "").strip() for x in needles]
    order = sorted(range(len(needles)), key=lambda k: (needles[k]["valid"] is False, needles[k]["source"] != "regex", -len(trimmed[k])))
    taken: list[tuple[int, int]] = []
    out = []
    for k in order:
        person = needles[k]["source"] == "ner" and (needles[k]["label"] or "").upper() == "PS"
        if not trimmed[k] or len(trimmed[k]) < 2 and not person or re.fullmatch("[A-Za-z]", trimmed[k]):
            continue
        if (place := _place(hay, trimmed[k], taken)) is not None:
            taken.append(place)
            out.append((k, origin[place[0]], origin[place[1] - 1] + 1))
    return out


def needles(df: DataFrame, keys: list[str], text_col: str = "text", needles_col: str = "needles") -> DataFrame:
    """(keys, needle, start, end): where the detections of a page (array of structs value, source, label, valid) stand in it."""
    kind = T.ArrayType(T.StructType([T.StructField("needle", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

    @F.arrow_udf(kind)
    def placed(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        rows = [[dict(zip(("needle", "start", "end"), x, strict=True)) for x in place_needles(t or "", own or [])] for t, own in zip(texts.to_pylist(), wanted.to_pylist(), strict=True)]
        return pa.array(rows, pa.list_(pa.struct([("needle", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])))

    return df.select(*keys, F.inline(placed(F.col(text_col), F.col(needles_col))))


def page_of(spans: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (keys, start, ...) with the page they start on; pages: (keys, page, first) by their offsets. Both in one partition
    of the keys, sorted by offset: the page begun last."""
    both = spans.select(*keys, F.col("start").alias("_at"), F.lit(None).cast("int").alias("_page"), F.struct(*[F.col(c) for c in spans.columns]).alias("_row"))
    marks = pages.select(*keys, F.col("first").alias("_at"), F.col("page").cast("int").alias("_page"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"))
    w = W.partitionBy(*keys).orderBy("_at", F.col("_row").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    found = both.unionByName(marks).withColumn("page", F.last("_page", ignorenulls=True).over(w))
    return found.where("_row is not null and page is not null").select("_row.*", "page")


def needle_page(needles: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Needles (keys, needle) with the first page (keys, page, text) that contains each, as it is, else without white space; null
    where none does. Pages of a document meet its needles; documents spread over the cluster."""
    tight = lambda c: F.regexp_replace(c, r"\s+", "")
    lists = pages.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("_p"))
    first = lambda test: F.get(F.filter("_p", test), F.lit(0))["page"]
    joined = needles.join(lists, keys, "left")
    whole, loose = first(lambda p: F.contains(p["text"], F.col("needle"))), first(lambda p: (tight(F.col("needle")) != "") & F.contains(tight(p["text"]), tight(F.col("needle"))))
    return joined.withColumn("page", F.coalesce(whole, loose)).drop("_p")


def in_page_order(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text) of pages joined in the order of their numbers."""
    lists = pages.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("_p"))
    return lists.select(*keys, F.array_join(F.transform("_p", lambda p: F.coalesce(p["text"], F.lit(""))), "\n\n").alias("text"))


def viewer(detections: DataFrame, keys: list[str]) -> DataFrame:
    """Detections (keys, source, s, e, value, valid) as a viewer shows them: exact duplicates once; entities that overlap a
    valid match left out; of one source's those within another left out. Three window passes over the same partitioning,
    no join within a document."""
    once = detections.dropDuplicates([*keys, "source", "s", "e", "value"])
    lists = once.groupBy(*keys).agg(F.collect_list(F.struct("s", "e", "source", "value", "valid")).alias("_d"))
    matches = F.filter("_d", lambda x: (x["source"] == "regex") & x["valid"])
    free = lists.withColumn("_m", matches).select(*keys, F.inline(F.filter("_d", lambda x: (x["source"] != "ner") | ~F.exists("_m", lambda m: (x["s"] < m["e"]) & (m["s"] < x["e"])))))
    # by (start, longest first) one is contained if an earlier one of its source reaches as far
    w = W.partitionBy(*keys, "source").orderBy("s", F.desc("e"), "value").rowsBetween(W.unboundedPreceding, -1)
    return free.withColumn("_reach", F.max("e").over(w)).where(F.col("_reach").isNull() | (F.col("_reach") < F.col("e"))).drop("_reach")


def replace_overlays(text: Column, overlays: Column) -> Column:
    """Overlays (literal, replacement) put over a cell's text, in their order."""
    return F.aggregate(overlays, text, lambda t, x: F.replace(t, x["literal"], x["replacement"]))
