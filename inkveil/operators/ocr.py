"""What is found in recognised blocks of an image (keys, id, text, x0, y0, x1, y1): lines, values that blocks share, rules by
candidate readings, entities back on blocks, counts. Blocks of an image are few; images spread over the cluster by their keys,
and everything but the grouping by image is expressions in a row. Recognition itself is a provider's."""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from inkveil.functions import text as texts
from inkveil.functions import validators
from inkveil.functions.rules import RULES, Rule, select
from inkveil.operators.geometry import page_text
from inkveil.operators.spans import find, let, sums_before

BOX = ("x0", "y0", "x1", "y1")
# Signs that part words and labels of a block, and how passports look in one.
WORDS, LABELS = "[\\s,;()\\[\\]{}<>\"'“”‘’]+", "[:：=|]+"
PASSPORTS = (r"\b[A-Z][0-9]{7,9}\b", r"\b[A-Z][0-9]{3}[A-Z][0-9]{4}\b")
#: Telephone numbers that a line may give; digit groups after the first that a card number may span; how far below a line the
#: rest of a number may stand.
PHONES, GROUPS, NEXT_LINE = 6, 3, 120.0


#: Confidences that are asked for one after the other until some block has one.
PASSES = (0.30, 0.05, 0.01)
BLOCK = "path string, name string, id int, text string, x0 double, y0 double, x1 double, y1 double, conf double"


class BlocksProvider(Protocol):
    """Yields the blocks of batches of pictures (path, name, content): rows of BLOCK."""

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]: ...


def no_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The provider where there is no recognition."""
    for _ in batches:
        yield pd.DataFrame({c.split()[0]: pd.Series(dtype={"string": str, "int": "int32", "double": float}[c.split()[1]]) for c in BLOCK.split(", ")})


def recognise(pictures: DataFrame, provider: BlocksProvider = no_blocks, passes: tuple[float, ...] = PASSES) -> DataFrame:
    """Blocks of pictures (path, name, content): of each picture those that reach the first of the confidences that any reaches."""
    raw = pictures.select("path", "name", "content").mapInPandas(provider, BLOCK)
    best = F.max("conf").over(W.partitionBy("path", "name"))
    least = F.lit(None).cast("double")
    for own in sorted(passes):
        least = F.when(F.col("_best") >= own, F.lit(own)).otherwise(least)
    return raw.withColumn("_best", best).where(F.col("conf") >= least).drop("_best")


def reading_text(blocks: DataFrame, keys: list[str], least: float = 0.25, tolerance: float = 18.0) -> DataFrame:
    """(keys, text): blocks read with some confidence, line by line."""
    return page_text(confident(blocks, least), keys, tolerance)


def confident(blocks: DataFrame, least: float) -> DataFrame:
    """Blocks that were read with this confidence at least; of unknown confidence none."""
    return blocks.where(F.col("conf") >= least)


def line_numbers(centres: Column, tolerance: float) -> Column:
    """For each of the centres, from top to bottom, its line: the first one whose mean centre so far is within the tolerance,
    else a new one."""
    near = lambda line, y: F.abs(y - line["sum"] / line["n"]) <= tolerance

    def step(acc: Column, y: Column) -> Column:
        place = F.array_position(F.transform(acc["lines"], lambda line: near(line, y)), F.lit(True)).cast("int")
        added = F.transform(acc["lines"], lambda line, i: F.when(i == place - 1, F.struct((line["sum"] + y).alias("sum"), (line["n"] + 1).alias("n"))).otherwise(line))
        opened = F.concat(acc["lines"], F.array(F.struct(y.alias("sum"), F.lit(1).alias("n"))))
        return F.struct(F.when(place > 0, added).otherwise(opened).alias("lines"), F.concat(acc["of"], F.array(F.when(place > 0, place).otherwise(F.size(acc["lines"]) + 1))).alias("of"))

    start = F.struct(F.array().cast("array<struct<sum:double,n:int>>").alias("lines"), F.array().cast("array<int>").alias("of"))
    return F.aggregate(centres, start, step, lambda acc: acc["of"])


def group_lines(blocks: DataFrame, keys: list[str], tolerance: float = 10.0) -> DataFrame:
    """(keys, line, place, id, text, box): lines from 1, places from the left; text normalised and trimmed."""
    middle = lambda a, b: (F.col(a) + F.col(b)).cast("double") / 2
    own = blocks.select(*keys, F.struct(middle("y0", "y1").alias("yc"), middle("x0", "x1").alias("xc"), "id", texts.trim_white(texts.ocr_normalize(F.coalesce("text", F.lit("")))).alias("text"), *BOX).alias("_b"))
    images = own.groupBy(*keys).agg(F.sort_array(F.collect_list("_b")).alias("_b"))
    numbered = images.withColumn("_of", line_numbers(F.transform("_b", lambda b: b["yc"]), tolerance))
    each = numbered.select(*keys, F.inline(F.arrays_zip("_b", "_of"))).select(*keys, F.col("_of").alias("line"), "_b.*").drop("xc")
    place = F.row_number().over(W.partitionBy(*keys, "line").orderBy("x0", "yc", "id"))
    return each.withColumn("place", place).select(*keys, "line", "place", "id", "text", *BOX)


def _lines(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, toks, joined, offs): the blocks of each line, their texts without blanks joined, and where each begins."""
    t = grouped.withColumn("t", F.replace("text", F.lit(" "), F.lit("")))
    lists = t.groupBy(*keys, "line").agg(F.sort_array(F.collect_list(F.struct("place", "t", *BOX))).alias("toks"))
    lists = lists.withColumn("joined", F.array_join(F.transform("toks", lambda x: x["t"]), ""))
    return lists.withColumn("offs", sums_before(F.transform("toks", lambda x: F.length(x["t"]))))


def _union(toks: Column) -> list[Column]:
    side = lambda c, pick: pick(F.transform(toks, lambda x: x[c]))
    return [side("x0", F.array_min).alias("x0"), side("y0", F.array_min).alias("y0"), side("x1", F.array_max).alias("x1"), side("y1", F.array_max).alias("y1")]


def _boxed(lines: DataFrame, keys: list[str], hits: Column) -> DataFrame:
    """(keys, line, kind, value, box) of hits (start, end, kind, value) on the joined text: the box of all blocks under them."""
    each = lines.select(*keys, "line", "toks", "offs", F.inline(hits))
    under = F.filter("toks", lambda x, i: (F.get("offs", i) + F.length(x["t"]) > F.col("start")) & (F.get("offs", i) < F.col("end")))
    found = each.withColumn("_u", under).where(F.size("_u") > 0)
    return found.select(*keys, "line", "kind", "value", *_union(F.col("_u")))


def _hit(x: Column, kind: str | Column) -> Column:
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), x["value"].alias("value"))


def joined_emails(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, kind, value, box): of each line with an @ the first address over its blocks, strict if there is one (and then
    only if it is valid), else relaxed."""
    lines = _lines(grouped, keys).where(F.col("joined").contains("@"))
    strict, relaxed = find(F.col("joined"), RULES["email"].java, "email"), find(F.col("joined"), texts.RELAXED_EMAIL, "email")
    valid = F.filter(F.slice(strict, 1, 1), lambda x: validators.is_email(x["value"]))
    hits = F.when(F.size(strict) > 0, valid).otherwise(F.slice(relaxed, 1, 1))
    return _boxed(lines, keys, F.transform(hits, lambda x: _hit(x, "email")))


def joined_phones(grouped: DataFrame, keys: list[str], as_of: datetime.date = validators.AS_OF) -> DataFrame:
    """(keys, line, kind, value, box): the valid ones of each line's first PHONES telephone numbers over its blocks, from the
    left, the longer first."""
    lines = _lines(grouped, keys).where(F.col("joined").rlike("[0-9]"))
    rules = [RULES["phone_mobile"], RULES["phone_city"]]
    both = F.concat(*[find(F.col("joined"), r.java, r.name) for r in rules])
    keyed = F.sort_array(F.transform(both, lambda x, i: F.struct(x["start"].alias("s"), (x["start"] - x["end"]).alias("n"), i.alias("i"), x.alias("x"))))
    first = F.transform(F.slice(keyed, 1, PHONES), lambda k: k["x"])
    valid = F.filter(first, lambda x: validators.is_valid(x["rule"], x["value"], as_of))
    return _boxed(lines, keys, F.transform(valid, lambda x: _hit(x, x["rule"])))


def joined_cards(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, value, box): card numbers over digit groups: all short ones of a line, up to GROUPS + 1 neighbours, and a line
    with the short groups of the next one. A value may come in more than one way, each with its box."""
    digits = F.regexp_replace("text", "[^0-9]", "")
    n = F.length(digits)
    toks = grouped.withColumn("d", digits).withColumn("yc", (F.col("y0") + F.col("y1")) / 2).where(n.between(2, 4) | n.between(8, 15))
    lines = toks.groupBy(*keys, "line").agg(F.sort_array(F.collect_list(F.struct("place", "d", "yc", *BOX))).alias("toks"))
    text = lambda own, most=15: F.array_join(F.transform(F.filter(own, lambda x: F.length(x["d"]) <= most), lambda x: x["d"]), "")
    whole = lines.select(*keys, "line", text(F.col("toks"), 4).alias("value"), F.col("toks").alias("u"))
    runs = lines.select(*keys, "line", "toks", F.posexplode("toks").alias("i", "_x")).select(*keys, "line", "toks", "i", F.explode(F.lit(list(range(2, GROUPS + 2)))).alias("n"))
    runs = runs.where(F.col("i") + F.col("n") <= F.size("toks")).withColumn("u", F.slice("toks", F.col("i") + 1, F.col("n")))
    runs = runs.select(*keys, "line", text(F.col("u")).alias("value"), "u")
    mean = lambda c: F.aggregate(F.transform(c, lambda x: x["yc"]), F.lit(0.0), lambda a, y: a + y) / F.size(c)
    below = lines.select(*keys, (F.col("line") - 1).alias("line"), F.col("toks").alias("bot"))
    two = lines.join(below, [*keys, "line"]).where((mean(F.col("bot")) - mean(F.col("toks")) <= NEXT_LINE) & (text(F.col("bot"), 6) != ""))
    two = two.select(*keys, "line", F.concat(text(F.col("toks")), text(F.col("bot"), 6)).alias("value"), F.concat("toks", "bot").alias("u"))
    found = whole.unionByName(runs).unionByName(two).where(validators.is_ocr_card(F.col("value")))
    return found.select(*keys, "line", F.lit("card").alias("kind"), "value", *_union(F.col("u")))


def candidate_texts(t: Column, extra: Column | None = None) -> Column:
    """Readings of a block's text to try rules on, in order, each once: itself, a hint, what follows a colon, without blanks, with I
    as 1, its words, its parts between signs, an address as it may be misread, and passports in it."""
    clean = lambda x: texts.trim_white(texts.ocr_normalize(x))
    after = lambda t0, sep: F.when(t0.contains(sep), F.substring(t0, F.instr(t0, sep) + 1, F.length(t0))).otherwise(F.lit(""))

    def all_of(t0: Column) -> Column:
        tight = F.replace(t0, F.lit(" "), F.lit(""))
        single = [t0, F.coalesce(extra, F.lit("")) if extra is not None else F.lit(""), after(t0, ":"), after(t0, "："), tight, F.replace(F.replace(tight, F.lit("|"), F.lit("")), F.lit("I"), F.lit("1"))]
        words, parts = F.split(t0, WORDS), F.split(t0, LABELS)
        passports = [F.regexp_extract_all(tight, F.lit(rx), F.lit(0)) for rx in PASSPORTS]
        every = F.concat(F.array(*single), words, parts, F.array(F.regexp_extract(t0, texts.RELAXED_EMAIL, 0)), *passports)
        return F.array_distinct(F.filter(F.transform(every, clean), lambda x: x != ""))

    return let(clean(F.coalesce(t, F.lit(""))), lambda t0: F.when(t0 == "", F.array().cast("array<string>")).otherwise(all_of(t0)))


def first_rule(candidates: Column, rules: list[Rule] | None = None, as_of: datetime.date = validators.AS_OF) -> Column:
    """struct<rule, value>: of the first candidate that some rule's valid match is in, the first such rule's; null if none."""
    rules = rules if rules is not None else select()
    tried = lambda c: F.array(*[F.struct(F.lit(r.name).alias("rule"), F.regexp_extract(c, r.java, 0).alias("value")) for r in rules])
    every = F.flatten(F.transform(candidates, tried))
    return F.get(F.filter(every, lambda x: (x["value"] != "") & validators.is_valid(x["rule"], x["value"], as_of)), F.lit(0))


def block_text(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, text, start, end, box): where each block's text stands in the image's text, blocks in the order of their ids,
    joined by blanks; blank ones left out."""
    own = blocks.withColumn("text", texts.trim_white(F.coalesce("text", F.lit("")))).where("text <> ''")
    before = F.sum(F.length("text") + 1).over(W.partitionBy(*keys).orderBy("id").rowsBetween(W.unboundedPreceding, -1))
    own = own.withColumn("start", F.coalesce(before, F.lit(0)).cast("int"))
    return own.select(*keys, "id", "text", "start", (F.col("start") + F.length("text")).alias("end"), *BOX)


def entities_on_blocks(spans: DataFrame, blocks: DataFrame, keys: list[str], matched: DataFrame | None = None) -> DataFrame:
    """(keys, label, text, box) of entities (keys, start, end, label, text) of the image's text: each gets the block it overlaps
    whose text equals it, else the one that contains it or is contained to the greatest part, else the first. A box that is
    matched already, or that an earlier entity has, gets none (boxes compare by their corner to a decimal)."""
    b = block_text(blocks, keys).select(*keys, F.col("id").alias("_id"), F.col("text").alias("_t"), F.col("start").alias("_s"), F.col("end").alias("_e"), *BOX)
    e = spans.select(*keys, "label", "start", "end", texts.trim_white(F.coalesce("text", F.lit(""))).alias("text")).where((F.col("text") != "") & (F.col("end") > F.col("start")))
    over = e.join(b, keys).where((F.col("_s") < F.col("end")) & (F.col("start") < F.col("_e")))
    n, m = F.length("text"), F.length("_t")
    share = F.when(F.col("_t").contains(F.col("text")) | F.col("text").contains(F.col("_t")), F.least(n, m) / F.greatest(n, m)).otherwise(0.0)
    best = F.row_number().over(W.partitionBy(*keys, "start", "end", "label", "text").orderBy((F.col("_t") == F.col("text")).desc(), share.desc(), "_s", "_id"))
    corner = [F.round("x0", 1).alias("_cx"), F.round("y0", 1).alias("_cy")]
    one = over.withColumn("_n", best).where("_n = 1").select("*", *corner)
    if matched is not None:
        one = one.join(matched.select(*keys, *corner).distinct(), [*keys, "_cx", "_cy"], "left_anti")
    first = F.row_number().over(W.partitionBy(*keys, "_cx", "_cy").orderBy("start", "end", "label", "text"))
    return one.withColumn("_k", first).where("_k = 1").select(*keys, F.upper("label").alias("label"), "text", *BOX)


def sensitive_boxes(blocks: DataFrame, keys: list[str], tolerance: float = 10.0, as_of: datetime.date = validators.AS_OF) -> DataFrame:
    """(keys, kind, value, box) of what an image shows: blocks whose readings hold a rule's valid match, and addresses, telephone and
    card numbers that go over blocks of a line. Each value and box once."""
    alone = blocks.withColumn("_x", first_rule(candidate_texts(F.col("text")), as_of=as_of)).where("_x is not null")
    alone = alone.select(*keys, F.col("_x.rule").alias("kind"), F.col("_x.value").alias("value"), *[F.col(c).cast("double").alias(c) for c in BOX])
    lines = group_lines(blocks, keys, tolerance)
    joined = joined_emails(lines, keys).unionByName(joined_phones(lines, keys, as_of)).unionByName(joined_cards(lines, keys))
    return alone.unionByName(joined.select(*keys, "kind", "value", *[F.col(c).cast("double").alias(c) for c in BOX])).distinct()


def kind_counts(rows: DataFrame, keys: list[str], kind: str = "kind") -> DataFrame:
    """How many blocks or images there are of each kind."""
    return rows.groupBy(*keys, F.coalesce(F.col(kind), F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))


def annotations(boxes: DataFrame, keys: list[str], width: Column, height: Column, most: int = 80) -> DataFrame:
    """(keys, place, box): boxes as shares of the page, four decimals, within it; empty ones left out, the first most of a page."""
    within = lambda c, size: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) / F.greatest(size, F.lit(1.0)))), 4)
    own = boxes.withColumns({"x0": within("x0", width), "x1": within("x1", width), "y0": within("y0", height), "y1": within("y1", height)})
    own = own.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    place = F.row_number().over(W.partitionBy(*keys).orderBy("y0", "x0", "y1", "x1"))
    return own.withColumn("place", place).where(F.col("place") <= most).select(*keys, "place", *BOX)
