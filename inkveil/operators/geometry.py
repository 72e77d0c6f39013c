"""Words and boxes on pages, as rows: (page keys, x0, y0, x1, y1, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from inkveil.operators.spans import let

# Widths of characters, by class, the first that fits.
WIDTHS = [(r"\s", 0.18), ("[\\uAC00-\\uD7A3\\u1100-\\u11FF\\u3130-\\u318F]", 1.05), ("[\\u4E00-\\u9FFF]", 1.0), ("[0-9]", 0.62), ("[A-Za-z]", 0.68), ("[:\\uFF1A\\-\\u2010\\u2013\\u2014._/\\\\|()\\[\\]{},@]", 0.28)]
OTHER_WIDTH = 0.55


def width(c: Column) -> Column:
    out = F.lit(OTHER_WIDTH)
    for rx, w in reversed(WIDTHS):
        out = F.when(c.rlike(f"^{rx}$"), F.lit(w)).otherwise(out)
    return out


def text_width(t: Column) -> Column:
    return F.when(F.length(t) == 0, F.lit(0.0)).otherwise(F.aggregate(F.split(t, ""), F.lit(0.0), lambda acc, c: acc + width(c)))


def group_rows(words: DataFrame, keys: list[str], tolerance: float = 35.0, order: str = "x0") -> DataFrame:
    """Adds row and place: words whose centres follow within the tolerance, top to bottom, left to right."""
    centre = (F.col("y0") + F.col("y1")) / 2
    w = W.partitionBy(*keys).orderBy("_cy", order)
    a = words.withColumn("_cy", centre)
    a = a.withColumn("_new", F.when(F.col("_cy") - F.lag("_cy").over(w) <= tolerance, 0).otherwise(1))
    a = a.withColumn("row", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return a.withColumn("place", F.row_number().over(W.partitionBy(*keys, "row").orderBy(order, "_cy"))).drop("_cy", "_new")


def page_text(words: DataFrame, keys: list[str], tolerance: float = 8.0) -> DataFrame:
    """The text of each page: words of a row with blanks, rows with line feeds. As ``group_rows``, in the row of a page: its words
    are sorted once and cut where their centres part, without windows."""
    word = F.struct(((F.col("y0") + F.col("y1")) / 2).alias("cy"), F.col("x0").alias("x"), F.col("text").alias("t"))
    pages = words.groupBy(*keys).agg(F.sort_array(F.collect_list(word)).alias("_w"))
    begins = F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: (i == 0) | (F.get("_w", i)["cy"] - F.get("_w", i - 1)["cy"] > tolerance))
    row = lambda part: F.array_join(F.transform(F.sort_array(F.transform(part, lambda x: F.struct(x["x"], x["cy"], x["t"].alias("t")))), lambda x: x["t"]), " ")
    lines = lambda at: F.transform(at, lambda b, k: row(F.slice("_w", b + 1, F.coalesce(F.get(at, k + 1), F.size("_w")) - b)))
    return pages.select(*keys, F.array_join(let(begins, lines), "\n").alias("text"))


def layout_text(words: DataFrame, keys: list[str], tolerance: float = 8.0, wide: float = 1.5) -> DataFrame:
    """The text of each page with its columns kept apart: as ``page_text``, but words whose gap exceeds that many times the height of
    the row are parted by three blanks."""
    rows = group_rows(words, keys, tolerance)
    lists = rows.groupBy(*keys, "row").agg(F.sort_array(F.collect_list(F.struct("place", "text", "x0", "x1", "y0", "y1"))).alias("_w"))
    apart = lambda x, i: F.get("_w", i)["x0"] - F.get("_w", i - 1)["x1"] > wide * F.greatest(F.lit(1.0), F.get("_w", i)["y1"] - F.get("_w", i)["y0"])
    sign = lambda x, i: F.when(i == 0, "").when(apart(x, i), "   ").otherwise(" ")
    lines = lists.select(*keys, "row", F.array_join(F.transform("_w", lambda x, i: F.concat(sign(x, i), x["text"])), "").alias("line"))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("text"))


def slice_box(t: Column, start: Column, end: Column, x0: Column, x1: Column) -> tuple[Column, Column]:
    """Left and right of the characters from start to end, by their widths; the whole box if that is under one unit wide."""
    n = F.length(t)
    a, b = F.greatest(F.lit(0), F.least(n, start)), F.greatest(F.lit(0), F.least(n, end))
    w, total = F.greatest(F.lit(1.0), x1 - x0), F.greatest(F.lit(1e-6), text_width(t))
    left, right = x0 + w * text_width(F.substring(t, F.lit(1), a)) / total, x0 + w * text_width(F.substring(t, F.lit(1), b)) / total
    ok = (n > 0) & (b > a) & (right - left >= 1.0)
    return F.when(ok, left).otherwise(x0), F.when(ok, right).otherwise(x1)


def tighten_box(t: Column, x0: Column, y0: Column, x1: Column, y1: Column, factor: float = 0.55, slack: float = 0.3) -> tuple[Column, Column]:
    """A box far wider than its text is narrowed around its middle."""
    s = F.trim(t)
    limit = F.greatest(F.lit(8.0), F.greatest(F.lit(1.0), y1 - y0) * factor * text_width(s)) * (1 + slack)
    wide = (s != "") & (F.greatest(F.lit(1.0), x1 - x0) > limit)
    middle = (x0 + x1) / 2
    return F.when(wide, middle - limit / 2).otherwise(x0), F.when(wide, middle + limit / 2).otherwise(x1)


def char_boxes(chars: DataFrame, keys: list[str], y_tolerance: float = 1.2, x_gap: float = 0.9) -> DataFrame:
    """Boxes of a span's characters (keys, pos, x0..y1) merged along lines: neighbours on a line, the gap at most x_gap."""
    w = W.partitionBy(*keys).orderBy("pos")
    apart = (F.abs(F.col("y0") - F.lag("y0").over(w)) > y_tolerance) | (F.col("x0") - F.lag("x1").over(w) > x_gap)
    a = chars.withColumn("_new", F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return a.groupBy(*keys, "_run").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n_chars")).drop("_run")


def pixels_to_page(df: DataFrame, image_w: Column, image_h: Column, page: tuple[Column, Column, Column, Column], pad: float = 0.0) -> DataFrame:
    """Boxes in pixels of an image that fills a rectangle of the page, padded and clipped to it."""
    px0, py0, px1, py1 = page
    x = lambda c: px0 + F.col(c) * (px1 - px0) / F.greatest(F.lit(1.0), image_w)
    y = lambda c: py0 + F.col(c) * (py1 - py0) / F.greatest(F.lit(1.0), image_h)
    return df.withColumns({"x0": F.greatest(px0, x("x0") - pad), "y0": F.greatest(py0, y("y0") - pad), "x1": F.least(px1, x("x1") + pad), "y1": F.least(py1, y("y1") + pad)})


def beside_text(boxes: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes that no word's box intersects."""
    b, w = boxes.alias("b"), words.alias("w")
    cond = (F.col("b.x0") < F.col("w.x1")) & (F.col("w.x0") < F.col("b.x1")) & (F.col("b.y0") < F.col("w.y1")) & (F.col("w.y0") < F.col("b.y1"))
    for k in keys:
        cond = cond & (F.col(f"b.{k}") == F.col(f"w.{k}"))
    return b.join(w, cond, "left_anti")


def is_value_like(s: Column) -> Column:
    digits = F.length(F.regexp_replace(s, "[^0-9]", ""))
    return (s != "") & (s.contains("@") | (digits >= 2) | ((s.contains("-") | s.contains(".")) & (digits >= 1)) | (~s.contains("-") & ~s.contains(".") & F.length(s).between(2, 4) & s.rlike(r"^\p{L}+$")))


def is_incomplete(kind: Column, s: Column) -> Column:
    t = F.trim(s)
    card = F.length(F.regexp_replace(t, "[^0-9]", "")).between(10, 15)
    mail = t.contains("@") & (t.endswith(".") | ~t.rlike(r"\.[A-Za-z]{2,4}$"))
    return F.when(kind == "card", card).when(kind == "email", mail).otherwise(F.lit(False)) & (t != "")


def best_continuations(words: DataFrame, keys: list[str], gap: float = 40.0, least: float = 0.25, centre: float = 80.0) -> DataFrame:
    """For each incomplete word (row, kind) the value-like word of the next row that continues it best: near below, with a
    share of common width or near centres; (keys, from_id, to_id, score)."""
    a, b = words.where(is_incomplete(F.col("kind"), F.col("text"))).alias("a"), words.where(is_value_like(F.col("text"))).alias("b")
    cond = F.col("b.row") == F.col("a.row") + 1
    for k in keys:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    shared = F.greatest(F.lit(0.0), F.least(F.col("a.x1"), F.col("b.x1")) - F.greatest(F.col("a.x0"), F.col("b.x0"))) / F.greatest(F.lit(1.0), F.least(F.col("a.x1") - F.col("a.x0"), F.col("b.x1") - F.col("b.x0")))
    away = F.abs((F.col("a.x0") + F.col("a.x1") - F.col("b.x0") - F.col("b.x1")) / 2)
    below = F.col("b.y0") - F.col("a.y1")
    found = a.join(b, cond).where((below <= gap) & ((shared >= least) | (away <= centre))).select(*[F.col(f"a.{k}") for k in keys], F.col("a.id").alias("from_id"), F.col("b.id").alias("to_id"), (shared - away / 1000 - F.greatest(below, F.lit(0.0)) / 1000).alias("score"))
    w = W.partitionBy(*keys, "from_id").orderBy(F.desc("score"), "to_id")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def union_box(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
