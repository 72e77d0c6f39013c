"""Spans: finding, checking, reconciling and rewriting them, in the row of their document, without a shuffle.

A span is struct<rule, start, end, value, ...>, offsets in code points, half open. Where rows are wanted, ``rows`` opens the
arrays; everything that compares spans of one document works on the array.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from inkveil.functions import masks, validators
from inkveil.functions.rules import GUARDS, Rule, select

SPAN = "array<struct<rule:string,start:int,end:int,value:string>>"


#: Characters of a block, and of a text from which on blocks are made.
BLOCK, LONG = 1024, 8192


def let(value: Column, body) -> Column:
    """The body over a value that is computed once: a lambda reads its variable, not the expression behind it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine, start: Column) -> Column:
    """For each place the values before it, combined. By blocks of about the root of the number of values, so the steps grow
    with its power of 1.5, and no list is copied for each value."""
    fold = lambda part: F.aggregate(part, start, combine)

    def body(v: Column) -> Column:
        width = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int"))

        def of_width(w: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / w).cast("int")), lambda b: fold(F.slice(v, b * w + 1, w)))
            before = lambda own: F.transform(own, lambda x, b: fold(F.slice(own, F.lit(1), b)))
            at = lambda i: F.floor(i / w).cast("int")
            return let(let(blocks, before), lambda ahead: F.transform(v, lambda x, i: combine(F.get(ahead, at(i)), fold(F.slice(v, at(i) * w + 1, F.pmod(i, w))))))

        return let(width, of_width)

    return let(values, body)


def sums_before(values: Column) -> Column:
    return running(values, lambda a, b: a + b, F.lit(0))


def greatest_before(values: Column) -> Column:
    return running(values, lambda a, b: F.greatest(a, b), F.lit(-1))


def find(text: Column, pattern: str, rule: str) -> Column:
    """All matches of an expression that never matches the empty text, left to right, not overlapping."""
    none = F.array().cast(SPAN)

    def spans_of(t: Column, found: Column) -> Column:
        def placed(gaps: Column) -> Column:
            before = sums_before(F.zip_with(gaps, found, lambda g, v: F.length(g) + F.coalesce(F.length(v), F.lit(0))))
            at = lambda b, i: F.get(b, i) + F.length(F.get(gaps, i))
            return let(before, lambda b: F.transform(found, lambda v, i: F.struct(F.lit(rule).alias("rule"), at(b, i).alias("start"), (at(b, i) + F.length(v)).alias("end"), v.alias("value"))))

        return F.when(F.size(found) == 0, none).otherwise(let(F.split(t, pattern, -1), placed))

    return let(F.coalesce(text, F.lit("")), lambda t: let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda found: spans_of(t, found)))


def candidates(text: Column, rules: list[Rule] | None = None) -> Column:
    """Matches of all rules, in the order of their priority. A rule is tried only in texts that pass its guard."""
    none = F.array().cast(SPAN)
    each = [F.when(text.rlike(GUARDS[r.name]), find(text, r.java, r.name)).otherwise(none) if r.name in GUARDS else find(text, r.java, r.name) for r in (rules if rules is not None else select())]
    return F.concat(*each, none)


def blocks(text: Column) -> Column:
    """A long text in blocks, of which ``part`` takes its parts without walking over the text each time."""
    return F.when(F.length(text) >= LONG, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).otherwise(F.array().cast("array<string>"))


def part(text: Column, own: Column, first: Column, n: Column) -> Column:
    """n characters of a text from a place (from 0) on; own: its blocks."""
    at = F.floor(first / BLOCK).cast("int")
    two = F.concat(F.coalesce(F.get(own, at), F.lit("")), F.coalesce(F.get(own, at + 1), F.lit("")))
    return F.when((F.size(own) == 0) | (n > BLOCK), F.substring(text, first + 1, n)).otherwise(F.substring(two, F.pmod(first, F.lit(BLOCK)) + 1, n))


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later expressions read as they are: a generator of one row keeps the optimiser from putting their
    expressions into every place that refers to them, such as the inside of a lambda."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def annotate(spans: Column, text: Column, as_of: datetime.date = validators.AS_OF, around: int = 20, own: Column | None = None, n: Column | None = None) -> Column:
    """Adds to each span whether it is valid, and the text around it. own, n: the text's blocks and length, if they are at hand;
    a lambda would count a long text for each of its spans."""
    own = F.array().cast("array<string>") if own is None else own
    n = F.length(text) if n is None else n
    def one(x: Column) -> Column:
        valid = validators.is_valid(x["rule"], x["value"], as_of)
        first = F.greatest(x["start"] - around, F.lit(0))
        last = F.least(x["end"] + around, n)
        return F.struct(x["rule"].alias("rule"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), part(text, own, first, last - first).alias("context"), valid.alias("valid"))

    return F.transform(spans, one)


def explain(spans: Column, as_of: datetime.date = validators.AS_OF) -> Column:
    """Adds the reason to each annotated span that isn't valid."""
    return F.transform(spans, lambda x: x.withField("fail_reason", F.when(~x["valid"], validators.fail_reason(x["rule"], x["value"], as_of))))


def annotated(df: DataFrame, text_col: str = "text", rules: list[str] | None = None, as_of: datetime.date = validators.AS_OF) -> DataFrame:
    """Adds spans: all candidates of the rules, checked, with context and reasons."""
    a = fixed(df, _text=F.coalesce(F.col(text_col), F.lit("")))
    b = fixed(a, _candidates=candidates(F.col("_text"), select(rules)), _blocks=blocks(F.col("_text")), _length=F.length("_text"))
    c = fixed(b, _checked=annotate(F.col("_candidates"), F.col("_text"), as_of, own=F.col("_blocks"), n=F.col("_length")))
    return fixed(c, spans=explain(F.col("_checked"), as_of)).drop("_text", "_candidates", "_blocks", "_length", "_checked")


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def meets(ordered: Column, which) -> Column:
    """For each of sorted spans whether it overlaps another one of a kind: one before it that reaches beyond its start, or
    the next one behind it that begins before its end."""
    far = 2**31 - 1
    ends = F.transform(ordered, lambda x: F.when(which(x), x["end"]).otherwise(F.lit(-1)))
    # from the right, as negative numbers, the nearest start is the greatest; none is the least
    starts = F.transform(F.reverse(ordered), lambda x: F.when(which(x), -x["start"]).otherwise(F.lit(-far)))
    after = running(starts, lambda a, b: F.greatest(a, b), F.lit(-far))
    return let(greatest_before(ends), lambda reach: let(F.reverse(after), lambda nxt: F.transform(ordered, lambda x, i: (F.get(reach, i) > x["start"]) | (-F.get(nxt, i) < x["end"]))))


def filter_overlapping(spans: Column) -> Column:
    """Valid spans stay, all of them. Others go if they overlap a valid one, or, unless they are resident or foreigner
    numbers themselves, any candidate of these. Sorted by (start, -end), ties as they came."""
    strong = lambda x: x["rule"].isin("rrn", "fgn")

    def kept(own: Column) -> Column:
        return let(meets(own, lambda x: x["valid"]), lambda by_valid: let(meets(own, strong), lambda by_strong: F.filter(own, lambda m, i: m["valid"] | (~F.get(by_valid, i) & (strong(m) | ~F.get(by_strong, i))))))

    few = F.filter(spans, lambda x: ~x["valid"])
    # where all are valid there is nothing to compare
    return let(sort_spans(spans), lambda own: F.when(F.size(few) == 0, own).otherwise(kept(own)))


def sort_spans(spans: Column) -> Column:
    """By (start, -end), ties in the order they had."""
    keyed = F.transform(spans, lambda x, i: F.struct(x["start"].alias("a"), (-x["end"]).alias("b"), i.alias("i"), x.alias("x")))
    return F.transform(F.sort_array(keyed), lambda k: k["x"])


def match(df: DataFrame, text_col: str = "text", rules: list[str] | None = None, as_of: datetime.date = validators.AS_OF, out: str = "matches") -> DataFrame:
    """The document's matches: all rules, checked, with reasons and context, overlaps filtered."""
    found = annotated(df, text_col, rules, as_of)
    return found.withColumn(out, filter_overlapping(F.col("spans"))).drop("spans")


def rows(df: DataFrame, keys: list[str], spans: str = "matches") -> DataFrame:
    """A row for each span."""
    return df.select(*keys, F.inline(spans))


def collect(spans: Column) -> tuple[Column, Column]:
    """(allowed, forbidden): annotated spans by whether they are valid."""
    return F.filter(spans, lambda x: x["valid"]), F.filter(spans, lambda x: ~x["valid"])


def without_forbidden(allowed: Column, forbidden: Column) -> Column:
    """The stricter mode: an invalid candidate takes an overlapping valid one with it. In the order of starts."""
    tagged = lambda spans, ok: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(ok).alias("ok"), x.alias("x")))
    free = lambda own: let(meets(own, lambda x: ~x["ok"]), lambda hit: F.filter(own, lambda x, i: x["ok"] & ~F.get(hit, i)))
    whole = let(sort_spans(F.concat(tagged(allowed, True), tagged(forbidden, False))), free)
    return F.when(F.size(forbidden) == 0, sort_spans(allowed)).otherwise(F.transform(whole, lambda x: x["x"]))


def covered(spans: Column, n: Column) -> Column:
    """How many of a text's n characters lie under spans, each once."""
    step = lambda acc, x: F.struct(F.greatest(acc["last"], x["end"]).alias("last"), (acc["sum"] + F.greatest(F.lit(0), F.least(x["end"], n) - F.greatest(x["start"], acc["last"]))).alias("sum"))
    return F.aggregate(sort_spans(spans), F.struct(F.lit(0).alias("last"), F.lit(0).cast("int").alias("sum")), step, lambda acc: acc["sum"].cast("long"))


def apply(text: Column, spans: Column, mask) -> Column:
    """Masks spans from the right to the left; mask(rule, value) must keep the length. Where spans overlap, the one
    further left is written later and wins."""
    ordered = F.reverse(F.sort_array(F.transform(spans, lambda x, i: F.struct(x["start"].alias("s"), (-i).alias("i"), x["end"].alias("e"), x["rule"].alias("rule")))))
    value = lambda t, x: F.substring(t, x["s"] + 1, x["e"] - x["s"])
    return F.aggregate(ordered, text, lambda t, x: F.overlay(t, mask(x["rule"], value(text, x)), x["s"] + 1, x["e"] - x["s"]))


def blanket(text: Column, rules: list[Rule] | None = None, mask: str = "***") -> Column:
    """Every match of every rule, valid or not, becomes the mask; rule by rule."""
    out = text
    for r in rules if rules is not None else list(select()):
        out = F.regexp_replace(out, r.java, mask.replace("\\", "\\\\").replace("$", "\\$"))
    return out


def redact(df: DataFrame, text_col: str = "text", policy: dict[str, str] | None = None, rules: list[str] | None = None, as_of: datetime.date = validators.AS_OF, strict: bool = True) -> DataFrame:
    """Adds redacted and hits: valid spans masked by the policy. strict: spans that overlap an invalid one are left out."""
    a = annotated(df, text_col, rules, as_of)
    allowed, forbidden = collect(F.col("spans"))
    b = fixed(a, _s=without_forbidden(allowed, forbidden) if strict else F.filter(filter_overlapping(F.col("spans")), lambda x: x["valid"]))
    text = F.coalesce(F.col(text_col), F.lit(""))
    return b.withColumn("redacted", apply(text, F.col("_s"), lambda r, v: masks.text_policy(r, v, policy))).withColumn("hits", F.size("_s")).drop("spans", "_s")


def literals(values: Column) -> Column:
    """Distinct, the longest first, ties by value."""
    keyed = F.transform(F.array_distinct(values), lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))
    return F.transform(F.sort_array(keyed), lambda k: k["v"])


def replace_literals(text: Column, values: Column, mask) -> Column:
    """Replaces literals everywhere, the longest first."""
    return F.aggregate(literals(values), text, lambda t, v: F.replace(t, v, mask(v)))


def xml_nodes(xml: Column, change) -> Column:
    """Applies a change to the text between tags; tags stay."""
    tags, gaps = F.regexp_extract_all(xml, F.lit(r"<[^<>]*>"), F.lit(0)), F.split(xml, r"<[^<>]*>", -1)
    last = F.size(gaps) - 1
    inner = F.transform(gaps, lambda g, i: F.when((i > 0) & (i < last) & (g != ""), change(g)).otherwise(g))
    return F.array_join(F.zip_with(inner, tags, lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")


def union_ranges(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", gap: int = 0) -> DataFrame:
    """Ranges of a document merged where they overlap, touch, or lie within the gap."""
    w = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)
    isle = F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("_new", new).withColumn("_isle", isle).groupBy(*keys, "_isle").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").cast("long").alias("n_spans")).drop("_isle")


def clip(spans: Column, n: Column) -> Column:
    """Spans in order (start, -end), clipped to the text and to what those before left free."""
    bounded = F.filter(F.transform(spans, lambda x: F.struct(x["rule"].alias("rule"), F.greatest(F.lit(0), F.least(n, x["start"])).alias("start"), F.greatest(F.lit(0), F.least(n, x["end"])).alias("end"))), lambda x: x["end"] > x["start"])
    kind = "array<struct<rule:string,start:int,end:int>>"

    def step(acc: Column, x: Column) -> Column:
        s = F.greatest(x["start"], acc["last"])
        free = x["end"] > s
        return F.struct(F.greatest(acc["last"], F.when(free, x["end"]).otherwise(acc["last"])).alias("last"), F.when(free, F.concat(acc["out"], F.array(F.struct(x["rule"].alias("rule"), s.alias("start"), x["end"].alias("end"))))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(sort_spans(bounded), F.struct(F.lit(0).alias("last"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])


def split_at_blank_lines(df: DataFrame, keys: list[str], value: str = "value", start: str = "start") -> DataFrame:
    """(keys, start, end, value): parts of spans around blank lines; each break counts as two characters."""
    breaks = F.col(value).contains("\r\r") | F.col(value).contains("\n\n")
    parts = F.when(breaks, F.split(value, "[\r\n]{2,}", -1)).otherwise(F.array(value))
    each = df.withColumn("_parts", parts).select(*keys, F.col(start).alias("_s"), "_parts", F.posexplode("_parts").alias("_i", "_part"), breaks.alias("_b"))
    before = F.aggregate(F.slice("_parts", F.lit(1), F.col("_i")), F.lit(0), lambda acc, p: acc + F.length(p) + 2)
    at = F.col("_s") + before
    return each.where(~F.col("_b") | F.col("_part").rlike(r"\S")).select(*keys, at.alias("start"), (at + F.length("_part")).alias("end"), F.col("_part").alias("value"))


def runs(places: Column) -> Column:
    """Ascending places as half-open runs of neighbours."""
    begins = F.filter(places, lambda i: ~F.array_contains(places, i - 1))
    ends = F.filter(places, lambda i: ~F.array_contains(places, i + 1))
    return F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))


def subspans(df: DataFrame, keys: list[str], policy: dict[str, str] | None = None) -> DataFrame:
    """(keys, rule, start, end): what of each span (rule, start, value) the policy covers, as runs."""
    places = masks.masked_places(F.col("rule"), F.col("value"), policy)
    found = df.withColumn("_places", places).withColumn("_run", F.explode(runs(F.col("_places"))))
    return found.select(*keys, "rule", (F.col("start") + F.col("_run.start")).alias("start"), (F.col("start") + F.col("_run.end")).alias("end"))


def masked_runs(replacement: Column) -> Column:
    """Runs of asterisks in a replacement."""
    return F.transform(find(replacement, r"\*+", "masked"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


#: Which spans keep entities out: valid ones; those and what looks like an e-mail; those and the e-mail rule's.
EXCLUDE = {
    "valid": lambda x: x["valid"],
    "email_like": lambda x: x["valid"] | (x["value"].contains("@") & F.substring_index(x["value"], "@", -1).contains(".")),
    "email_rule": lambda x: x["valid"] | F.lower(x["rule"]).contains("email"),
}


def exclusions(spans: Column, mode: str = "valid") -> Column:
    return F.transform(F.filter(spans, EXCLUDE[mode]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def blank_ranges(text: Column, ranges: Column) -> Column:
    """Ranges become blanks, line feeds stay."""
    part = lambda x: F.regexp_replace(F.substring(text, x["start"] + 1, x["end"] - x["start"]), "[^\n]", " ")
    return F.aggregate(ranges, text, lambda t, x: F.overlay(t, part(x), x["start"] + 1, x["end"] - x["start"]))


def rule_label(rule: Column) -> Column:
    r = F.lower(F.coalesce(rule, F.lit("")))
    # Labels by what the rule's name contains, the first that fits.
    labels = [("rrn", "주민등록번호"), ("fgn", "외국인등록번호"), ("card", "카드번호"), ("email", "이메일"), ("passport", "여권번호"), ("driver", "운전면허번호"), ("phone", "전화번호"), ("tel", "전화번호"), ("mobile", "전화번호")]
    out = F.when(r == "", F.lit("UNKNOWN")).otherwise(r)
    for part, label in reversed(labels):
        out = F.when(r.contains(part), F.lit(label)).otherwise(out)
    return out


def is_final(label: Column, text: Column) -> Column:
    """Spans worth returning: not blank, not punctuation alone, places of five characters at least."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return (t != "") & ~t.rlike(r"^[^\p{L}\p{N}_]+$") & ~((F.upper(F.coalesce(label, F.lit(""))) == "LC") & (F.length(t) < 5))
