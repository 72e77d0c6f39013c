"""Text normalisation as columns; only NFKC, which Spark has no function for, is an Arrow UDF."""

from __future__ import annotations

import itertools
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that are dropped, that become a space, and that become a hyphen.
DROPPED, SPACES = "\u200b\u200c\u200d\u2060\ufeff", "\u00a0\u2007\u202f"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2212\ufe63\u2043"


@F.arrow_udf(T.StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def digits_only(s: Column) -> Column:
    return F.regexp_replace(F.coalesce(s, F.lit("")), "[^0-9]", "")


def strip_invisible(s: Column) -> Column:
    return F.translate(s, SPACES + DROPPED, " " * len(SPACES))


def line_ends(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def line_ends_of(text: str) -> str:
    """The same of a Python text."""
    return text.replace("\r\n", "\n").replace("\r", "\n")


def trim_white(s: Column) -> Column:
    return F.btrim(s, F.lit(" \t\n\r\f\x0b"))


def cleanup_text(s: Column, keep_tabs: bool = False, compose: bool = True) -> Column:
    """Line ends, NFKC, blanks at line ends, at most one empty line, single blanks, trimmed; empty for null."""
    blank = "[ ]" if keep_tabs else r"[ \t]"
    t = line_ends(F.coalesce(s, F.lit("")))
    t = nfkc(t) if compose else t
    t = F.regexp_replace(t, f"{blank}+\n", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return trim_white(F.regexp_replace(t, f"{blank}{{2,}}", " "))


def normalize(s: Column, compose: bool = True) -> Column:
    """NFKC, line ends, invisible characters, dashes to hyphens, tabs to blanks, other blanks to one, lines trimmed right."""
    t = F.coalesce(s, F.lit(""))
    t = strip_invisible(line_ends(nfkc(t) if compose else t))
    t = F.translate(t, DASHES + "\t", "-" * len(DASHES) + " ")
    t = F.regexp_replace(t, r"[ \f\x0B]+", " ")
    return F.regexp_replace(t, r"(?m)[ ]+$", "")


INDEXED = T.StructType([T.StructField("text", T.StringType()), T.StructField("at", T.ArrayType(T.IntegerType()))])


class Indexed:
    """A text whose characters know their place in the raw one, while parts of it are taken out."""

    def __init__(self, parts: list[tuple[int, str]]) -> None:
        self.text = "".join(t for _, t in parts)
        self.at = np.repeat(np.array([i for i, _ in parts], np.int32), [len(t) for _, t in parts])

    def without(self, pattern: str) -> Indexed:
        gone = np.zeros(len(self.text), bool)
        for m in re.finditer(pattern, self.text):
            gone[m.start() : m.end()] = True
        if gone.any():
            out = Indexed([])
            out.text = "".join(c for c, g in zip(self.text, gone.tolist(), strict=True) if not g)
            out.at = self.at[~gone]
            return out
        return self

    def translated(self, table: dict[int, str]) -> Indexed:
        """Characters become others, one for one."""
        out = Indexed([])
        out.text, out.at = self.text.translate(table), self.at
        return out


_CONTROL = str.maketrans(SPACES + "\t\f\v" + DASHES, " " * (len(SPACES) + 3) + "-" * len(DASHES), DROPPED)


def _indexed_rows(rows: list[Indexed]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array([x.text for x in rows], pa.string()), pa.array([x.at for x in rows], pa.list_(pa.int32()))], ["text", "at"])


def _normal_indexed(raw: str) -> Indexed:
    units = [(m.start(), m.group()) for m in re.finditer("\r\n|[\\s\\S]", raw)]
    made = [(i, "\n" if u[0] == "\r" else unicodedata.normalize("NFKC", u).translate(_CONTROL)) for i, u in units]
    # of blanks at the end of a line none stays, of others in a row the first
    return Indexed(made).without(r" +(?=\n|\Z)").without(r"(?<= ) +")


@F.arrow_udf(INDEXED)
def normalize_indexed(texts: pa.Array) -> pa.Array:
    """The normalised text, and for each of its characters the place in the raw one (NFKC by character). A line end of two
    characters has the place of its first."""
    return _indexed_rows([_normal_indexed(t or "") for t in texts.to_pylist()])


def raw_runs(at: Column, start: Column, end: Column) -> Column:
    """array<struct<start, end, norm_start, norm_end>>: a span of the normalised text as runs of neighbours in the raw one.
    A raw character that became several ends a run, as what was left out between two does."""
    places = F.sequence(start, F.greatest(start, F.least(end, F.size(at))) - 1)
    begins = F.filter(places, lambda p: (p == start) | (F.get(at, p) != F.get(at, p - 1) + 1))
    ends = F.filter(places, lambda p: (p == F.element_at(places, -1)) | (F.get(at, p + 1) != F.get(at, p) + 1))
    pair = lambda b, e: F.struct(F.get(at, b).alias("start"), (F.get(at, e) + 1).alias("end"), b.alias("norm_start"), (e + 1).alias("norm_end"))
    none = F.array().cast("array<struct<start:int,end:int,norm_start:int,norm_end:int>>")
    return F.when((start >= 0) & (F.least(end, F.size(at)) > start), F.zip_with(begins, ends, pair)).otherwise(none)


def nearest_raw(at: Column, place: Column) -> Column:
    """The raw place of a normalised one; where it has none (null, or beyond the ends) that of the nearest to the left that has
    one, else to the right; null if none has."""
    cut = F.greatest(F.lit(0), F.least(place + 1, F.size(at)))
    left = F.filter(F.slice(at, F.lit(1), cut), lambda x: x.isNotNull())
    right = F.filter(F.slice(at, cut + 1, F.size(at)), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(left, F.lit(-1)), F.get(right, F.lit(0)))


def ocr_normalize(s: Column) -> Column:
    return F.translate(s, "\uff20\u3002\u00b7\uff0c\uff0f", "@..,/")


def match_key(s: Column, compose: bool = True) -> Column:
    """Lower-case, without blanks and punctuation."""
    t = F.coalesce(s, F.lit(""))
    return F.regexp_replace(F.lower(nfkc(t) if compose else t), r"[\s\p{Punct}]+", "")


def compact(s: Column, keep: str) -> tuple[Column, Column]:
    """The characters that match the class, and their places."""
    pairs = F.filter(F.transform(F.split(s, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: x["c"].rlike(keep))
    return F.array_join(F.transform(pairs, lambda x: x["c"]), ""), F.transform(pairs, lambda x: x["i"])


def markdown_noise(s: Column) -> Column:
    """Markup and invisible characters become blanks of the same number."""
    chars = "|`*_#><\u200b\u200c\u200d\ufeff\u00a0\t"
    return F.translate(s, chars, " " * len(chars))


TABLE_LINE = r"^\s*\|.*\|\s*$"
SEPARATOR_LINE = r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?\s*$"


def blank_tables(s: Column) -> Column:
    """Table and separator lines become blanks of the same length."""
    line = lambda x: F.when(x.rlike(TABLE_LINE) | x.rlike(SEPARATOR_LINE), F.repeat(F.lit(" "), F.length(x))).otherwise(x)
    return F.array_join(F.transform(F.split(s, "\n", -1), line), "\n")


def escape_html(s: Column, quotes: bool = True) -> Column:
    t = s
    for raw, safe in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;"), ("'", "&#39;")] if quotes else [])]:
        t = F.replace(t, F.lit(raw), F.lit(safe))
    return t


def leading_spaces(s: Column) -> Column:
    """Blanks before a text become no-break entities."""
    n = F.length(s) - F.length(F.ltrim(s))
    return F.concat(F.repeat(F.lit("&nbsp;"), n), F.ltrim(s))


def is_emailish(s: Column) -> Column:
    return s.contains("@") & F.substring_index(s, "@", -1).contains(".") & (F.length(s) >= 3)


def truncated(s: Column, n: int) -> Column:
    return F.when(F.length(s) > n, F.concat(F.left(s, F.lit(n)), F.lit("\n...(truncated)"))).otherwise(s)


CELL_RANGE = r"(?i)Sheet[0-9]*!\$[A-Z]+\$[0-9]+(?::\$[A-Z]+\$[0-9]+)?"


def lines_of(s: Column) -> Column:
    return F.split(F.coalesce(s, F.lit("")), "\n", -1)


def clean_extracted(s: Column, compose: bool = True) -> Column:
    """Text of charts: tags become blanks; empty lines and those with a bracket go, as do cell ranges and the format name
    before a number; then cleaned up."""
    t = F.regexp_replace(F.replace(F.coalesce(s, F.lit("")), F.lit("\r"), F.lit("")), r"<[^>]+>", " ")
    t = F.array_join(F.filter(F.transform(lines_of(t), trim_white), lambda x: (x != "") & ~x.rlike("[<>]")), "\n")
    t = F.regexp_replace(F.regexp_replace(t, CELL_RANGE, ""), r"(?i)\bGeneral\b(?=\s*[0-9])", "")
    return cleanup_text(t, compose=compose)


# How lines of slide masters look.
BULLETS = r"[\u2022\u00b7*\-\u2013\u2014\u25e6\u25cf\u25cb\u25c6\u25c7\u25aa\u25ab\u25b6\u25b7\u25a0\u25a1]+"
ORDINALS = "첫째|둘째|셋째|넷째|다섯째|여섯째|일곱째|여덟째|아홉째|열째"
NUMBERS = "첫|두|둘|세|셋|네|넷|다섯|여섯|일곱|여덟|아홉|열|[0-9]+"
PLACEHOLDERS = ["‹#›", "<#>", "〈#〉", "《#》", "【#】"]
MASTER, STYLE, PROMPT = "마스터", "스타일", "편집하려면 클릭"


def is_noise_line(line: Column) -> Column:
    """Prompts of a slide master, bullets alone, placeholders of slide numbers, and empty lines."""
    level = rf"^(?:{BULLETS}\s*)?(?:(?:{ORDINALS})|(?:{NUMBERS})\s*(?:번째)?)\s*수준\s*$"
    prompt = (line.contains(MASTER) & line.contains(STYLE)) | line.contains(PROMPT)
    return (line == "") | prompt | line.rlike(level) | line.rlike(f"^{BULLETS}$") | line.isin(*PLACEHOLDERS)


def drop_noise_lines(s: Column, compose: bool = False) -> Column:
    """Slide text without its noise lines; blanks shrink."""
    t = line_ends(F.coalesce(s, F.lit("")))
    t = F.translate(nfkc(t) if compose else t, "\u200b\u200c\u200d\ufeff", "")
    tidy = F.transform(F.split(t, "\n", -1), lambda x: trim_white(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.array_join(F.filter(tidy, lambda x: ~is_noise_line(x)), "\n")


# Characters of HWP texts that go, those that stay, and those that make a line worth keeping.
_HWP_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
_HWP_OTHER = r"[^\n\t \x21-\x7E\uAC00-\uD7A3\u1100-\u11FF\u3130-\u318F\u20A9\u00B7]"
_HWP_SIGNAL = r"0-9A-Za-z@\uAC00-\uD7A3"


def clean_hwp(s: Column) -> Column:
    """Control characters go, others than ASCII, Hangul and two signs become blanks; blanks in a row and empty lines shrink,
    lines are trimmed, those without a letter, digit or @ become empty."""
    t = F.translate(F.coalesce(s, F.lit("")), "\r", "\n")
    t = F.regexp_replace(F.regexp_replace(t, _HWP_CONTROL, ""), _HWP_OTHER, " ")
    t = F.regexp_replace(t, r"(?m)(?<= ) +|^[ \t]+|[ \t]+$", "")
    t = F.regexp_replace(t, rf"(?m)^[^\n{_HWP_SIGNAL}]+$", "")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def _hwp_indexed(raw: str) -> Indexed:
    own = Indexed(list(enumerate(raw.replace("\r", "\n")))).without(_HWP_CONTROL)
    own = own.translated({ord(c): " " for c in set(re.findall(_HWP_OTHER, own.text))})
    own = own.without(r"(?m)(?<= ) +|^[ \t]+|[ \t]+$").without(rf"(?m)^[^\n{_HWP_SIGNAL}]+$")
    return own.without(r"(?<=\n\n)\n+").without(r"\A\s+|\s+\Z")


@F.arrow_udf(INDEXED)
def clean_hwp_indexed(texts: pa.Array) -> pa.Array:
    """As ``clean_hwp``, and for each character its place in the raw text."""
    return _indexed_rows([_hwp_indexed(t or "") for t in texts.to_pylist()])


# Fixed value: an address as text recognition may read it.
RELAXED_EMAIL = "[A-Za-z0-9._%+\\-]+[@\uff20][A-Za-z0-9.\\-]+[.\u3002,\u00b7][A-Za-z]{2,}"


def find_target(raw: Column, target: Column) -> Column:
    """struct<start, end> of a target of two characters or more in a text: as it is, else without case in compatible characters
    (if these leave the length), else without white space; null if it isn't there."""
    want = F.regexp_replace(F.coalesce(target, F.lit("")), r"^\s+|\s+$", "")
    at = lambda place, n: F.struct((place - 1).cast("int").alias("start"), (place - 1 + n).cast("int").alias("end"))
    lowered, low = F.lower(nfkc(raw)), F.lower(nfkc(want))
    short, places = compact(raw, r"\S")
    tight = F.regexp_replace(want, r"\s+", "")
    k = F.instr(short, tight)
    spread = F.struct(F.get(places, k - 1).alias("start"), (F.get(places, k + F.length(tight) - 2) + 1).alias("end"))
    return (
        F.when((F.length(want) < 2) | (F.coalesce(raw, F.lit("")) == ""), F.lit(None))
        .when(F.instr(raw, want) > 0, at(F.instr(raw, want), F.length(want)))
        .when((F.instr(lowered, low) > 0) & (F.length(lowered) == F.length(raw)), at(F.instr(lowered, low), F.length(low)))
        .when((F.length(tight) >= 2) & (k > 0), spread)
    )


def _table_lines(run: list[list[str]]) -> list[str] | None:
    """A run of rows as a Markdown table; None if they are one already or have a single column."""
    n = max(map(len, run))
    marked = any(len(row) >= 2 and all(re.fullmatch(r"[ \-:]+", cell) for cell in row) for row in run)
    if len(run) < 2 or n < 2 or marked:
        return None
    filled = [[*row, *[""] * (n - len(row))] for row in run]
    head = ["" if re.fullmatch(r"(?i)col(?:umn)?\s*[0-9]+", cell.strip()) else cell for cell in filled[0]]
    line = lambda cells: "| " + " | ".join(c.replace("|", r"\|") for c in cells) + " |"
    return ["", line(head), line(["---"] * n), *map(line, filled[1:]), ""]


def _pipe_cells(line: str) -> list[str]:
    return [c.strip() for c in re.sub(r"^\||\|$", "", line.strip()).split("|")]


def _space_cells(line: str) -> list[str]:
    return [c.strip() for c in re.split(r"\s{2,}", line.rstrip())]


#: Kinds of rows in the order in which they are tried: what tells one, its cells, and rows that make a table.
_ROW_KINDS = [
    (lambda x: "\t" in x and x.strip() != "", lambda x: [c.strip() for c in x.split("\t")], 2),
    (lambda x: "|" in x and x.strip() != "" and len(_pipe_cells(x)) >= 2, _pipe_cells, 2),
    (lambda x: re.search(r"\s{2,}", x) is not None and x.strip() != "" and len(_space_cells(x)) >= 2, _space_cells, 3),
]


def markdown_tables(text: str) -> str:
    """Runs of rows (by tabs, pipes, or two blanks) become Markdown tables; code between fences stays, and so does a text that
    has a table of HTML."""
    if "<table" in text:
        return text
    lines, out, fenced, at = text.split("\n"), [], False, 0
    while at < len(lines):
        fence = lines[at].strip().startswith("```")
        fenced ^= fence
        kind = next((k for k in _ROW_KINDS if k[0](lines[at])), None) if not fence and not fenced else None
        run = [lines[at]] if kind is None else list(itertools.takewhile(kind[0], lines[at:]))
        made = _table_lines([kind[1](x) for x in run]) if kind and len(run) >= kind[2] else None
        out += run if made is None else made
        at += len(run)
    return "\n".join(out)


@F.arrow_udf(T.StringType())
def tables_to_markdown(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else markdown_tables(t) for t in texts.to_pylist()], pa.string())


def data_uri(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))
