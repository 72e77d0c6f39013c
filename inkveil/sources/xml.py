"""Generic XML: its text, and its table as HTML."""

from __future__ import annotations

from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.functions.text import line_ends_of


def _local(element) -> str:
    return element.tag.rsplit("}", 1)[-1].lower() if isinstance(element.tag, str) else ""


def _named(parent, *names: str) -> list:
    return [x for x in parent if _local(x) in names]


def _word_cell(cell) -> str:
    """Paragraphs by lines; of a cell without any all its text."""
    lines = [t for p in cell.iter() if _local(p) == "p" and (t := "".join(p.itertext()).strip())]
    return "\n".join(lines) or "".join(cell.itertext())


def tables(root) -> list[list[list[str]]]:
    """The first table like HTML's that has rows, else all tables like Word's."""
    of = lambda name, rows, cells, text: [t for x in root.iter() if _local(x) == name and (t := [r for row in _named(x, rows) if (r := [text(c) for c in _named(row, *cells)])])]
    return of("table", "tr", ("td", "th"), lambda c: "".join(c.itertext()))[:1] or of("tbl", "tr", ("tc",), _word_cell)


def html(rows: list[list[str]]) -> str:
    """A table made rectangular, cells escaped, line ends as breaks."""
    safe = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;", "\n": "<br/>"})
    width = max(map(len, rows))
    lines = ["<tr>\n" + "".join(f"<td>{line_ends_of(c).translate(safe)}</td>\n" for c in [*row, *[""] * (width - len(row))]) + "</tr>" for row in rows]
    return "\n".join(["<table>", "<tbody>", *lines, "</tbody>", "</table>"])


def read_xml(data: bytes) -> tuple[str, str]:
    """(text, markdown) of a document's bytes. What is no XML, or defines entities of its own, is a text as it stands."""
    raw = data.decode("utf-8", "ignore")
    plain = line_ends_of(raw).strip()
    try:
        root = ElementTree.fromstring(raw) if "<!ENTITY" not in raw else None
    except (ElementTree.ParseError, ValueError):
        root = None
    if root is None:
        return plain, plain
    text = "\n".join("".join(root.itertext()).splitlines()).strip() or plain
    return text, "\n\n".join(map(html, tables(root))) or text


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("markdown", T.StringType())]))
def xml_content(data: pa.Array) -> pa.Array:
    """struct<text, markdown> of XML bytes; null bytes give null."""
    rows = [None if x is None else dict(zip(("text", "markdown"), read_xml(x), strict=True)) for x in data.to_pylist()]
    return pa.array(rows, pa.struct([("text", pa.string()), ("markdown", pa.string())]))
