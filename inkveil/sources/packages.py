"""Office packages (ZIP files of XML) as rows: opened and packed by Arrow-batched Python, read and redacted by columns.

``members`` yields a row for each member, so one package's parts spread over the cluster; texts, cells and redaction are
expressions on the XML; ``pack`` puts the members of a path together again. A member is held whole, a package only while it
is packed. A workbook inside a package is a package of its own, whose path is the outer one's, a bang and the member.

What can't be read has a row with the reason: a package that is none or is broken, a member that is encrypted, broken, packed
by an unknown method or larger than MOST unpacked. Bytes that aren't of a member's encoding are left out.
"""

from __future__ import annotations

import codecs
import datetime
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.functions import masks, validators
from inkveil.functions.text import CELL_RANGE, clean_extracted, cleanup_text, line_ends
from inkveil.operators import spans
from inkveil.operators.tables import cell_reference

EXTENSIONS = ("docx", "pptx", "xlsx", "hwpx")
#: Members whose text is read: by kind of package, in this order; charts and packages inside come behind.
TEXT_MEMBERS = {"docx": r"^word/document\.xml$", "pptx": r"^ppt/slides/[^/]*\.xml$", "xlsx": r"^xl/(?:sharedStrings|worksheets/[^/]*)\.xml$", "hwpx": r"(?i)^contents/.*\.xml$"}
CHART_MEMBERS = r"(?i)^(?:(?:word|ppt|xl)/charts/|charts?/)[^/]*\.xml$"
EMBEDDED_MEMBERS = r"(?i)^(?:(?:word|ppt)/embeddings/.*\.xlsx|bindata/.*)$"
REDACTED_MEMBERS = r"(?i)^(?:word/(?:document|header[0-9]*|footer[0-9]*|footnotes|endnotes|comments|charts/.*)|ppt/(?:slides|notesSlides|charts)/[^/]*|xl/(?:sharedStrings|worksheets/[^/]*|charts/[^/]*|comments[0-9]*)|contents/.*|charts?/[^/]*)\.xml$"
#: Bytes of a member, unpacked, beyond which it isn't read.
MOST = 256 << 20


def decoded(data: bytes) -> tuple[str, str]:
    """(encoding, text) of XML bytes: by the byte order mark, else as declared in the first 256 bytes, else (or if that is
    unknown) UTF-8. What doesn't belong to the encoding is left out."""
    for mark, name in ((codecs.BOM_UTF8, "UTF-8"), (codecs.BOM_UTF16_LE, "UTF-16LE"), (codecs.BOM_UTF16_BE, "UTF-16BE")):
        if data.startswith(mark):
            return name, data[len(mark) :].decode(name, "ignore")
    m = re.search(rb"""(?i)encoding\s*=\s*["']([A-Za-z0-9._-]+)["']""", data[:256])
    name = m.group(1).decode("ascii").upper() if m else "UTF-8"
    if name in ("UTF8", "UTF16"):  # the latter without a mark has no byte order
        name = "UTF-8"
    try:
        return name, data.decode(name, "ignore")
    except (LookupError, UnicodeError):
        return "UTF-8", data.decode("utf-8", "ignore")


def encoded(text: str, name: str, raw: bytes) -> bytes:
    """A member's text in the encoding it had, with its byte order mark if it had one."""
    mark = next((m for m in (codecs.BOM_UTF8, codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE) if raw.startswith(m)), b"")
    return mark + text.encode(name, "xmlcharrefreplace")


@F.arrow_udf(T.StructType([T.StructField("encoding", T.StringType()), T.StructField("text", T.StringType())]))
def decode_xml(data: pa.Array) -> pa.Array:
    rows = [None if x is None else dict(zip(("encoding", "text"), decoded(x), strict=True)) for x in data.to_pylist()]
    return pa.array(rows, pa.struct([("encoding", pa.string()), ("text", pa.string())]))


@F.arrow_udf(T.BinaryType())
def encode_xml(text: pa.Array, name: pa.Array, raw: pa.Array) -> pa.Array:
    return pa.array([None if t is None else encoded(t, n or "UTF-8", r or b"") for t, n, r in zip(text.to_pylist(), name.to_pylist(), raw.to_pylist(), strict=True)], pa.binary())


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(path, ext, content) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"), "content")


def _members_of(content: bytes | None) -> Iterator[tuple[str | None, int, bytes | None, str | None]]:
    """(member, place, data, error) of a package's bytes."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as package:
            for place, info in enumerate(package.infolist()):
                try:
                    with package.open(info) as file:
                        data = file.read(MOST + 1)
                    yield (info.filename, place, data, None) if len(data) <= MOST else (info.filename, place, None, f"larger than {MOST} bytes")
                except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, EOFError, zlib.error, ValueError, struct.error) as broken:
                    yield info.filename, place, None, f"{type(broken).__name__}: {broken}"
    except (zipfile.BadZipFile, OSError, NotImplementedError, ValueError, struct.error) as broken:
        yield None, -1, None, f"{type(broken).__name__}: {broken}"


def members(files: DataFrame) -> DataFrame:
    """(path, ext, member, place, data, error, encoding, xml) of packages; a broken one yields a single row without a member, a
    broken member one without data."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "ext", "member", "place", "data", "error", "encoding", "xml"]
        for batch in batches:
            for path, ext, content in zip(batch["path"], batch["ext"], batch["content"], strict=True):
                rows = []
                for member, place, data, error in _members_of(content):
                    text = decoded(data) if data is not None and re.search(r"(?i)\.(?:xml|rels)$", member) else (None, None)
                    rows.append((path, ext, member, place, data, error, *text))
                yield pd.DataFrame(rows, columns=columns)

    found = files.where(F.col("ext").isin(*EXTENSIONS)).select("path", "ext", "content")
    return found.mapInPandas(run, "path string, ext string, member string, place int, data binary, error string, encoding string, xml string")


def embedded(found: DataFrame) -> DataFrame:
    """(path, ext, member, place, ...) of the members of workbooks inside packages, whatever their names say they are."""
    inner = found.where(F.col("member").rlike(EMBEDDED_MEMBERS) & F.substring("data", 1, 2).eqNullSafe(F.lit(b"PK")))
    return members(inner.select(F.concat("path", F.lit("!"), "member").alias("path"), F.lit("xlsx").alias("ext"), F.col("data").alias("content")))


def unescape(s: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(name), F.lit(char))
    return s


# What elements of a Word text stand for, and the breaks that a page or a column makes.
_SIGNS = {"tab": "\t", "cr": "\n", "noBreakHyphen": "-"}
_BREAKS = {"page": "\n[PAGE_BREAK]\n", "column": "\n[COLUMN_BREAK]\n"}


def _local(name: str) -> str:
    return name.rsplit("}", 1)[-1]


def _attribute(element, name: str) -> str:
    return next((v for k, v in element.attrib.items() if _local(k) == name), "")


def _sign(element) -> str:
    name = _local(element.tag)
    if name in ("t", "delText"):
        return element.text or ""
    if name in ("br", "cr"):
        return _BREAKS.get(_attribute(element, "type"), "\n")
    if name == "pageBreakBefore":
        return _BREAKS["page"]
    if name == "sym":
        code = _attribute(element, "char")
        return chr(int(code, 16)) if re.fullmatch("[0-9A-Fa-f]{1,5}", code) else ""
    return _SIGNS.get(name, "")


def _paragraph(element) -> str:
    """Signs in document order; tabs that only define stops say nothing."""
    stops = {id(x) for p in element.iter() if _local(p.tag) == "tabs" for x in p}
    return "".join(_sign(x) for x in element.iter() if id(x) not in stops).rstrip()


def _word_blocks(xml: str) -> Iterator[str]:
    """Paragraphs as lines and tables as rows of cells between pipes."""
    root = ElementTree.fromstring(xml.encode())
    body = next((x for x in root.iter() if _local(x.tag) == "body"), root)
    named = lambda parent, name: [x for x in parent if _local(x.tag) == name]
    for block in body:
        if _local(block.tag) == "p":
            yield _paragraph(block)
        elif _local(block.tag) == "tbl":
            for row in named(block, "tr"):
                cells = [" ".join(filter(None, (_paragraph(p) for p in cell.iter() if _local(p.tag) == "p"))).strip() for cell in named(row, "tc")]
                yield "| " + " | ".join(cells) + " |"


def _without_entities(xml: str) -> bool:
    """Documents that define entities of their own aren't parsed: these may expand without bound."""
    return "<!ENTITY" not in xml


@F.arrow_udf(T.StringType())
def docx_text(xml: pa.Array) -> pa.Array:
    """Paragraphs by lines, tables by rows, tabs and breaks kept; of what is no XML the texts between its tags."""
    out = []
    for x in xml.to_pylist():
        try:
            out.append(None if x is None else "\n".join(_word_blocks(re.sub(r"^\s*<\?xml[^>]*\?>", "", x))) if _without_entities(x) else "")
        except ElementTree.ParseError:
            out.append("".join(re.findall(r"(?s)<w:t(?: [^>]*)?>(.*?)</w:t>", x)))
    return pa.array(out, pa.string())


def pptx_text(xml: Column) -> Column:
    texts_ = F.transform(F.regexp_extract_all(xml, F.lit(r"(?s)<a:t[^>]*>(.*?)</a:t>"), F.lit(1)), lambda x: F.trim(unescape(x)))
    return F.array_join(F.filter(texts_, lambda x: x != ""), "\n")


def nodes_text(xml: Column) -> Column:
    """The text between tags, blank ones left out."""
    return F.array_join(F.filter(F.transform(F.regexp_extract_all(xml, F.lit(">([^<>]+)<"), F.lit(1)), lambda x: F.trim(unescape(x))), lambda x: x != ""), "\n")


def chart_text(xml: Column, numbers: bool = True) -> Column:
    """Texts and values of a chart by lines; without numbers: values that are nothing else are left out."""
    found = F.regexp_extract_all(xml, F.lit(r"(?is)<a:t[^>]*>.*?</a:t>|<c:v[^>]*>.*?</c:v>"), F.lit(0))
    each = F.transform(found, lambda x: F.struct(x.rlike("(?i)^<c:v").alias("v"), F.trim(unescape(F.regexp_replace(x, r"(?is)^<(?:a:t|c:v)[^>]*>|</(?:a:t|c:v)>$", ""))).alias("t")))
    kept = F.filter(each, lambda x: (x["t"] != "") & (F.lit(numbers) | ~x["v"] | ~x["t"].rlike(r"^[0-9]+(?:\.[0-9]+)?$")))
    return F.array_join(F.transform(kept, lambda x: x["t"]), "\n")


def sheet_text(xml: Column) -> Column:
    """A sheet's values, then its inline texts, by lines."""
    of = lambda tag: F.transform(F.regexp_extract_all(xml, F.lit(rf"(?s)<{tag}(?: [^>]*)?>(.*?)</{tag}>"), F.lit(1)), unescape)
    return F.array_join(F.concat(of("v"), of("t")), "\n")


def shared_strings(xml: Column) -> Column:
    """The strings of a workbook, those of rich text joined."""
    items = F.regexp_extract_all(xml, F.lit(r"(?s)<si>.*?</si>|<si/>"), F.lit(0))
    return F.transform(items, lambda x: unescape(F.array_join(F.regexp_extract_all(x, F.lit(r"(?s)<t[^>]*>(.*?)</t>"), F.lit(1)), "")))


# What is no text of an HWPX file: tags, lines of a note's mark alone, such marks, cell ranges, a format's name.
_HWPX_TAG, _HWPX_NOTE_LINE, _HWPX_NOTE = r"<[^>\n]+>", r"^\s*\(?\^[0-9]+[).\s]*$", r"\(\^[0-9]+\)"
_HWPX_FORMAT = r"(?i)General(?=\s*[0-9])"


def _hwpx_clean(t: Column) -> Column:
    lines = F.filter(F.split(F.regexp_replace(t, _HWPX_TAG, ""), "\n", -1), lambda x: ~x.rlike(_HWPX_NOTE_LINE))
    out = F.array_join(lines, "\n")
    for rx in (_HWPX_NOTE, CELL_RANGE, _HWPX_FORMAT):
        out = F.regexp_replace(out, rx, "")
    return out


def texts(found: DataFrame) -> DataFrame:
    """(path, ext, text) of packages' members: parts in the order of their names, then charts, then the workbooks inside, cleaned
    up by the kind of package."""
    wanted = F.lit(False)
    for ext, rx in TEXT_MEMBERS.items():
        wanted = wanted | ((F.col("ext") == ext) & F.col("member").rlike(rx))
    kind = lambda ext: F.col("ext") == ext
    strings = F.array_join(shared_strings(F.col("xml")), "\n")
    main = F.when(kind("docx"), docx_text(F.when(kind("docx") & wanted, F.col("xml")))).when(kind("pptx"), pptx_text(F.col("xml"))).when(kind("xlsx"), F.when(F.col("member") == "xl/sharedStrings.xml", strings).otherwise(sheet_text(F.col("xml")))).otherwise(nodes_text(F.col("xml")))
    chart = F.when(kind("docx"), chart_text(F.col("xml"), numbers=False)).otherwise(chart_text(F.col("xml")))
    is_chart = F.col("member").rlike(CHART_MEMBERS)
    part = found.where((wanted | is_chart) & F.col("xml").isNotNull())
    # a workbook's sheets come in the order of the package, all else by name
    order = F.when(kind("xlsx"), F.concat(F.when(F.col("member") == "xl/sharedStrings.xml", "0").otherwise("1"), F.lpad(F.col("place").cast("string"), 9, "0"))).otherwise(F.col("member"))
    parts = part.select("path", "ext", is_chart.cast("int").alias("k"), order.alias("member"), line_ends(F.when(is_chart, chart).otherwise(main)).alias("part"))
    # workbooks inside: their own text is a part of the outer package's
    inner = embedded(found)
    sheets = inner.where((F.col("member").rlike(TEXT_MEMBERS["xlsx"]) | is_chart) & F.col("xml").isNotNull())
    inside = sheets.select("path", F.concat(F.when(F.col("member") == "xl/sharedStrings.xml", "0").when(is_chart, "2").otherwise("1"), F.lpad(F.col("place").cast("string"), 9, "0")).alias("member"), line_ends(F.when(is_chart, chart_text(F.col("xml"))).when(F.col("member") == "xl/sharedStrings.xml", strings).otherwise(sheet_text(F.col("xml")))).alias("part"))
    outer = found.select("path", "ext").distinct()
    inside = inside.select(F.regexp_extract("path", "(?s)^(.*?)!", 1).alias("path"), F.lit(2).alias("k"), F.concat(F.regexp_extract("path", "(?s)!(.*)$", 1), F.lit("!"), "member").alias("member"), "part").join(outer, "path").select("path", "ext", "k", "member", "part")
    joined = parts.unionByName(inside).groupBy("path", "ext").agg(F.sort_array(F.collect_list(F.struct("k", "member", "part"))).alias("p"))
    blank = F.array_join(F.transform(F.filter("p", lambda x: x["part"] != ""), lambda x: x["part"]), "\n")
    clean = F.when(kind("docx"), cleanup_text(blank, keep_tabs=True)).when(kind("pptx"), clean_extracted(blank)).when(kind("hwpx"), cleanup_text(_hwpx_clean(blank))).otherwise(cleanup_text(blank))
    return joined.select("path", "ext", clean.alias("text"))


def scan(found: DataFrame, as_of: datetime.date = validators.AS_OF) -> DataFrame:
    """(path, ext, rule, value, valid, context, location) of packages: all candidates in their merged text."""
    checked = spans.annotated(texts(found), as_of=as_of)
    each = checked.select("path", "ext", F.inline("spans"))
    where = F.struct(F.col("ext").alias("kind"), F.lit("*merged_text*").alias("part"), "start", "end")
    return each.select("path", "ext", "rule", "value", "valid", "context", where.alias("location"))


def sheet_names(found: DataFrame) -> DataFrame:
    """(path, sheet, name): the names that a workbook shows for its sheets' files."""
    attribute = lambda c, name: F.regexp_extract(c, rf'[ :]{name}="([^"]*)"', 1)
    of = lambda member, tag: found.where((F.col("ext") == "xlsx") & (F.col("member") == member)).select("path", F.explode(F.regexp_extract_all("xml", F.lit(rf"<(?:[A-Za-z]+:)?{tag} [^>]*>"), F.lit(0))).alias("_x"))
    rels = of("xl/_rels/workbook.xml.rels", "Relationship").select("path", attribute(F.col("_x"), "Id").alias("_id"), F.regexp_extract(F.replace(attribute(F.col("_x"), "Target"), F.lit("\\"), F.lit("/")), r"([^/]*)\.xml$", 1).alias("sheet"))
    named = of("xl/workbook.xml", "sheet").select("path", F.regexp_extract("_x", r'r:id="([^"]*)"', 1).alias("_id"), unescape(attribute(F.col("_x"), "name")).alias("name"))
    return named.join(rels, ["path", "_id"]).where("sheet <> ''").select("path", "sheet", F.when(F.col("name") == "", F.concat("sheet", F.lit(".xml"))).otherwise(F.col("name")).alias("name"))


def cells(found: DataFrame) -> DataFrame:
    """(path, sheet, row, col, value) of workbooks: shared and inline strings, truth values, numbers."""
    sheets = found.where((F.col("ext") == "xlsx") & F.col("member").rlike(r"^xl/worksheets/[^/]*\.xml$"))
    each = sheets.select("path", F.regexp_extract("member", r"([^/]*)\.xml$", 1).alias("sheet"), F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<c [^>]*?(?:/>|>.*?</c>)"), F.lit(0))).alias("c"))
    strings = found.where((F.col("ext") == "xlsx") & (F.col("member") == "xl/sharedStrings.xml")).select("path", F.posexplode(shared_strings(F.col("xml"))).alias("at", "string"))
    row, col = cell_reference(F.regexp_extract("c", r' r="([^"]*)"', 1))
    kind, raw = F.lower(F.regexp_extract("c", r' t="([^"]*)"', 1)), F.regexp_extract("c", r"(?s)<v>(.*?)</v>", 1)
    own = each.select("path", "sheet", row.alias("row"), col.alias("col"), kind.alias("kind"), raw.alias("raw"), unescape(F.array_join(F.regexp_extract_all("c", F.lit(r"(?s)<t[^>]*>(.*?)</t>"), F.lit(1)), "")).alias("inline"))
    own = own.withColumn("at", F.when(F.col("kind") == "s", F.col("raw").try_cast("int")))
    value = F.when(F.col("kind") == "s", F.coalesce("string", F.lit(""))).when(F.col("kind") == "inlinestr", F.col("inline")).when(F.col("kind") == "b", F.when(F.col("raw") == "1", "TRUE").otherwise("FALSE")).otherwise(unescape(F.col("raw")))
    return own.join(strings, ["path", "at"], "left").where("row is not null").select("path", "sheet", "row", "col", value.alias("value"))


def redact_members(found: DataFrame, policy: dict[str, str] | None = None, literals: list[str] | None = None, as_of: datetime.date = validators.AS_OF, only: str = REDACTED_MEMBERS) -> DataFrame:
    """The members with their text nodes redacted (each on its own: what is split over nodes isn't seen), literals masked
    too, and relationships to the outside taken out. Adds hits."""
    tag = r"<[^<>]*>"
    chosen = F.col("member").rlike(only) & F.col("xml").isNotNull()
    text = found.where(chosen).withColumn("tags", F.regexp_extract_all("xml", F.lit(tag), F.lit(0))).withColumn("gaps", F.split("xml", tag, -1))
    each = text.select("path", "member", F.posexplode("gaps").alias("k", "text"))
    done = spans.redact(each, policy=policy, as_of=as_of)
    if literals:
        done = done.withColumn("redacted", spans.replace_literals(F.col("redacted"), F.array(*[F.lit(x) for x in literals]), masks.keep_rules))
    lists = done.groupBy("path", "member").agg(F.sort_array(F.collect_list(F.struct("k", "redacted"))).alias("l"), F.sum("hits").cast("int").alias("hits"))
    gaps = F.transform("l", lambda x: x["redacted"])
    xml = F.array_join(F.flatten(F.zip_with(gaps, F.col("tags"), lambda g, t: F.array(g, F.coalesce(t, F.lit(""))))), "")
    changed = text.join(lists, ["path", "member"]).select("path", "ext", "member", "place", encode_xml(xml, F.col("encoding"), F.col("data")).alias("data"), "error", "encoding", xml.alias("xml"), "hits", (F.col("hits") > 0).alias("modified"))
    rels = F.when(F.col("member").rlike(r"(?i)charts/_rels/.*\.rels$"), without_external(F.col("xml"))).otherwise(F.col("xml"))
    other = found.where(~F.coalesce(chosen, F.lit(False))).withColumn("_r", rels).withColumn("modified", F.coalesce(F.col("_r") != F.col("xml"), F.lit(False)))
    same = other.select("path", "ext", "member", "place", F.when(F.col("modified"), encode_xml(F.col("_r"), F.col("encoding"), F.col("data"))).otherwise(F.col("data")).alias("data"), "error", "encoding", F.col("_r").alias("xml"), F.lit(0).alias("hits"), "modified")
    return changed.unionByName(same)


def is_external(relationship: Column) -> Column:
    """Whether a relationship leads out of the package."""
    mode, target = F.lower(F.regexp_extract(relationship, r'(?i) TargetMode="\s*([^"]*?)\s*"', 1)), F.lower(F.regexp_extract(relationship, r'(?i) Target="\s*([^"]*)"', 1))
    return (mode == "external") | target.rlike("^(?:https?://|file:|mailto:)")


def without_external(xml: Column) -> Column:
    """Relationships without those that lead out of the package."""
    element = r"(?i)<Relationship [^>]*?(?:/>|></Relationship>)"
    gaps, own = F.split(xml, element, -1), F.regexp_extract_all(xml, F.lit(element), F.lit(0))
    return F.array_join(F.flatten(F.zip_with(gaps, own, lambda g, r: F.array(g, F.when(r.isNull() | is_external(r), F.lit("")).otherwise(r)))), "")


def hwpx_settings(found: DataFrame) -> DataFrame:
    """HWPX members with their preview blanked (a picture of one clear point) and its use and the cache switched off."""
    settings = F.regexp_replace(F.regexp_replace(F.regexp_replace("xml", r'(?i)usepreview\s*=\s*"(?:true|1)"', 'usePreview="false"'), r"(?is)<preview>.*?</preview>", "<preview>0</preview>"), r"(?is)<cache>.*?</cache>", "<cache>0</cache>")
    is_settings = (F.col("ext") == "hwpx") & F.col("member").rlike(r"(?i)settings\.xml$") & F.col("xml").isNotNull()
    is_preview = (F.col("ext") == "hwpx") & F.col("member").rlike(r"(?i)^preview/.*\.(?:png|jpe?g|bmp|gif|tiff?)$")
    own = found.withColumn("_x", F.when(is_settings, settings).otherwise(F.col("xml")))
    changed = is_settings & (F.col("_x") != F.col("xml"))
    data = F.when(is_preview, F.lit(blank_png())).when(changed, encode_xml(F.col("_x"), F.col("encoding"), F.col("data"))).otherwise(F.col("data"))
    new = {"data": data, "xml": F.col("_x")} | ({"modified": F.col("modified") | F.coalesce(is_preview | changed, F.lit(False))} if "modified" in found.columns else {})
    return own.withColumns(new).drop("_x")


def blank_png() -> bytes:
    """A picture of one transparent point."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(5))) + chunk(b"IEND", b"")


def secrets(found: DataFrame) -> DataFrame:
    """(path, values): every match of every rule in a package's text, valid or not, each once, as they come."""
    return texts(found).select("path", F.array_distinct(F.transform(spans.candidates(F.col("text")), lambda x: x["value"])).alias("values"))


def redact_packages(files: DataFrame, policy: dict[str, str] | None = None, literals: list[str] | None = None, as_of: datetime.date = validators.AS_OF) -> DataFrame:
    """(path, content, n_members, hits, kept, modified, errors) of packages: members redacted, workbooks inside them too, previews
    and outside relationships taken out. What can't be read stays out of the package and is counted."""
    found = members(files)
    inner = pack(redact_members(embedded(found), policy, literals, as_of)).select(F.regexp_extract("path", "(?s)^(.*?)!", 1).alias("path"), F.regexp_extract("path", "(?s)!(.*)$", 1).alias("member"), F.col("content").alias("_content"), F.col("hits").alias("_hits"))
    outer = hwpx_settings(redact_members(found, policy, literals, as_of)).join(inner, ["path", "member"], "left")
    outer = outer.withColumn("data", F.when(F.col("_hits") > 0, F.col("_content")).otherwise(F.col("data"))).withColumn("modified", F.col("modified") | F.coalesce(F.col("_hits") > 0, F.lit(False))).withColumn("hits", F.col("hits") + F.coalesce("_hits", F.lit(0)))
    counts = member_counts(outer)
    return pack(outer).join(counts, "path").select("path", "content", "n_members", "hits", "kept", "modified", "errors")


def member_counts(found: DataFrame) -> DataFrame:
    """(path, kept, modified, errors): members as they were, changed, and those that can't be read."""
    return found.groupBy("path").agg(F.count_if(F.col("error").isNull() & ~F.col("modified")).alias("kept"), F.count_if("modified").alias("modified"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def pack(found: DataFrame) -> DataFrame:
    """(path, content, n_members, hits): the members of each path as a package again, in their order."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
            for row in rows.sort_values("place").itertuples():
                package.writestr(zipfile.ZipInfo(row.member, (1980, 1, 1, 0, 0, 0)), row.data)
        return pd.DataFrame([(rows["path"].iloc[0], out.getvalue(), len(rows), int(rows["hits"].sum()))], columns=["path", "content", "n_members", "hits"])

    return found.where("member is not null and data is not null").select("path", "member", "place", "data", "hits").groupBy("path").applyInPandas(one, "path string, content binary, n_members int, hits int")


def xml_text(content: Column) -> tuple[Column, Column]:
    """(encoding, text) of XML bytes (see ``decoded``)."""
    own = decode_xml(content)
    return own["encoding"], own["text"]


def package(parts: dict[str, str]) -> bytes:
    """A small package of these members, for tests and demonstrations."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return out.getvalue()
