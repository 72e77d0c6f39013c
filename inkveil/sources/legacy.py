"""Older office files (DOC, XLS, PPT, HWP) as rows: every text that a file holds, with the places of its bytes, found by
Arrow-batched Python; matched, mapped and masked by columns; and written back where it was, byte for byte as long.

A text's place is a list of segments (stream, offset, bytes, codec), as a text may go on in another piece or record. A masked
character becomes as many asterisks as fill its bytes, so nothing else in the file moves. Streams that are packed (HWP) are packed
again; if one doesn't fit its old place, the file's container is built anew.

What can't be read (no such file, an encrypted or a damaged one) has a row with the reason and no text."""

from __future__ import annotations

import datetime
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import masks, validators
from inkveil.functions.text import clean_hwp, clean_hwp_indexed, drop_noise_lines, line_ends, normalize, normalize_indexed, raw_runs
from inkveil.operators import spans
from inkveil.sources.compound import Broken, Compound

EXTENSIONS = ("doc", "xls", "ppt", "hwp")
SEGMENT = "struct<stream:string,at:int,n:int,codec:string>"
RUN = f"path string, ext string, k int, part string, sheet string, row int, col int, text string, segments array<{SEGMENT}>, error string"
#: Bytes of an unpacked stream beyond which it isn't read.
MOST = 256 << 20
FAULTS = (Broken, struct.error, IndexError, zlib.error, UnicodeError, ValueError, OverflowError)

Segment = tuple[str, int, int, str]


def characters(data: bytes, codec: str) -> list[tuple[str, int, int]]:
    """(character, offset, bytes) of those that decode; others are left out, and the rest stays where it is."""
    if codec == "utf-16le":
        units = np.frombuffer(data[: len(data) // 2 * 2], "<u2")
        text = units.tobytes().decode("utf-16le", "surrogatepass") if len(units) else ""
        out, at = [], 0
        for c in text:
            n = 4 if ord(c) > 0xFFFF else 2
            if not 0xD800 <= ord(c) <= 0xDFFF:
                out.append((c, at, n))
            at += n
        return out
    out, at = [], 0
    while at < len(data):
        for n in (1, 2) if codec == "cp949" else (1,):
            try:
                out.append((data[at : at + n].decode(codec), at, n))
                break
            except UnicodeDecodeError:
                continue
        else:
            n = 1
        at += n
    return out


def text_of(data: bytes, codec: str) -> str:
    return "".join(c for c, _, _ in characters(data, codec)) if codec == "cp949" else data[: len(data) // 2 * 2 if codec == "utf-16le" else None].decode(codec, "ignore")


# --- readers: (part, sheet, row, col, text, segments) ---------------------------------------------------------------------


def _run(part: str, streams: dict[str, bytes], segments: list[Segment], sheet: str | None = None, row: int | None = None, col: int | None = None) -> tuple:
    return part, sheet, row, col, "".join(text_of(streams[s][a : a + n], c) for s, a, n, c in segments), segments


def word(file: Compound) -> Iterator[tuple]:
    """The pieces of a Word document as one text, then the series of charts in it, and the texts of their drawings."""
    main = file.read("WordDocument")
    if len(main) < 0x1AA or main[:2] != b"\xec\xa5":
        raise Broken("no Word document")
    flags = struct.unpack_from("<H", main, 0x0A)[0]
    if flags & 0x0100:
        raise Broken("encrypted")
    first, length = struct.unpack_from("<II", main, 0x1A2)
    clx = file.read("1Table" if flags & 0x0200 else "0Table")[first : first + length]
    at = 0
    while clx[at] == 1:  # property modifiers before the table of pieces
        at += 3 + struct.unpack_from("<H", clx, at + 1)[0]
    if clx[at] != 2:
        raise Broken("no table of pieces")
    plc = clx[at + 5 : at + 5 + struct.unpack_from("<I", clx, at + 1)[0]]
    n = (len(plc) - 4) // 12
    ends = struct.unpack_from(f"<{n + 1}I", plc)
    segments = []
    for k in range(n):
        fc = struct.unpack_from("<I", plc, 4 * (n + 1) + 8 * k + 2)[0]
        width, codec = (1, "cp1252") if fc & 0x40000000 else (2, "utf-16le")
        start = (fc & 0x3FFFFFFF) // (2 if width == 1 else 1)
        size = (ends[k + 1] - ends[k]) * width
        if size > 0 and start + size <= len(main):
            segments.append(("WordDocument", start, size, codec))
    yield _run("body", {"WordDocument": main}, segments)
    for path in sorted(file.streams):
        if re.fullmatch(r"ObjectPool/(?:.*/)?\x01?Workbook", path):
            book = file.read(path)
            for kind, a, size in records(book):
                if kind == 0x100D and size >= 4:
                    yield _run("chart", {path: book}, [_short_string(path, book, a + 2, a + size, "cp949")])


    for path in sorted(file.streams):
        if path.startswith("ObjectPool/") and path.endswith("EPRINT"):
            drawing = file.read(path)
            for kind, a, size in drawing_records(drawing):
                if kind in (0x53, 0x54) and size >= 76:
                    n, at = struct.unpack_from("<II", drawing, a + 44)
                    width = kind - 0x52
                    yield _run("drawing", {path: drawing}, [(path, a + at, max(0, min(n * width, size - at)), "utf-16le" if width == 2 else "cp949")])


def drawing_records(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(kind, offset, bytes) of a drawing's records, heads included."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<II", data, at)
        if size < 8 or at + size > len(data):
            return
        yield kind, at, size
        at += size


def records(book: bytes) -> Iterator[tuple[int, int, int]]:
    """(kind, offset of the payload, its bytes) of a workbook's records."""
    at = 0
    while at + 4 <= len(book):
        kind, size = struct.unpack_from("<HH", book, at)
        if at + 4 + size > len(book):
            return
        yield kind, at + 4, size
        at += 4 + size


def _string(path: str, book: bytes, at: int, limit: int, codec: str, counted: str = "<H") -> Segment:
    """The place of a string: a count of characters, flags, characters of one or two bytes."""
    head = struct.calcsize(counted)
    count, high = struct.unpack_from(counted, book, at)[0], book[at + head] & 1
    start = at + head + 1
    return path, start, max(0, min(count * (1 + high), limit - start)), "utf-16le" if high else codec


def _short_string(path: str, book: bytes, at: int, limit: int, codec: str) -> Segment:
    return _string(path, book, at, limit, codec, "<B")


class _Parts:
    """The payload of a record and of those that continue it, read across their borders."""

    def __init__(self, path: str, book: bytes, places: list[tuple[int, int]]) -> None:
        self.path, self.book, self.places = path, book, places
        self.part, self.at = 0, places[0][0]

    def _end(self) -> int:
        return sum(self.places[self.part])

    def _next(self) -> None:
        self.part += 1
        if self.part >= len(self.places):
            raise Broken("a string is cut short")
        self.at = self.places[self.part][0]

    def number(self, form: str) -> int:
        n = struct.calcsize(form)
        if self.at + n > self._end():
            self._next()
        self.at += n
        return struct.unpack_from(form, self.book, self.at - n)[0]

    def skip(self, n: int) -> None:
        while n > (here := self._end() - self.at):
            n -= here
            self._next()
        self.at += n

    def string(self, count: int, high: int) -> list[Segment]:
        """Segments of so many characters; a part that goes on with them begins with their width again."""
        out = []
        while count:
            width = 1 + high
            n = min(count, (self._end() - self.at) // width)
            if n:
                out.append((self.path, self.at, n * width, "utf-16le" if high else "latin-1"))
                self.at += n * width
                count -= n
            if count:
                self._next()
                high = self.number("<B") & 1
        return out


def _shared(path: str, book: bytes, every: list[tuple[int, int, int]]) -> list[list[Segment]]:
    """The shared strings of a workbook."""
    k = next((k for k, (kind, _, _) in enumerate(every) if kind == 0xFC), None)
    if k is None:
        return []
    places = [every[k][1:]]
    while k + len(places) < len(every) and every[k + len(places)][0] == 0x3C:
        places.append(every[k + len(places)][1:])
    parts = _Parts(path, book, places)
    parts.number("<I")
    out = []
    for _ in range(parts.number("<I")):
        count, flags = parts.number("<H"), parts.number("<B")
        runs = parts.number("<H") if flags & 8 else 0
        extra = parts.number("<I") if flags & 4 else 0
        out.append(parts.string(count, flags & 1))
        parts.skip(4 * runs + extra)
    return out


def _rk(value: int) -> float:
    """A number in 30 bits: an integer or the upper half of a double, or a hundredth of it."""
    number = float(struct.unpack("<i", struct.pack("<I", value))[0] >> 2) if value & 2 else struct.unpack("<d", struct.pack("<Q", (value & 0xFFFFFFFC) << 32))[0]
    return number / 100 if value & 1 else number


def _plain(number: float) -> str:
    return str(int(number)) if abs(number) < 1e15 and abs(number - int(number)) < 1e-9 else str(number)


def excel(file: Compound) -> Iterator[tuple]:
    """Cells sheet by sheet (text cells have the place of their shared string, other cells none), headers and footers, text
    boxes, and shared strings that no cell shows."""
    path = next((p for p in ("Workbook", "Book") if p in file.streams), None)
    if path is None:
        raise Broken("no workbook")
    book = file.read(path)
    every = list(records(book))
    if any(kind == 0x2F for kind, _, _ in every):
        raise Broken("encrypted")
    streams = {path: book}
    shared = _shared(path, book, every)
    texts = [_run("cell", streams, s)[4] for s in shared]
    names = {struct.unpack_from("<I", book, a)[0]: _run("", streams, [_short_string(path, book, a + 6, a + n, "latin-1")])[4] for kind, a, n in every if kind == 0x85 and n >= 8}
    sheet, used = None, set()
    later = []
    for k, (kind, a, n) in enumerate(every):
        if kind == 0x809 and a - 4 in names:
            sheet = names[a - 4]
        cell = struct.unpack_from("<HH", book, a) if n >= 6 else (0, 0)
        at = {"sheet": sheet, "row": cell[0] + 1, "col": cell[1] + 1}
        if kind == 0xFD and n >= 10:
            string = struct.unpack_from("<I", book, a + 6)[0]
            if string < len(shared):
                used.add(string)
                yield "cell", sheet, at["row"], at["col"], texts[string], shared[string]
        elif kind == 0x203 and n >= 14:
            yield "number", sheet, at["row"], at["col"], _plain(struct.unpack_from("<d", book, a + 6)[0]), []
        elif kind == 0x27E and n >= 10:
            yield "number", sheet, at["row"], at["col"], _plain(_rk(struct.unpack_from("<I", book, a + 6)[0])), []
        elif kind == 0xBD and n >= 12:
            for c in range((n - 6) // 6):
                yield "number", sheet, at["row"], at["col"] + c, _plain(_rk(struct.unpack_from("<I", book, a + 6 + 6 * c)[0])), []
        elif kind == 0x204 and n >= 9:
            yield _run("cell", streams, [_string(path, book, a + 6, a + n, "latin-1")], **at)
        elif kind in (0x14, 0x15) and n >= 3:
            later.append(_run("header", streams, [_string(path, book, a, a + n, "latin-1")], sheet))
        elif kind == 0x1B6 and n >= 14:
            count, formats = struct.unpack_from("<HH", book, a + 10)
            if not is_text_object(count, formats):
                continue
            places = []
            while k + 1 + len(places) < len(every) and every[k + 1 + len(places)][0] == 0x3C:
                places.append(every[k + 1 + len(places)][1:])
            if count and places:
                parts = _Parts(path, book, places)
                later.append(_run("textbox", streams, parts.string(count, parts.number("<B") & 1), sheet))
    yield from later
    for k in sorted(set(range(len(shared))) - used):
        yield _run("shared", streams, shared[k])


def is_text_object(count: int, formats: int) -> bool:
    """Whether a text box's head tells of a text: characters, and formats of eight bytes each, two at least."""
    return count > 0 and formats >= 16 and formats % 8 == 0


def powerpoint(file: Compound) -> Iterator[tuple]:
    """Text atoms in the order of the records, containers opened."""
    path = "PowerPoint Document"
    show = file.read(path)
    at = 0
    while at + 8 <= len(show):
        version, kind, size = struct.unpack_from("<HHI", show, at)
        at += 8
        if version & 0xF == 0xF:
            continue  # a container: its records follow
        if at + size > len(show):
            return
        if kind in (0x0FA0, 0x0FA8) and size:
            yield _run("body", {path: show}, [(path, at, size, "utf-16le" if kind == 0x0FA0 else "cp949")])
        at += size


def inflated(data: bytes) -> tuple[bytes, int]:
    """A packed stream's content and the window it was packed with: raw, else with a header; 0: it isn't packed."""
    for window in (-15, 15):
        try:
            unpack = zlib.decompressobj(window)
            out = unpack.decompress(data, MOST)
            if unpack.unconsumed_tail:
                raise Broken(f"larger than {MOST} bytes unpacked")
            return out, window
        except zlib.error:
            continue
    return data, 0


def section_order(path: str) -> tuple[int, str]:
    """Sections by their number; what has none comes last."""
    digits = re.sub(r"[^0-9]", "", path.rsplit("/", 1)[-1])
    return (int(digits) if digits else 10**9), path


def hangul(file: Compound) -> Iterator[tuple]:
    """Paragraphs of the sections of an HWP document, as stored: controls are part of the text."""
    flags = struct.unpack_from("<I", file.read("FileHeader"), 36)[0] if "FileHeader" in file.streams else 0
    if flags & 2:
        raise Broken("encrypted")
    for path in sorted((p for p in file.streams if p.startswith("BodyText/Section")), key=section_order):
        data = inflated(file.read(path))[0]
        at = 0
        while at + 4 <= len(data):
            head = struct.unpack_from("<I", data, at)[0]
            tag, size = head & 0x3FF, head >> 20
            at += 4
            if size == 0xFFF:
                if at + 4 > len(data):
                    return
                size = struct.unpack_from("<I", data, at)[0]
                at += 4
            size = min(size, len(data) - at)
            if tag == 67:
                yield _run("body", {path: data}, [(path, at, size, "utf-16le")])
            at += size


READERS = {"doc": word, "xls": excel, "ppt": powerpoint, "hwp": hangul}


def runs(files: DataFrame) -> DataFrame:
    """(path, ext, k, part, sheet, row, col, text, segments, error): the texts of files (path, ext, content) in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in RUN.split(", ")]
        for batch in batches:
            for path, ext, content in zip(batch["path"], batch["ext"], batch["content"], strict=True):
                rows = []
                try:
                    for k, (part, sheet, row, col, text, segments) in enumerate(READERS[ext](Compound(content or b""))):
                        rows.append((path, ext, k, part, sheet, row, col, text, [dict(zip(("stream", "at", "n", "codec"), s, strict=True)) for s in segments], None))
                except FAULTS as fault:
                    rows.append((path, ext, -1, None, None, None, None, None, None, f"{type(fault).__name__}: {fault}"))
                yield pd.DataFrame(rows, columns=columns).astype({"row": "Int32", "col": "Int32"})

    return files.where(F.col("ext").isin(*EXTENSIONS)).select("path", "ext", "content").mapInPandas(run, RUN)


# --- texts, grids, redaction ------------------------------------------------------------------------------------------------


def texts(found: DataFrame) -> DataFrame:
    """(path, ext, text) of runs: of a DOC normalised, of an XLS cells with strings, then headers and text boxes, of a PPT without the
    noise of its master, of an HWP paragraph by paragraph cleaned."""
    order = F.when(F.col("part") == "header", 1).when(F.col("part") == "textbox", 2).when(F.col("part") == "chart", 1).otherwise(0)
    shown = found.where(F.col("text").isNotNull() & ~F.col("part").isin("number", "shared", "drawing"))
    part = F.when(F.col("ext") == "hwp", clean_hwp(F.col("text"))).when(F.col("part") == "chart", F.trim("text")).otherwise(F.col("text"))
    lists = shown.withColumn("_o", order).withColumn("_t", part).where((F.col("_t") != "") | (F.col("ext") == "hwp")).groupBy("path", "ext").agg(F.sort_array(F.collect_list(F.struct("_o", "k", "_t"))).alias("_l"))
    joined = F.array_join(F.transform("_l", lambda x: x["_t"]), "\n")
    out = F.when(F.col("ext") == "doc", normalize(joined)).when(F.col("ext") == "ppt", drop_noise_lines(line_ends(joined))).otherwise(joined)
    return lists.select("path", "ext", out.alias("text"))


def cells(found: DataFrame) -> DataFrame:
    """(path, sheet, row, col, value) of workbooks, as ``tables.dense`` takes them."""
    return found.where((F.col("ext") == "xls") & F.col("row").isNotNull() & F.col("part").isin("cell", "number")).select("path", "sheet", "row", "col", F.col("text").alias("value"))


def masked(raw: Column, at: Column, found: Column, policy: dict[str, str] | None = None) -> Column:
    """A raw text with the valid spans of its normalised form masked: each by its rule, run by run of neighbours in the raw text."""
    def one(text: Column, x: Column) -> Column:
        mask = F.when(F.lower(x["rule"]) == "email", masks.document_email(x["value"])).otherwise(masks.binary_mask(x["rule"], x["value"], policy))
        part = lambda r: F.substring(mask, r["norm_start"] - x["start"] + 1, r["end"] - r["start"])
        return F.aggregate(raw_runs(at, x["start"], x["end"]), text, lambda t, r: F.overlay(t, part(r), r["start"] + 1, r["end"] - r["start"]))

    return F.aggregate(found, raw, one)


def redacted_runs(found: DataFrame, policy: dict[str, str] | None = None, as_of: datetime.date = validators.AS_OF) -> DataFrame:
    """(path, ext, k, text, new, segments, hits, values) of the runs that hold a valid match. DOC and HWP texts are matched in their
    normalised or cleaned form; a text of a chart or its drawing with a match
    is masked as a whole."""
    own = found.where(F.col("text").isNotNull() & (F.size("segments") > 0)).dropDuplicates(["path", "segments"])
    indexed = F.when(F.col("ext") == "hwp", clean_hwp_indexed("text")).otherwise(normalize_indexed("text"))
    whole = F.struct(F.col("text").alias("text"), F.sequence(F.lit(0), F.length("text") - 1).alias("at"))
    x = F.when(F.col("ext").isin("doc", "hwp"), indexed).when(F.length("text") > 0, whole)
    own = spans.fixed(own, _x=x).where("_x is not null").withColumn("_n", F.col("_x.text"))
    checked = spans.annotated(own, "_n", as_of=as_of)
    valid = F.filter(spans.filter_overlapping(F.col("spans")), lambda s: s["valid"])
    hits = spans.fixed(checked, _v=valid).where(F.size("_v") > 0)
    new = F.when(F.col("part").isin("chart", "drawing"), F.repeat(F.lit("*"), F.length("text"))).otherwise(masked(F.col("text"), F.col("_x.at"), F.col("_v"), policy))
    return hits.select("path", "ext", "k", "text", new.alias("new"), "segments", F.size("_v").alias("hits"), F.transform("_v", lambda s: s["value"]).alias("values"))


def patched(streams: dict[str, bytearray], segments: list[dict], old: str, new: str) -> None:
    """Writes a text's changed characters over the old ones, each as many bytes as it had."""
    k = 0
    for s in segments:
        raw = streams[s["stream"]]
        for c, at, n in characters(bytes(raw[s["at"] : s["at"] + s["n"]]), s["codec"]):
            if k < len(new) and new[k] != c:
                sign = new[k].encode(s["codec"], "replace")
                fits = sign if len(sign) == n else "*".encode(s["codec"]) * (n // len("*".encode(s["codec"])))
                raw[s["at"] + at : s["at"] + at + n] = fits
            k += 1
    if k != len(new) or len(old) != len(new):
        raise Broken("a text changed its length")


def without_values(data: bytes, values: list[str]) -> bytes:
    """Values masked wherever they stand in bytes, in UTF-16, UTF-8 and the Korean code page, the longest first; hyphens and @
    stay, and so does the length."""
    for value in sorted(set(values), key=lambda v: (-len(v), v)):
        for codec in ("utf-16le", "utf-8", "cp949"):
            try:
                parts = [c.encode(codec) for c in value]
            except UnicodeEncodeError:
                continue
            star = "*".encode(codec)
            data = data.replace(b"".join(parts), b"".join(p if c in "-@" else star * (len(p) // len(star)) for c, p in zip(value, parts, strict=True)))
    return data


_ADDRESS = rb"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"


def without_addresses(data: bytes) -> bytes:
    """E-mail addresses in ASCII or UTF-16 bytes masked but for hyphens and @, as long as they were."""
    data = re.sub(_ADDRESS, lambda m: re.sub(rb"[^@-]", b"*", m.group()), data)
    pair = lambda inner: rb"(?:" + inner + rb"\x00)"
    address = pair(rb"[A-Za-z0-9._%+-]") + rb"+@\x00(?:" + pair(rb"[A-Za-z0-9-]") + rb"+\.\x00)+" + pair(rb"[A-Za-z]") + rb"{2,}"
    return re.sub(address, lambda m: b"".join(m.group()[k : k + 2] if m.group()[k : k + 1] in (b"@", b"-") else b"*\0" for k in range(0, len(m.group()), 2)), data)


def _repacked(path: str, old: bytes, new: bytes, window: int) -> bytes:
    """A stream packed again; shorter ones are filled up, so most keep their place."""
    if not window:
        return new
    packer = zlib.compressobj(9, zlib.DEFLATED, window)
    out = packer.compress(new) + packer.flush()
    return out.ljust(len(old), b"\0")


def written(content: bytes, ext: str, changes: list[dict]) -> bytes:
    """A file with the texts of changes (text, new, segments, values) written over the old ones."""
    file = Compound(content)
    windows: dict[str, int] = {}
    streams: dict[str, bytearray] = {}

    def load(path: str) -> None:
        if path not in streams:
            data, windows[path] = inflated(file.read(path)) if ext == "hwp" and path.startswith(("BodyText/", "BinData/")) else (file.read(path), 0)
            streams[path] = bytearray(data)

    for change in changes:
        for s in change["segments"]:
            load(s["stream"])
        patched(streams, list(change["segments"]), change["text"], change["new"])
    if ext == "hwp":  # what else shows the text: the preview, and objects inside
        values = [v for change in changes for v in change["values"]]
        for path in file.streams:
            if path == "PrvImage":
                streams[path], windows[path] = bytearray(len(file.read(path))), 0
            elif path == "PrvText" or path.startswith("BinData/"):
                load(path)
                streams[path][:] = without_addresses(without_values(bytes(streams[path]), values))
    done = {}
    for path, data in streams.items():
        old = file.read(path)
        if windows[path] and bytes(data) == inflated(old)[0]:
            continue
        done[path] = _repacked(path, old, bytes(data), windows[path])
    same = all(len(new) == len(file.read(path)) for path, new in done.items())
    return file.written(done) if same else file.rebuilt(done)


def redact(files: DataFrame, policy: dict[str, str] | None = None, as_of: datetime.date = validators.AS_OF) -> DataFrame:
    """(path, ext, content, hits, error) of files (path, ext, content): valid matches masked in place. A file that can't be read has
    no content but the reason, so that it isn't taken for a clean one."""
    found = runs(files)
    changes = redacted_runs(found, policy, as_of).groupBy("path").agg(F.collect_list(F.struct("text", "new", "segments", "values")).alias("changes"), F.sum("hits").cast("int").alias("hits"))
    errors = found.where("error is not null").groupBy("path").agg(F.min("error").alias("error"))
    own = files.where(F.col("ext").isin(*EXTENSIONS)).select("path", "ext", "content").join(changes, "path", "left").join(errors, "path", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, ext, content, changes_, hits, error in zip(*(batch[c] for c in ("path", "ext", "content", "changes", "hits", "error")), strict=True):
                if error is None and changes_ is not None:
                    try:
                        content = written(content, ext, list(changes_))
                    except FAULTS as fault:
                        error = f"{type(fault).__name__}: {fault}"
                rows.append((path, ext, None if error else content, 0 if pd.isna(hits) else int(hits), error))
            yield pd.DataFrame(rows, columns=["path", "ext", "content", "hits", "error"])

    return own.mapInPandas(run, "path string, ext string, content binary, hits int, error string")
