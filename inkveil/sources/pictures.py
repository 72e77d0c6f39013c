"""Pictures in files: those that are members of packages or streams of compound files, and those that lie within other bytes, found
by their signatures and measured by their own structure. Rows of (path, name, kind, size, digest, content); a preview takes a
bounded number of each file, a count all of them."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from inkveil.functions.text import data_uri
from inkveil.operators.ocr import sensitive_boxes
from inkveil.sources.compound import Broken, Compound
from inkveil.sources.legacy import FAULTS, inflated
from inkveil.sources.raster import cover

# How pictures begin, and the names they are known by.
SIGNATURES = {b"\x89PNG\r\n\x1a\n": "png", b"\xff\xd8\xff": "jpg", b"GIF87a": "gif", b"GIF89a": "gif", b"BM": "bmp", b"II*\0": "tif", b"MM\0*": "tif"}
NAMES = r"(?i)\.(?:bmp|gif|jpe?g|pcx|pic|png|tiff?|emf|wmf)$"
#: Pictures of a file that a viewer shows, and that are looked for in one stream's bytes.
SHOWN, CARVED = 25, 64
_START = re.compile(b"|".join(re.escape(s) for s in (b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"GIF87a", b"GIF89a", b"BM")))


def kind_of(data: bytes) -> str | None:
    return next((kind for sign, kind in SIGNATURES.items() if data.startswith(sign)), None)


def _png_end(data: bytes, at: int) -> int:
    """Behind the last chunk; 0 if they don't lead there."""
    at += 8
    while at + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        at += 12 + size
        if name == b"IEND":
            return at if at <= len(data) else 0
    return 0


def _bmp_end(data: bytes, at: int) -> int:
    """By the size in its header, if the rest of that is a header's."""
    if at + 30 > len(data):
        return 0
    size, spare, offset, header = struct.unpack_from("<IIII", data, at + 2)
    planes, bits = struct.unpack_from("<HH", data, at + 26)
    fits = spare == 0 and header in (12, 40, 52, 56, 64, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 26 <= offset < size
    return at + size if fits and at + size <= len(data) else 0


def _jpg_end(data: bytes, at: int) -> int:
    end = data.find(b"\xff\xd9", at + 3)
    return end + 2 if end >= 0 else 0


def _gif_end(data: bytes, at: int) -> int:
    end = data.find(b"\0;", at + 13)
    return end + 2 if end >= 0 else 0


_ENDS = {"png": _png_end, "jpg": _jpg_end, "gif": _gif_end, "bmp": _bmp_end}


def carved(data: bytes, most: int = CARVED) -> list[tuple[str, int, int]]:
    """(kind, offset, bytes) of pictures within bytes, from the left, none within another."""
    out, at = [], 0
    while len(out) < most and (m := _START.search(data, at)):
        kind = kind_of(data[m.start() : m.start() + 8])
        end = _ENDS[kind](data, m.start())
        if end:
            out.append((kind, m.start(), end - m.start()))
        at = end or m.start() + 1
    return out


def _row(path: str, name: str, data: bytes, kind: str | None = None) -> tuple:
    ending = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    return path, name, kind or kind_of(data) or ending or "unknown", len(data), hashlib.sha1(data).hexdigest(), data


SCHEMA = "path string, name string, kind string, size int, digest string, content binary"


def of_members(found: DataFrame) -> DataFrame:
    """The pictures among the members of packages (see ``packages.members``)."""
    own = found.where(F.col("member").rlike(NAMES) & F.col("data").isNotNull())
    head = F.hex(F.substring("data", 1, 8))
    kind = F.lower(F.regexp_extract("member", r"\.([^.]*)$", 1))
    for sign, name in reversed(SIGNATURES.items()):
        kind = F.when(head.startswith(sign.hex().upper()), F.lit(name)).otherwise(kind)
    return own.select("path", F.col("member").alias("name"), kind.alias("kind"), F.length("data").alias("size"), F.sha1("data").alias("digest"), F.col("data").alias("content"))


def of_compound(files: DataFrame) -> DataFrame:
    """The pictures in compound files (path, ext, content): streams that are one, packed or not, and those within the streams of
    pictures and data. Each once by its digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    file = Compound(content or b"")
                    seen = set()
                    for name in sorted(file.streams):
                        data = file.read(name)
                        data = inflated(data)[0] if name.startswith("BinData/") else data
                        whole = kind_of(data) if re.search(NAMES, name) else None
                        inside = [(whole, 0, len(data))] if whole else carved(data) if re.search(r"(?:^|/)(?:Pictures|Data|Workbook|BinData/.*|\x01Ole10Native)$", name) else []
                        for kind, at, n in inside:
                            row = _row(path, name if whole else f"{name}@{at}", data[at : at + n], kind)
                            if row[4] not in seen:
                                seen.add(row[4])
                                rows.append(row)
                except (*FAULTS, Broken, zlib.error):
                    continue
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def shown(pictures: DataFrame, most: int = SHOWN) -> DataFrame:
    """(path, place, name, kind, uri) of the first pictures of each file by name, as a viewer takes them."""
    place = F.row_number().over(W.partitionBy("path").orderBy("name", "digest"))
    mime = F.concat(F.lit("image/"), F.when(F.col("kind") == "jpg", "jpeg").when(F.col("kind") == "tif", "tiff").otherwise(F.col("kind")))
    return pictures.withColumn("place", place).where(F.col("place") <= most).select("path", "place", "name", "kind", F.regexp_replace(data_uri(mime, F.col("content")), "[\r\n]", "").alias("uri"))


def summary(pictures: DataFrame) -> DataFrame:
    """(path, kind, n, size): how many pictures of each kind a file holds, and their bytes; all of them."""
    return pictures.groupBy("path", "kind").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


def type_of(content: Column) -> Column:
    """The kind of a picture by how its bytes begin; null if by none."""
    head, out = F.hex(F.substring(content, 1, 8)), F.lit(None).cast("string")
    for sign, name in reversed(SIGNATURES.items()):
        out = F.when(head.startswith(sign.hex().upper()), F.lit(name)).otherwise(out)
    return out


def redact(pictures: DataFrame, blocks: DataFrame) -> DataFrame:
    """(path, name, content, hits, error): pictures with what their recognised blocks (path, name, id, text, box) show covered. One
    without a hit stays as it is; one with hits of a kind that can't be written has no content but the reason."""
    boxes = sensitive_boxes(blocks, ["path", "name"]).groupBy("path", "name").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("boxes"), F.count("*").cast("int").alias("hits"))
    own = pictures.select("path", "name", "content").join(boxes, ["path", "name"], "left")
    done = own.withColumn("_r", F.when(F.col("hits") > 0, cover("content", "boxes")))
    return done.select("path", "name", F.when(F.col("hits") > 0, F.col("_r.content")).otherwise(F.col("content")).alias("content"), F.coalesce("hits", F.lit(0)).alias("hits"), F.col("_r.error").alias("error"))
