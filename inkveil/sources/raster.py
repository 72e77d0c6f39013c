"""Pictures as arrays of points, without a library: PNG of eight bits a channel (not interlaced) and BMP of 24 or 32 bits. Blocks are
covered, and pictures made smaller for display. Others are left alone and said so: nothing is covered in them."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.sources.compound import Broken

PNG = b"\x89PNG\r\n\x1a\n"
#: Channels of a PNG by its colour type; points of a picture beyond which it isn't read; the longer side of a preview.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
MOST, PREVIEW = 1 << 28, 1600
FAULTS = (Broken, struct.error, zlib.error, ValueError, KeyError, IndexError, OverflowError)


def _unfiltered(raw: np.ndarray, height: int, line: int, width: int) -> np.ndarray:
    """Undoes the difference that each line of a PNG is stored as."""
    rows = raw[: height * (line + 1)].reshape(height, line + 1)
    out = np.zeros((height + 1, line), np.uint8)
    for y in range(height):
        kind, own, up = rows[y, 0], rows[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = own
        elif kind == 1:
            for c in range(width):
                out[y + 1, c::width] = np.cumsum(own[c::width], dtype=np.uint64).astype(np.uint8)
        elif kind == 2:
            out[y + 1] = own + up
        elif kind in (3, 4):
            row = out[y + 1]
            for x in range(line):
                left, above = (int(row[x - width]) if x >= width else 0), int(up[x])
                if kind == 3:
                    guess = (left + above) // 2
                else:
                    corner = int(up[x - width]) if x >= width else 0
                    away = [(abs(above - corner), 0, left), (abs(left - corner), 1, above), (abs(left + above - 2 * corner), 2, corner)]
                    guess = min(away)[2]
                row[x] = (int(own[x]) + guess) & 255
        else:
            raise Broken("unknown filter")
    return out[1:]


def read(data: bytes) -> tuple[np.ndarray, dict]:
    """(points: height, width, channels; what writing it again takes)."""
    if data.startswith(PNG):
        at, parts, chunks = 8, [], []
        while at + 12 <= len(data):
            size, name = struct.unpack_from(">I4s", data, at)
            body = data[at + 8 : at + 8 + size]
            if name == b"IDAT":
                parts.append(body)
            else:
                chunks.append((name, body))
            at += 12 + size
        width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", dict(chunks)[b"IHDR"][:13])
        if depth != 8 or laced or colour not in CHANNELS or width * height > MOST:
            raise Broken("a kind of picture that isn't read")
        n = CHANNELS[colour]
        unpack = zlib.decompressobj()
        raw = np.frombuffer(unpack.decompress(b"".join(parts), height * (width * n + 1)), np.uint8)
        return _unfiltered(raw, height, width * n, n).reshape(height, width, n), {"kind": "png", "chunks": chunks, "colour": colour}
    if data.startswith(b"BM"):
        offset, header, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
        if bits not in (24, 32) or packed or width <= 0 or width * abs(height) > MOST:
            raise Broken("a kind of picture that isn't read")
        line = (width * bits // 8 + 3) // 4 * 4
        rows = np.frombuffer(data, np.uint8, line * abs(height), offset).reshape(abs(height), line)[:, : width * bits // 8].reshape(abs(height), width, bits // 8)
        return rows[::-1] if height > 0 else rows, {"kind": "bmp", "head": data[:offset], "up": height > 0, "tail": data[offset + line * abs(height) :], "line": line}
    raise Broken("no picture that is read")


def write(points: np.ndarray, how: dict) -> bytes:
    height, width, n = points.shape
    if how["kind"] == "png":
        raw = np.concatenate([np.zeros((height, 1), np.uint8), points.reshape(height, width * n)], axis=1).tobytes()
        chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
        head = struct.pack(">IIBBBBB", width, height, 8, how["colour"], 0, 0, 0)
        kept = [c for c in how["chunks"] if c[0] in (b"PLTE", b"tRNS", b"gAMA", b"sRGB", b"pHYs")]
        return PNG + chunk(b"IHDR", head) + b"".join(chunk(*c) for c in kept) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")
    rows = np.zeros((height, how["line"]), np.uint8)
    rows[:, : width * n] = points.reshape(height, width * n)
    return how["head"] + (rows[::-1] if how["up"] else rows).tobytes() + how["tail"]


def covered(data: bytes, boxes: list[dict]) -> bytes:
    """The picture with boxes (x0, y0, x1, y1, in points from the upper left) black, by whole points; texts beside the points go."""
    points, how = read(data)
    points = points.copy()
    height, width, n = points.shape
    for b in boxes:
        x0, y0, x1, y1 = max(0, int(np.floor(b["x0"]))), max(0, int(np.floor(b["y0"]))), min(width, int(np.ceil(b["x1"]))), min(height, int(np.ceil(b["y1"])))
        own = points[y0:y1, x0:x1]
        own[:] = 0
        if n in (2, 4):
            own[..., -1] = 255
        if how.get("colour") == 3:  # by a palette: its darkest colour
            palette = np.frombuffer(dict(how["chunks"])[b"PLTE"], np.uint8).reshape(-1, 3)
            own[:] = palette.sum(axis=1, dtype=int).argmin()
    return write(points, how)


def smaller(data: bytes, most: int = PREVIEW) -> bytes:
    """The picture with its longer side of that many points at most, each the nearest one's; a small one as it is."""
    points, how = read(data)
    height, width, _ = points.shape
    if max(height, width) <= most:
        return data
    scale = max(height, width) / most
    pick = lambda n: np.minimum((np.arange(max(1, int(n / scale))) * scale).astype(int), n - 1)
    own = points[pick(height)][:, pick(width)]
    if how["kind"] == "bmp":  # written as a PNG, whose header doesn't depend on lines
        own, how = np.ascontiguousarray(own[..., [2, 1, 0]]), {"kind": "png", "chunks": [], "colour": 2}
    return write(own, how)


RESULT = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])


def _results(rows) -> pa.Array:
    out = []
    for make in rows:
        try:
            out.append({"content": make(), "error": None})
        except FAULTS as fault:
            out.append({"content": None, "error": f"{type(fault).__name__}: {fault}"})
    return pa.array(out, pa.struct([("content", pa.binary()), ("error", pa.string())]))


@F.arrow_udf(RESULT)
def cover(content: pa.Array, boxes: pa.Array) -> pa.Array:
    """struct<content, error> of pictures and their boxes (arrays of structs x0, y0, x1, y1)."""
    return _results([lambda c=c, b=b: covered(c or b"", b or []) for c, b in zip(content.to_pylist(), boxes.to_pylist(), strict=True)])


def shrink(content: Column, most: int = PREVIEW) -> Column:
    """struct<content, error> of pictures for display."""

    @F.arrow_udf(RESULT)
    def small(batch: pa.Array) -> pa.Array:
        return _results([lambda c=c: smaller(c or b"", most) for c in batch.to_pylist()])

    return small(content)
