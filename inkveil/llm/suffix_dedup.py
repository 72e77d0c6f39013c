"""Removal of repeated strings by merged Burrows-Wheeler transforms.

A byte is removed if a string of LENGTH bytes that covers it also starts earlier: in a document of a smaller id, or in
the same document further left. Strings are judged on the input and never cross documents.

1. Every window of LENGTH bytes is assigned to an anchor, a gram chosen by the window's content (see ``anchors``), so
   equal windows meet at equal anchors. Anchors that occur once hold no repeated window and go.
2. Of what is left, a segment is the text under the run of windows of one anchor. Equal segments fold into their first
   occurrence: all windows of the others start earlier there. So a passage that a third of all documents share is one
   segment (counts and firsts are combined before they are shuffled).
3. Only anchors with two or more different segments are left to compare. Their segments are dealt out by anchor, and in
   each task, batch by batch, the transforms of shards of them are merged by interleave refinement (see ``bwt``); the
   intervals of suffixes that agree to LENGTH bytes are the repeated windows, of which the earliest stays.
4. The segments of an anchor with more than GROUP different ones are anchored again by longer grams, up to the whole window,
   and go through 2 and 3 by these: equal windows share every gram, so none is lost, and windows that share a long gram are
   few, or equal.
5. Each document's removed windows are cut out of its bytes.

Hot anchors (of a passage that a third of all documents share) are split over tasks where occurrences are joined with their
counts; everything else about them is counted or reduced before it is shuffled. Segments fold by their anchor's and their
own 64-bit hash together; unlike segments with equal ones are left to chance.

Defined results: a null text is empty; texts under LENGTH bytes keep all; an empty table gives no rows; rows repeated
with id and text are one document (each row gets its result); rows of one id and different texts are compared by place
only, so of two equal windows at the same place both stay; null ids come last; ids are integers, others raise an error; very
long texts are taken whole; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.anchors import GRAM, anchors
from inkveil.llm.bwt import earlier
from inkveil.llm.common import joined_split, shuffle_parts, small_batches, stored

LENGTH = 100
#: Bytes of segments that are merged at once (whose places are numbers of 16 bits, which are counted in one pass), shards of
#: such a batch, and segments of an anchor that a batch may hold, however long it becomes by them.
BATCH, SHARDS, GROUP = 56_000, 4, 32768
#: Occurrences of an anchor for a task, at least; anchors of too many segments up to which their list is broadcast.
HOT, HOT_LIST = 20_000, 10_000
_LAST = (1 << 63) - 1


def _documents(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a batch, and their offsets."""
    texts = batch.column(column).cast(pa.binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def _anchor_rows(length: int):
    """(g, sh, o, dk, s, e) of every anchor of the documents (o, dk, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            data, offsets = _documents(batch)
            counts = np.maximum(np.diff(offsets) - length + 1, 0)
            doc = np.repeat(np.arange(len(counts)), counts)
            starts = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[doc]
            g, first, last = anchors(data, starts, length)
            of = np.searchsorted(offsets, first, side="right") - 1
            view = memoryview(data)
            sh = np.fromiter((xxh64_intdigest(view[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)), np.uint64, len(g))
            o, dk = (batch.column(c).to_numpy(zero_copy_only=False)[of] for c in ("o", "dk"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g.view(np.int64), sh.view(np.int64), o, dk, (first - offsets[of]).astype(np.int32), (last - offsets[of]).astype(np.int32))], ["g", "sh", "o", "dk", "s", "e"])

    return run


def _segment_rows(length: int):
    """(g, o, dk, s, seg): the segments that are asked for, of (o, dk, text, list)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            for o, dk, text, wanted in zip(*(batch.column(c) for c in ("o", "dk", "text")), batch.column("list").to_pylist(), strict=True):
                raw = text.as_py().encode() if isinstance(text.as_py(), str) else text.as_py()
                for x in wanted:
                    for to, value in zip(rows, (x["g"], o.as_py(), dk.as_py(), x["s"], raw[x["s"] : x["e"] + length]), strict=True):
                        to.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int32()), pa.array(rows[4], pa.binary())], ["g", "o", "dk", "s", "seg"])

    return run


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last positions of the runs of a mask."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edges[::2], edges[1::2] - 1


def repeated_runs(o: np.ndarray, s: np.ndarray, text: np.ndarray, sizes: np.ndarray, length: int, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first, last): the runs of windows' offsets in segments that start earlier in another of them. text: the
    segments, of these sizes, one after the other."""
    begin = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(sizes)), sizes)
    offset = np.arange(len(text)) - begin[of]
    window = offset <= (sizes - length)[of]
    # places of windows, in the order of documents and starts, by small numbers
    ranks = np.unique(o, return_inverse=True)[1]
    place = np.where(window, ranks[of] * (1 << 40) + s[of] + offset, -1)
    step = max(1, -(-len(sizes) // shards))
    mask = earlier(text, begin[::step].tolist(), length, place)
    first, last = _runs(mask)  # a run never spans segments: the end of each has no window
    return of[first], offset[first], offset[last]


def _merged(length: int, batch_bytes: int, shards: int):
    """(dk, s, a, b): of sorted rows (g, o, dk, s, seg), the windows of first occurrences that start earlier elsewhere."""

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        texts = [_documents(p, "seg") for p in parts]
        o, dk, s = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) for c in ("o", "dk", "s"))
        sizes = np.concatenate([np.diff(offsets) for _, offsets in texts])
        segment, a, b = repeated_runs(o, s.astype(np.int64), np.concatenate([data for data, _ in texts]), sizes, length, shards)
        return pa.RecordBatch.from_arrays([pa.array(dk[segment]), pa.array((s[segment] + a).astype(np.int32)), pa.array((s[segment] + b).astype(np.int32))], ["dk", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("g").to_numpy(zero_copy_only=False)
            ends = _documents(batch, "seg")[1]
            starts = np.flatnonzero(g[1:] != g[:-1]) + 1
            # batches end where an anchor does, once they are large enough
            done = 0
            for at in [0, *starts.tolist()] if last is None or g[0] != last else starts.tolist():
                if size + ends[at] - ends[done] >= batch_bytes:
                    parts.append(batch.slice(done, at - done))
                    yield solve(parts)
                    parts, size, done = [], 0, at
            parts.append(batch.slice(done))
            size += int(ends[-1] - ends[done])
            last = g[-1]
        if parts:
            yield solve(parts)

    return run


def _again_rows(length: int, gram: int):
    """(g, sh, o, dk, s, e): the segments that are asked for, of (o, dk, text, list), anchored by longer grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            texts, offsets = _documents(batch)
            for k, wanted in enumerate(batch.column("list").to_pylist()):
                raw = texts[offsets[k] : offsets[k + 1]]
                o, dk = batch.column("o")[k], batch.column("dk")[k]
                for x in wanted:
                    own = raw[x["s"] : x["e"] + length]
                    g, first, last = anchors(own, np.arange(x["e"] - x["s"] + 1), length, gram)
                    with np.errstate(over="ignore"):
                        g = (g ^ np.uint64(x["g"] & ((1 << 64) - 1))) * np.uint64(0x9E3779B97F4A7C15)
                    view = memoryview(own)
                    sh = np.array([xxh64_intdigest(view[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)], np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(sh.view(np.int64)), pa.array([o.as_py()] * len(g), pa.int64()), pa.array([dk.as_py()] * len(g), pa.int64()), pa.array((first + x["s"]).astype(np.int32)), pa.array((last + x["s"]).astype(np.int32))], ["g", "sh", "o", "dk", "s", "e"])

    return run


def _cut_out(length: int):
    """(spans, kept) of (text, list): by level, of an even kind the runs of segments, of the odd one after it those that come
    first; of kind -1 windows of these that start earlier elsewhere. Runs of a level don't overlap in a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            data, offsets = _documents(batch)
            lists = batch.column("list")
            found = lists.flatten()
            doc = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
            s, e, kind = (found.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("s", "e", "kind"))
            key = ((doc << 4) + (kind >> 1)) * (1 << 40) + s
            first = (kind > 0) & (kind % 2 == 1)
            gone_rows = (kind < 0) | ((kind % 2 == 0) & ~np.isin(key, key[first]))
            change = np.zeros(len(data) + 1, np.int32)
            np.add.at(change, offsets[doc[gone_rows]] + s[gone_rows], 1)
            np.add.at(change, offsets[doc[gone_rows]] + e[gone_rows] + length, -1)
            gone = np.cumsum(change[:-1]) > 0
            # runs of removed bytes end with their document
            opens = np.concatenate([[True], ~gone[:-1]]) if len(gone) else gone
            full = offsets[:-1][np.diff(offsets) > 0]
            opens[full] = True
            starts = np.flatnonzero(gone & opens)
            closes = np.concatenate([opens[1:] | ~gone[1:], [True]]) if len(gone) else gone
            ends = np.flatnonzero(gone & closes) + 1
            of = np.searchsorted(offsets, starts, side="right") - 1
            spans = pa.StructArray.from_arrays([pa.array(starts - offsets[of]), pa.array(ends - offsets[of])], ["start", "end"])
            at = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)
            left = np.concatenate([[0], np.cumsum(~gone)])[offsets]
            kept = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(left.astype(np.int32).tobytes()), pa.py_buffer(data[~gone].tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(at), spans), kept], ["id", "n_bytes", "spans", "kept"])

    return run


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, batch: int = BATCH, shards: int = SHARDS, group: int = GROUP) -> DataFrame:
    """(id, n_bytes, spans, kept): of each document the removed runs of bytes, and the others concatenated."""
    spark = df.sparkSession
    small_batches(spark)
    ident, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kind = dict(df.select(ident.alias("id")).dtypes)["id"]
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise ValueError(f"{id_col}: ids are integers, not {kind}")
    docs = df.select(F.coalesce(ident, F.lit(_LAST)).cast("long").alias("o"), F.xxhash64(ident, text).alias("dk"), text.alias("text"))
    rows = docs.where(F.octet_length("text") >= length).mapInArrow(_anchor_rows(length), "g long, sh long, o long, dk long, s int, e int")
    twice = stored(rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    found = stored(joined_split(rows, twice, "g", ["dk", "s"], HOT).drop("n"), "repeats")

    def texts_of(segments: DataFrame) -> DataFrame:
        """(o, dk, text, list) of the documents of segments (g, dk, s, e), one row each: repeated rows share dk."""
        lists = segments.groupBy("dk").agg(F.collect_list(F.struct("g", "s", "e")).alias("list"))
        return docs.join(lists, "dk").dropDuplicates(["dk"]).select("o", "dk", "text", "list")

    of = lambda t, level: t.select("dk", F.struct("s", "e", F.lit(level).alias("kind")).alias("x"))
    grams = [GRAM, (GRAM + length) // 2, length]
    marks = None
    for level, longer in enumerate([*grams[1:], None]):
        firsts = stored(found.groupBy("g", "sh").agg(F.min(F.struct("o", "dk", "s", "e")).alias("f")).select("g", "f.*"), "firsts")
        several = stored(firsts.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "several")
        hot = several.where(F.col("n") > group).select("g")
        more = longer is not None and hot.limit(1).count() > 0
        few = several.where(F.col("n") <= group) if more else several
        if more and hot.limit(HOT_LIST + 1).count() <= HOT_LIST:
            hot = F.broadcast(hot)
        wanted = (firsts.join(hot, "g", "left_anti") if more else firsts).join(few.select("g"), "g")
        segments = texts_of(wanted).mapInArrow(_segment_rows(length), "g long, o long, dk long, s int, seg binary")
        same = segments.repartition(shuffle_parts(spark), "g").sortWithinPartitions("g").mapInArrow(_merged(length, batch, shards), "dk long, s int, e int")
        here = of(found, 2 * level).unionByName(of(firsts, 2 * level + 1)).unionByName(of(stored(same, "same"), -1))
        marks = here if marks is None else marks.unionByName(here)
        if not more:
            break
        again = texts_of(firsts.join(hot, "g")).mapInArrow(_again_rows(length, longer), "g long, sh long, o long, dk long, s int, e int")
        found = stored(again, "again")
    marks = marks.groupBy("dk").agg(F.collect_list("x").alias("list"))
    whole = df.select(ident.alias("id"), F.xxhash64(ident, text).alias("dk"), text.alias("text")).join(marks, "dk", "left").select("id", "text", F.coalesce("list", F.array().cast("array<struct<s:int,e:int,kind:int>>")).alias("list"))
    out = whole.mapInArrow(_cut_out(length), f"id {kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    return out.withColumnRenamed("id", id_col)
