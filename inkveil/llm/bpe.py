"""Byte-level BPE encoding and decoding by overlapping chunks.

Every text is cut into chunks that overlap. The chunks are pre-tokenised in parallel, neighbouring chunks are
stitched at a pre-token boundary on which both agree inside their overlap (the point where they resynchronise), and
the pieces between such points are encoded in parallel. Decoding concatenates the raw bytes of the tokens.

A chunk starts in the middle of a text, so its first pre-tokens may be wrong; a match depends only on the text from
its start on, so once both chunks have a boundary in common, the later one is right from there. Cuts are made only
behind a character that is not white space (a run of white space is matched by what follows it) and away from the
end of the earlier chunk. Where an overlap has no such point the cut is left out, along with the later ones of that
text, and the piece simply is longer: results never depend on the sizes of chunks. Texts are sliced once, so the work grows with their length.

Defined results: a null text encodes as the empty text (no ids); an empty table gives an empty table; repeated rows
and repeated ids keep a row each (long texts are matched to their ids by content); the input's
columns stay, but those named like the new ones, which are parameters, are replaced; columns with the prefix ``_bpe_`` are
not allowed in the input. Ties don't occur: of two common boundaries the first is cut at.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.llm.common import shuffle_parts, small_batches

#: Characters of a chunk, and of the overlap of two neighbours.
CHUNK, OVERLAP = 32768, 1024
#: Boundaries this near to the end of a chunk may hang on what lies beyond it.
MARGIN = 16

_cache: dict = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file whose lines hold a token in base64 and its rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file, made once in each Python worker."""
    key = (path, pattern)
    if key not in _cache:
        import tiktoken

        _cache[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
    return _cache[key]


def _byte_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens, and where each token starts and how long it is."""
    if path not in _cache:
        ranks = load_ranks(path)
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        _cache[path] = np.frombuffer(b"".join(tokens), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths
    return _cache[path]


def _encode_udf(path: str, pattern: str):
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode_batch(texts: pa.Array) -> pa.Array:
        enc = encoding(path, pattern)
        found = [enc.encode_to_numpy(t, disallowed_special=()) if t else np.empty(0, np.uint32) for t in texts.to_pylist()]
        offsets = np.zeros(len(found) + 1, dtype=np.int32)
        np.cumsum([len(x) for x in found], out=offsets[1:])
        values = np.concatenate(found).astype(np.int32) if found else np.empty(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

    return encode_batch


def decode_column(ids: Column, ranks_path: str) -> Column:
    """Raw bytes of arrays of ids. A null array gives null; an id without a token is an error."""

    @F.arrow_udf(T.BinaryType())
    def decode_batch(batch: pa.Array) -> pa.Array:
        raw, starts, lengths = _byte_table(ranks_path)
        out = []
        for x in batch:
            if not x.is_valid:
                out.append(None)
                continue
            own = x.values.to_numpy(zero_copy_only=False).astype(np.int64)
            n = lengths[own]
            if len(own) and (own.min() < 0 or not n.all()):
                raise ValueError("an id has no token")
            ends = np.cumsum(n)
            where = np.repeat(starts[own] - (ends - n), n) + np.arange(int(ends[-1]) if len(own) else 0)
            out.append(raw[where].tobytes())
        return pa.array(out, type=pa.binary())

    return decode_batch(ids)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    small_batches(df.sparkSession)
    return df.withColumn(out_col, decode_column(F.col(ids_col), ranks_path))


def _boundary_udf(pattern: str, margin: int):
    """Boundaries of pre-tokens of chunks, as offsets from the chunk's start; behind white space none counts."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def boundaries(chunks: pa.Array, lasts: pa.Array, overlaps: pa.Array) -> pa.Array:
        import regex

        rx = _cache.setdefault(pattern, regex.compile(pattern))
        out = []
        for text, last, overlap in zip(chunks.to_pylist(), lasts.to_pylist(), overlaps.to_pylist(), strict=True):
            n = len(text)
            # only the regions that this chunk shares with its neighbours are needed
            out.append([e for m in rx.finditer(text) if ((e := m.end()) <= overlap or e >= n - overlap) and (last or e <= n - margin) and not text[e - 1].isspace()])
        return pa.array(out, type=pa.list_(pa.int32()))

    return boundaries


def _cuts(rows, overlap: int) -> list[int]:
    """Where to cut a text whose chunks, in order, have these (start, length, boundaries)."""
    cuts, known = [0], None
    for start, length, bounds in rows:
        own = [start + b for b in bounds]
        if known is not None:
            common = sorted(known.intersection(b for b in own if b < start + overlap))
            common = [b for b in common if b > cuts[-1]]
            if not common:
                break
            cuts.append(common[0])
        known = {b for b in own if b >= max(cuts[-1], start + length - overlap)}
    return cuts


def _long_ids(texts: DataFrame, ranks_path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(_bpe_key, _bpe_ids) of distinct long texts (_bpe_key, _bpe_text)."""
    spark = texts.sparkSession
    step = chunk - overlap

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def sliced(whole: pa.Array) -> pa.Array:
        return pa.array([[t[a : a + chunk] for a in range(0, max(len(t) - overlap, 1), step)] for t in whole.to_pylist()], type=pa.list_(pa.string()))

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def split_at(whole: pa.Array, at: pa.Array) -> pa.Array:
        return pa.array([[t[a:b] for a, b in zip(c, [*c[1:], len(t)], strict=True)] for t, c in zip(whole.to_pylist(), at.to_pylist(), strict=True)], type=pa.list_(pa.string()))

    chunks = (
        texts.select("_bpe_key", sliced("_bpe_text").alias("_bpe_all"))
        .select("_bpe_key", F.size("_bpe_all").alias("_bpe_n"), F.posexplode("_bpe_all").alias("_bpe_i", "_bpe_chunk"))
        .select("_bpe_key", "_bpe_i", (F.col("_bpe_i") * step).alias("_bpe_start"), "_bpe_chunk", (F.col("_bpe_i") == F.col("_bpe_n") - 1).alias("_bpe_last"))
        .repartition(shuffle_parts(spark), "_bpe_key", "_bpe_i")
    )
    marks = chunks.select("_bpe_key", "_bpe_start", F.length("_bpe_chunk").alias("_bpe_len"), _boundary_udf(pattern, MARGIN)("_bpe_chunk", "_bpe_last", F.lit(overlap)).alias("_bpe_bounds"))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def stitch(found: pa.Array) -> pa.Array:
        return pa.array([_cuts([(x["_bpe_start"], x["_bpe_len"], x["_bpe_bounds"]) for x in rows], overlap) for rows in found.to_pylist()], type=pa.list_(pa.int32()))

    cuts = marks.groupBy("_bpe_key").agg(F.sort_array(F.collect_list(F.struct("_bpe_start", "_bpe_len", "_bpe_bounds"))).alias("_bpe_found")).select("_bpe_key", stitch("_bpe_found").alias("_bpe_cuts"))
    pieces = (
        texts.join(cuts, "_bpe_key")
        .select("_bpe_key", split_at("_bpe_text", "_bpe_cuts").alias("_bpe_all"))
        .select("_bpe_key", F.posexplode("_bpe_all").alias("_bpe_p", "_bpe_piece"))
        .repartition(shuffle_parts(spark), "_bpe_key", "_bpe_p")
        .select("_bpe_key", "_bpe_p", _encode_udf(ranks_path, pattern)("_bpe_piece").alias("_bpe_ids"))
    )
    return pieces.groupBy("_bpe_key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_bpe_p", "_bpe_ids"))), lambda x: x["_bpe_ids"])).alias("_bpe_ids"))


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Adds the ids of each text. A text of one chunk is one piece; longer ones go through chunks and stitches."""
    if not 0 < 2 * overlap <= chunk or overlap <= MARGIN:
        raise ValueError("overlap: more than the margin, at most half a chunk")
    small_batches(df.sparkSession)
    names = [F.col(f"`{c}`") for c in df.columns if c != ids_col]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    short = df.where(F.length(text) <= chunk).select(*names, _encode_udf(ranks_path, pattern)(text).alias(ids_col))
    long = df.where(F.length(text) > chunk).withColumn("_bpe_key", F.sha2(text, 256))
    texts = long.select("_bpe_key", text.alias("_bpe_text")).dropDuplicates(["_bpe_key"])
    ids = _long_ids(texts, ranks_path, pattern, chunk, overlap)
    return short.unionByName(long.join(ids, "_bpe_key").select(*names, F.col("_bpe_ids").alias(ids_col)))
