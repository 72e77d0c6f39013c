"""SimHash near-duplicates by tiled exact comparison.

Each text gets a fingerprint of 64 bits a lane: a bit is 1 if it is set in over half the hashes of the text's word
shingles. Equal fingerprints are folded first, so a group of copies is one node however many rows it has. The distinct
fingerprints are then dealt into tiles, and tile pairs are compared exactly, with numpy's exclusive-or and bit counts.

A tile pair is skipped if the population counts of its fingerprints differ beyond the radius: with one lane tiles are
the combinations of the population counts of the four 16-bit words, and two of them are compared only if these counts
differ by no more than the radius in all (flipping a bit changes one of them by one, so no link is lost). In
``similar`` mode a fingerprint is dealt into BANDS blocks, by the smallest of the hashes of its shingles under as many
permutations: sets of that similarity share a block with a chance of 1 - 0.2 ** 8, and sets without a common shingle none, so
the work doesn't grow with the square of the corpus. A block of one tile is compared within itself; a larger one is tiled by
classes of shingle counts: sets whose sizes differ beyond the similarity can't reach it. Large tiles are split evenly. Of each tile pair only a spanning forest of its links is returned, closest first, so a
group of thousands of near copies gives thousands of links and not millions, and no connection is lost.

``similar`` mode (the pipeline's: five words, similarity 0.8) takes distinct shingles, more lanes and a radius that a
pair of that similarity exceeds with a probability of about 1e-5, then verifies the links by the exact similarity of
the shingle sets. Where a link of the forest fails and its ends stay apart, the forest may have left out a true link for
it: the groups around such links are compared again, each pair within the radius whose ends are still apart by its
shingle sets, so the components are those of all verified links. Components come from alternating large and small stars
over the links, in the cluster.

Very long texts are taken whole; of ties between ids or links of equal distance the smaller id or hash counts.
Defined results: null and empty texts have the zero fingerprint and are linked like any other; an empty table gives no
rows; repeated rows and ids keep a row each, in the same component; a component's id is its smallest id, null ids
aside; columns of the input other than the id and the text are not read in ``components`` and all kept in ``keep_one``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from inkveil.llm.common import batches_of, cut, joined_split, shuffle_parts, small_batches, stored

#: Fingerprints of a tile, about; rows of it that are compared at once.
TILE, ROWS = 4096, 256
#: Of a tile with shingle sets, about: fingerprints, and shingles in all. Bytes and pairs that are verified at once.
SET_TILE, SET_SHINGLES, SET_BYTES, SET_PAIRS = 1024, 1 << 19, 16 << 20, 1 << 15
#: Blocks of a fingerprint in similar mode; tiles of so few fingerprints are compared without numpy.
BANDS, FEW = 8, 6


def shingle_hashes(text: bytes, size: int, distinct: bool = False) -> np.ndarray:
    """XXH64, seed 42, of the space-joined shingles of a text; A-Z count as a-z."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    slices = (joined[a:b] for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True))
    if distinct:
        slices = set(slices)
    return np.fromiter((xxh64_intdigest(x, 42) for x in slices), np.uint64, len(slices) if distinct else len(starts))


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    if not lane:
        return h
    with np.errstate(over="ignore"):
        h = (h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(lane)) & np.uint64(0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(h: np.ndarray, lanes: int = 1) -> bytes:
    """Big-endian bytes of the majority bits of each lane."""
    if not len(h):
        return bytes(8 * lanes)
    out = b""
    for lane in range(lanes):
        ones = np.zeros(64, np.int64)
        own = _mixed(h, lane).astype(">u8")
        for at in range(0, len(own), 1 << 16):
            ones += np.unpackbits(own[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out += np.packbits(2 * ones > len(h)).tobytes()
    return out


def fingerprint_columns(text: Column, shingle: int = 3, lanes: int = 1, distinct: bool = False) -> Column:
    """struct<fp: binary, n: int>: fingerprint and number of shingles."""

    @F.arrow_udf(T.StructType([T.StructField("fp", T.BinaryType()), T.StructField("n", T.IntegerType())]))
    def marks(texts: pa.Array) -> pa.Array:
        found = [shingle_hashes(t or b"", shingle, distinct) for t in texts.cast(pa.binary()).to_pylist()]
        return pa.StructArray.from_arrays([pa.array([fingerprint(h, lanes) for h in found], pa.binary()), pa.array([len(h) for h in found], pa.int32())], ["fp", "n"])

    return marks(F.coalesce(text, F.lit("")))


def min_hashes(h: np.ndarray, bands: int = BANDS) -> list[int]:
    """The smallest hash under each of some permutations, signed; none of an empty set."""
    return [int(_mixed(h, 101 + k).min().view(np.int64)) for k in range(bands)] if len(h) else []


def fingerprint_and_blocks(text: Column, shingle: int, lanes: int) -> Column:
    """struct<fp, n, m>: of the distinct shingles the fingerprint, the number and the smallest hashes."""

    @F.arrow_udf(T.StructType([T.StructField("fp", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("m", T.ArrayType(T.LongType()))]))
    def marks(texts: pa.Array) -> pa.Array:
        found = [shingle_hashes(t or b"", shingle, True) for t in texts.cast(pa.binary()).to_pylist()]
        return pa.StructArray.from_arrays([pa.array([fingerprint(h, lanes) for h in found], pa.binary()), pa.array([len(h) for h in found], pa.int32()), pa.array([min_hashes(h) for h in found], pa.list_(pa.int64()))], ["fp", "n", "m"])

    return marks(F.coalesce(text, F.lit("")))


def _few_links(fps: list[bytes], radius: int) -> list[tuple[int, int]]:
    """As ``tile_links`` of a tile with itself, for few fingerprints."""
    numbers = [int.from_bytes(x) for x in fps]
    near = sorted((d, i, j) for i, a in enumerate(numbers) for j in range(i) if (d := (a ^ numbers[j]).bit_count()) <= radius)
    root = list(range(len(fps)))
    out = []
    for _, i, j in near:
        if root[i] != root[j]:
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = [new if r == old else r for r in root]
            out.append((j, i))
    return out


def _forest(a: np.ndarray, b: np.ndarray, nodes: int) -> list[int]:
    """Indices of the pairs, in their order, that join two components that were apart."""
    root = np.arange(nodes)
    taken = []
    for at in range(0, len(a), 1 << 15):
        x, y = a[at : at + (1 << 15)], b[at : at + (1 << 15)]
        todo = np.flatnonzero(root[x] != root[y])
        if not len(todo):
            continue
        parent = root.tolist()

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for k in todo.tolist():
            p, q = find(int(x[k])), find(int(y[k]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                taken.append(at + k)
        root = np.array(parent)
        while not np.array_equal(up := root[root], root):
            root = up
    return taken


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of a spanning forest of the links of two tiles (n, lanes) of uint64; right None: of a tile with itself."""
    other, own = (left, True) if right is None else (right, False)
    n, lanes = len(left), left.shape[1]
    # with several lanes the first one alone rules out most pairs; the bound leaves 4.4 standard deviations
    first = radius if lanes == 1 else min(radius, math.ceil(radius / lanes + 4.4 * math.sqrt(radius / lanes * (1 - radius / lanes / 64))))
    found = []
    pops = np.bitwise_count(other).sum(axis=1, dtype=np.int64)
    mine = np.bitwise_count(left).sum(axis=1, dtype=np.int64)
    for at in range(0, n, ROWS):
        rows = left[at : at + ROWS]
        m = mine[at : at + ROWS]
        near = np.flatnonzero((pops >= m.min() - radius) & (pops <= m.max() + radius))  # by population counts
        if own:
            near = near[near > at]
        if not len(near):
            continue
        i, j = np.nonzero(np.bitwise_count(rows[:, :1] ^ other[near, 0][None, :]) <= first)
        j = near[j]
        i = i + at
        if own:
            i, j = i[j > i], j[j > i]
        d = np.bitwise_count(left[i] ^ other[j]).sum(axis=1, dtype=np.int64)
        ok = d <= radius
        if ok.any():
            found.append(np.stack([d[ok], i[ok], j[ok]]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    d, i, j = np.concatenate(found, axis=1)
    order = np.argsort(d, kind="stable")
    i, j = i[order], j[order]
    keep = _forest(i, j if own else j + n, n + (0 if own else len(other)))
    return i[keep], j[keep]


def _pair_links(lanes: int, radius: int):
    def run(batches):
        for batch in batches:
            out_a, out_b = [], []
            if batch.num_rows and batch.column("_r").null_count == batch.num_rows and pc.max(pc.list_value_length(batch.column("_l"))).as_py() <= FEW:
                for fps in batch.column("_l").to_pylist():
                    for i, j in _few_links(fps, radius):
                        out_a.append(fps[i])
                        out_b.append(fps[j])
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], ["a", "b"])
                continue
            tiles = [[np.frombuffer(b"".join(x), ">u8").astype(np.uint64).reshape(-1, lanes) if x is not None else None for x in batch.column(c).to_pylist()] for c in ("_l", "_r")]
            raw = batch.column("_l").to_pylist(), batch.column("_r").to_pylist()
            for k, (left, right) in enumerate(zip(*tiles, strict=True)):
                i, j = tile_links(left, right, radius)
                out_a += [raw[0][k][x] for x in i.tolist()]
                out_b += [(raw[1][k] if right is not None else raw[0][k])[x] for x in j.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], ["a", "b"])

    return run


def _tile_pairs(tiles: DataFrame, deltas: list[int], parts: int) -> DataFrame:
    """(_l, _r) of tiles (grp, cell, _sub, _t): each with itself (_r null), and with the others of cells at one of the differences.
    Pairs are made of numbers first; then each tile goes to its pairs, so no task holds the tiles of a large cell."""
    ids = tiles.select("grp", "cell", "_sub")
    left = ids.select("grp", F.col("cell").alias("_c"), F.col("_sub").alias("_s"), F.explode(F.lit(sorted(deltas))).alias("_d")).withColumn("cell", F.col("_c") + F.col("_d"))
    pairs = left.join(ids, ["grp", "cell"]).where((F.col("_d") != 0) | (F.col("_s") < F.col("_sub")))
    firsts = tiles.select("grp", F.col("cell").alias("_c"), F.col("_sub").alias("_s"), F.col("_t").alias("_l"))
    half = pairs.join(firsts, ["grp", "_c", "_s"]).select("grp", "cell", "_sub", "_l")
    keys = ["grp", "cell", "_sub"]
    both = half.repartition(parts, *keys).join(tiles.repartition(parts, *keys), keys).select("_l", F.col("_t").alias("_r"))
    own = tiles.where(F.size("_t") > 1).repartition(parts, *keys).select(F.col("_t").alias("_l"), F.lit(None).cast(tiles.schema["_t"].dataType).alias("_r"))
    return own.unionByName(both)


def links(nodes: DataFrame, lanes: int, radius: int, deltas: list[int], tile: int = TILE) -> DataFrame:
    """(a, b): a spanning forest, by tile pair, of the links between the fingerprints of (fp, cell). deltas: cells of
    no more than these differences, 0 among them, are compared."""
    spark = nodes.sparkSession
    counts = nodes.groupBy("cell").agg(F.count("*").alias("n"))
    dealt = joined_split(nodes, counts, "cell", ["fp"], 20_000).withColumn("_sub", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / tile)).cast("int"))
    tiles = stored(dealt.groupBy("cell", "_sub").agg(F.collect_list("fp").alias("_t")).withColumn("grp", F.lit(0)), "tiles")
    with batches_of(spark, 64):
        return stored(_tile_pairs(tiles, deltas, 4 * shuffle_parts(spark)).mapInArrow(_pair_links(lanes, radius), "a binary, b binary"), "tile-links")


def block_links(nodes: DataFrame, lanes: int, radius: int, tile: int = TILE) -> DataFrame:
    """(a, b): a spanning forest, by tile pair, of the links between the fingerprints of (fp, cls, m) that share a block."""
    each = nodes.select("fp", "cls", F.posexplode("m").alias("_k", "_m")).select("fp", "cls", F.xxhash64("_k", "_m").alias("block"))
    counts = stored(each.groupBy("block").agg(F.count("*").alias("n")).where("n > 1"), "blocks")
    dealt = stored(joined_split(each, counts, "block", ["fp"], 20_000), "dealt")
    small = dealt.where(F.col("n") <= tile).groupBy("block").agg(F.collect_list("fp").alias("_l"))
    small = small.select("_l", F.lit(None).cast("array<binary>").alias("_r"), (F.size("_l") > FEW).alias("_many"))
    # tiles of few fingerprints come first in each task, so that batches hold nothing else
    few = small.sortWithinPartitions("_many").select("_l", "_r").mapInArrow(_pair_links(lanes, radius), "a binary, b binary")
    large = dealt.where(F.col("n") > tile)
    if not large.limit(1).count():
        return few
    cell = F.col("block").bitwiseAND(F.lit(~127)) + F.col("cls")
    return few.unionByName(links(large.select("fp", cell.alias("cell")).distinct(), lanes, radius, [0, 1], tile))


def verified_links(fps: np.ndarray, sets: list[np.ndarray], comp: np.ndarray, split: int | None, radius: int, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within the radius that have the similarity and join two components; fps (n, lanes)
    of uint64, sets of distinct hashes, comp: the components so far, as numbers below n. split: pairs are of one node
    before it and one from it on; None: of any two."""
    n = len(fps)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    # a bit for each hash that two sets share
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    both = times[code] > 1
    owner, code = np.repeat(np.arange(n), sizes)[both], number[code[both]]
    bits = np.zeros((n, int(code.max(initial=-1)) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (owner, code >> 6), np.uint64(1) << (code & 63).astype(np.uint64))
    found = []
    for at in range(0, n if split is None else split, ROWS):
        rows = fps[at : min(at + ROWS, n if split is None else split)]
        low = at + 1 if split is None else split
        d = sum(np.bitwise_count(rows[:, k, None] ^ fps[None, low:, k]).astype(np.int16) for k in range(fps.shape[1]))
        i, j = np.nonzero(d <= radius)
        d, i, j = d[i, j], i + at, j + low
        ok = (i < j) & (comp[i] != comp[j])
        found.append(np.stack([d[ok], i[ok], j[ok]]))
    d, i, j = np.concatenate(found, axis=1)
    order = np.argsort(d, kind="stable")
    i, j = i[order], j[order]
    taken = []
    step = max(1, min(SET_PAIRS, SET_BYTES // (8 * bits.shape[1])))
    for at in range(0, len(i), step):
        x, y = i[at : at + step], j[at : at + step]
        apart = comp[x] != comp[y]
        x, y = x[apart], y[apart]
        shared = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64)
        ok = shared >= similarity * (sizes[x] + sizes[y] - shared)
        x, y = x[ok], y[ok]
        for k in _forest(comp[x], comp[y], n):
            a, b = comp[x[k]], comp[y[k]]
            comp = np.where(comp == max(a, b), min(a, b), comp)
            taken.append((int(x[k]), int(y[k])))
    return taken


def _set_links(lanes: int, radius: int, similarity: float):
    def run(batches):
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                sides = [batch.column(c)[k].values for c in ("_l", "_r") if batch.column(c)[k].is_valid]
                nodes = [x for side in sides for x in side.field("fp").to_pylist()]
                roots = [x for side in sides for x in side.field("root").to_pylist()]
                sets = [np.asarray(h.values) for side in sides for h in side.field("h")]
                numbers: dict[bytes, int] = {}
                comp = np.array([numbers.setdefault(r, len(numbers)) for r in roots])
                fps = np.frombuffer(b"".join(nodes), ">u8").astype(np.uint64).reshape(-1, lanes)
                out += [(nodes[i], nodes[j]) for i, j in verified_links(fps, sets, comp, len(sides[0]) if len(sides) > 1 else None, radius, similarity)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], ["a", "b"])

    return run


def set_links(nodes: DataFrame, lanes: int, radius: int, similarity: float) -> DataFrame:
    """(a, b): a spanning forest, by tile pair, of the verified links that join two roots of a group, of (grp, cell, fp,
    root, h). Cells of a difference of 1 at most are compared."""
    spark = nodes.sparkSession
    keyed = nodes.withColumn("_g", F.xxhash64("grp", "cell"))
    counts = keyed.groupBy("_g").agg(F.count("*").alias("n"), F.sum(F.size("h")).alias("_w"))
    share = F.greatest(F.col("n") / SET_TILE, F.col("_w") / SET_SHINGLES)
    dealt = joined_split(keyed, counts, "_g", ["fp"], 2_000).withColumn("_sub", F.pmod(F.xxhash64("fp"), F.ceil(share)).cast("int"))
    tiles = stored(dealt.groupBy("grp", "cell", "_sub").agg(F.collect_list(F.struct("fp", "root", "h")).alias("_t")), "set-tiles")
    with batches_of(spark, 4):
        return stored(_tile_pairs(tiles, [0, 1], 4 * shuffle_parts(spark)).mapInArrow(_set_links(lanes, radius, similarity), "a binary, b binary"), "set-links")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of the edges (a, b) the smallest node of its component, by alternating stars."""
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        now = cut(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == tuple(state):
            break
        before = tuple(state)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _lane_cells(fp: Column) -> Column:
    """A cell for each combination of the population counts of the four 16-bit words of a fingerprint."""
    cell = F.lit(0)
    for k in range(4):
        cell = cell * 32 + F.bit_count(F.conv(F.hex(F.substring(fp, 2 * k + 1, 2)), 16, 10).cast("int")) + 4
    return cell


def _lane_deltas(radius: int) -> list[int]:
    """Differences of cells whose counts differ by the radius at most in all: of each and its opposite, one."""
    out = {0}
    span = range(-radius, radius + 1)
    for a in span:
        for b in span:
            for c in span:
                for d in span:
                    if abs(a) + abs(b) + abs(c) + abs(d) <= radius and (a, b, c, d) > (0, 0, 0, 0):
                        out.add(((a * 32 + b) * 32 + c) * 32 + d)
    return sorted(out)


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) of each row: texts of one-lane fingerprints within the radius, transitively."""
    if not 0 <= radius <= 4:
        raise ValueError("radius: 0 to 4, the tiles of one lane are made for few bits")
    small_batches(df.sparkSession)
    marked = df.select(F.col(f"`{id_col}`").alias("_id"), fingerprint_columns(F.col(f"`{text_col}`"), shingle).alias("_m")).select("_id", F.col("_m.fp").alias("fp"))
    marked = stored(marked, "simhash")
    nodes = marked.groupBy("fp").agg(F.min("_id").alias("_least"))
    found = links(nodes.select("fp", _lane_cells(F.col("fp")).alias("cell")), 1, radius, _lane_deltas(radius))
    roots = connected(found)
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = linked.groupBy("root").agg(F.min("_least").alias("component_id"))
    of = linked.join(least, "root").select("fp", "component_id")
    return marked.join(of, "fp").select(F.col("_id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def similar_components(marked: DataFrame, docs: DataFrame, shingle: int, lanes: int, similarity: float) -> DataFrame:
    """(fp, root) of the fingerprints that have a link of that similarity; marked: (_id, _th, fp, n, m) of the documents
    (_id, _th, _text)."""
    cos = 2 * similarity / (1 + similarity)
    share = math.acos(cos) / math.pi
    bits = 64 * lanes
    radius = math.ceil(bits * share + 4.4 * math.sqrt(bits * share * (1 - share)))
    classes = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / F.lit(-math.log(similarity)) + F.lit(1e-9)).cast("int")
    nodes = marked.groupBy("fp").agg(F.min(F.struct("n", "m")).alias("x")).select("fp", "x.n", "x.m")
    found = stored(block_links(nodes.select("fp", classes.alias("cls"), "m"), lanes, radius).distinct(), "links")
    ends = found.select(F.col("a").alias("fp")).unionByName(found.select(F.col("b").alias("fp"))).distinct()
    # one text of each linked fingerprint
    chosen = marked.join(ends, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("_id", "_th")).alias("c")).select("fp", F.col("c._id").alias("_cid"), F.col("c._th").alias("_cth"))
    texts = docs.join(chosen, (docs["_th"] == chosen["_cth"]) & docs["_id"].eqNullSafe(chosen["_cid"])).groupBy("fp").agg(F.min("_text").alias("_t"))

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def sets(batch: pa.Array) -> pa.Array:
        return pa.array([shingle_hashes(t, shingle, True).view(np.int64) for t in batch.cast(pa.binary()).to_pylist()], type=pa.list_(pa.int64()))

    sets_of = stored(texts.select("fp", sets("_t").alias("_h")), "shingles")
    shared = F.size(F.array_intersect("_ha", "_hb"))
    checked = (
        found.join(sets_of.select(F.col("fp").alias("a"), F.col("_h").alias("_ha")), "a")
        .join(sets_of.select(F.col("fp").alias("b"), F.col("_h").alias("_hb")), "b")
        .where(shared >= F.lit(similarity) * (F.size("_ha") + F.size("_hb") - shared))
    )
    checked = stored(checked.select("a", "b"), "checked")
    roots = connected(checked)
    of = ends.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # links that failed and whose ends no others joined: in the place of each the forest may have left out a true one
    failed = found.join(of.select(F.col("fp").alias("a"), F.col("root").alias("_ra")), "a").join(of.select(F.col("fp").alias("b"), F.col("root").alias("_rb")), "b")
    failed = stored(failed.where("_ra != _rb").select(F.col("_ra").alias("a"), F.col("_rb").alias("b")).distinct(), "failed")
    if not failed.limit(1).count():
        return roots.withColumnRenamed("node", "fp")
    groups = connected(failed).withColumnRenamed("root", "grp").withColumnRenamed("node", "root")
    around = of.join(groups, "root").join(nodes.drop("m"), "fp").join(sets_of, "fp").select("grp", classes.alias("cell"), "fp", "root", F.col("_h").alias("h"))
    more = set_links(around, lanes, radius, similarity)
    return connected(checked.unionByName(more)).withColumnRenamed("node", "fp")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, lanes: int = 4) -> DataFrame:
    """The rows of a table without the near copies: of each component the row of the smallest id stays (null ids last). Of
    rows repeated with id and text, the one of the smallest hash of all columns stays. Only fingerprints are stored."""
    small_batches(df.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    docs = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))
    marked = docs.select("_id", "_th", fingerprint_and_blocks(F.col("_text"), shingle, lanes).alias("_m"))
    marked = stored(marked.select("_id", "_th", "_m.fp", "_m.n", "_m.m"), "near-dup")
    roots = similar_components(marked, docs.select("_id", "_th", "_text"), shingle, lanes, similarity)
    nodes = marked.groupBy("fp").agg(F.min(F.struct(F.col("_id").isNull().alias("x"), F.col("_id").alias("y"), F.col("_th").alias("th"))).alias("_f"))
    best = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")).groupBy("root").agg(F.min("_f").alias("_f"))
    best = stored(best.select(F.col("_f.y").alias("_bid"), F.col("_f.th").alias("_bth")), "kept")
    kept = docs.join(best, (docs["_th"] == best["_bth"]) & docs["_id"].eqNullSafe(best["_bid"]), "left_semi")
    again = F.row_number().over(W.partitionBy("_th", "_id").orderBy(F.xxhash64("_row")))
    return kept.select("_row", "_th", "_id").withColumn("_n", again).where("_n = 1").select("_row.*")
