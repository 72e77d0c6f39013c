"""Benchmark decontamination by a size-partitioned MinHash containment search, in SQL functions only.

Test items are short and documents may be long, so their Jaccard similarity says little; containment of an item's
shingles in the document is what counts. Items are partitioned by size (powers of two of their number of distinct
shingles), and the sketch of an item is its bottom-k MinHash: the k smallest hashes of its shingles, k being one more
than the shingles that an item of the partition's largest size may miss at the asked containment. If an item is
contained to that degree, at least one of its k sketch shingles is in the document (pigeonhole), so the search loses
nothing. Documents are probed shingle by shingle as a stream, whole and without a sketch of their own, so their length
doesn't matter; shingles whose hash exceeds the largest sketch value can't match and go first. Candidate pairs are then
verified by exact shingle containment, on the shingles' text.

Shingles: five words, A-Z lower-cased, joined by spaces. An item of fewer words is one shingle, and documents are probed by
all their word sequences of the lengths that such items have, too (four more at most), so it is found anywhere in them.
Defined results: null and blank texts contain nothing and items without words are in nothing; empty tables give no
pairs; repeated rows of a document's id count as one document (any of its texts contains the shingle); repeated item
rows of one id likewise; null ids group as an id of their own; very long texts are probed whole; a containment equal to the
bound counts as reached. Extra columns, whatever their names, are not read, or kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import cut, words

#: Sketch rows up to which the index is broadcast (8-byte hashes; beyond it, the probe shuffles the shingles that pass).
BROADCAST_ROWS = 500_000
#: Rows and bytes of the items' shingles up to which these are broadcast.
SHINGLE_ROWS, SHINGLE_BYTES = 500_000, 32 << 20


def _shingle_column(df: DataFrame, id_col: str, text_col: str, name: str, size: int) -> DataFrame:
    """(name, _w): words, materialised once."""
    return df.select(F.col(f"`{id_col}`").alias(name), words(F.col(f"`{text_col}`"), lower=True).alias("_w"))


def _of_words(w: Column, size: int) -> Column:
    """The shingles of exactly that many words; none of a shorter text."""
    return F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.array_join(F.slice(w, i, size), " "))).otherwise(F.array().cast("array<string>"))


def _hashes_of_words(w: Column, size: int) -> Column:
    """Hash of each shingle: its words hashed in turn, without making the shingle's text."""
    each = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)])
    return F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(0), F.size(w) - size), each)).otherwise(F.array().cast("array<bigint>"))


def _of_all(make, w: Column, sizes: list[int]) -> Column:
    return F.concat(*[make(w, k) for k in sizes])


def item_shingles(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(_item, _sh, _h, _k): the distinct shingles of each item, of size words, or of all of a shorter one's _k words."""
    w = _shingle_column(items, id_col, text_col, "_item", size)
    k = F.least(F.size("_w"), F.lit(size))
    of = lambda make: F.coalesce(*[F.when(k == n, make(F.col("_w"), n)) for n in range(1, size + 1)])
    both = w.where(k > 0).select("_item", k.alias("_k"), F.explode(F.arrays_zip(of(_of_words).alias("s"), of(_hashes_of_words).alias("h"))).alias("_x"))
    return both.select("_item", F.col("_x.s").alias("_sh"), F.col("_x.h").alias("_h"), "_k").distinct()


def sketches(own: DataFrame, containment: float) -> DataFrame:
    """(_item, _h): bottom-k MinHash sketches; k by the size partition of the item."""
    of = own.groupBy("_item").agg(F.array_sort(F.collect_set("_h")).alias("_hs"))
    n = F.size("_hs")
    largest = F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double"))))  # of the partition
    k = F.floor((1 - containment) * largest + 1e-9).cast("int") + 1
    return of.select("_item", F.explode(F.slice("_hs", 1, F.least(k, n))).alias("_h"))


def _matching(docs: DataFrame, id_col: str, keys: DataFrame, how: str) -> DataFrame:
    """The rows whose id is, or isn't, among the keys (_key): sent to the rows while there are few of them."""
    small = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(keys) if small else keys, docs[id_col].eqNullSafe(keys["_key"]), how)


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 5, containment: float = 0.8) -> DataFrame:
    """(id, item, n_shingles, n_shared, containment): every document that contains an item to that degree or more."""
    if not 0 < containment <= 1:
        raise ValueError("containment: over 0, at most 1")
    own = cut(item_shingles(items, item_col, item_text_col, size))
    index = cut(sketches(own, containment).distinct())
    bound = index.agg(F.count("*").alias("n"), F.max("_h").alias("top")).first()
    extent = own.agg(F.count("*").alias("n"), F.sum(F.octet_length("_sh")).alias("bytes"), F.collect_set("_k").alias("sizes")).first()
    sizes = sorted({size, *extent["sizes"]})
    probe = index if bound["n"] > BROADCAST_ROWS else F.broadcast(index)
    # a long text may fill an item's sketch by chance only: what counts is which of its shingles are the item's
    w = _shingle_column(docs, id_col, text_col, "_doc", size)
    hashes = _of_all(_hashes_of_words, F.col("_w"), sizes)
    found = w.select("_doc", F.explode(F.filter(hashes, lambda h: h <= F.lit(bound["top"] if bound["top"] is not None else 0))).alias("_h"))
    pairs = cut(found.join(probe, "_h").select("_doc", "_item").distinct())
    # verification: the texts of candidates only, their shingles against the items' own
    texts = _shingle_column(_matching(docs, id_col, pairs.select(F.col("_doc").alias("_key")).distinct(), "left_semi"), id_col, text_col, "_doc", size)
    theirs = texts.select("_doc", F.explode(F.array_distinct(_of_all(_of_words, F.col("_w"), sizes))).alias("_sh"))
    small = F.broadcast(own) if extent["n"] <= SHINGLE_ROWS and (extent["bytes"] or 0) <= SHINGLE_BYTES else own
    shared = theirs.join(small.select("_item", "_sh"), "_sh").distinct().groupBy("_doc", "_item").agg(F.count("*").alias("n_shared"))
    sizes = own.groupBy("_item").agg(F.count("*").alias("n_shingles"))
    both = shared.alias("s").join(pairs.alias("p"), F.col("s._doc").eqNullSafe(F.col("p._doc")) & F.col("s._item").eqNullSafe(F.col("p._item"))).select("s._doc", "s._item", "n_shared")
    out = both.alias("b").join(sizes.alias("z"), F.col("b._item").eqNullSafe(F.col("z._item"))).where(F.col("n_shared") >= F.lit(containment) * F.col("n_shingles") - 1e-9)
    return out.select(F.col("b._doc").alias(id_col), F.col("b._item").alias(item_col), "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of the documents that contain no item, with their columns."""
    bad = cut(contained(docs, items, id_col, **options).select(F.col(id_col).alias("_key")).distinct())
    return _matching(docs, id_col, bad, "left_anti")


def oracle(containment: float = 0.8) -> str:
    """The pairs in DuckDB's SQL, by shingle sets."""
    word = r"[^\x20\x09-\x0D]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = lambda t, i: f"select {i}, regexp_extract_all({lower}, '{word}') as w from {t}"
    grams = lambda w, k: f"list_transform(range(1, len({w}) - {k} + 2), lambda j: array_to_string({w}[j:j + {k} - 1], ' '))"
    return f"""
    with items as (select distinct item_id, k, unnest({grams('w', 'k')}) as sh from (select item_id, w, least(len(w), 5) as k from ({split('benchmark', 'item_id')})) where k > 0),
    sizes as (select item_id, count(*) as n_shingles from items group by item_id),
    docs as (select distinct * from (select doc_id, unnest({grams('w', 'k')}) as sh from ({split('documents', 'doc_id')}), (select distinct k from items)) where sh in (select sh from items)),
    shared as (select doc_id, item_id, count(*) as n_shared from docs join items using (sh) group by doc_id, item_id)
    select doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles as containment
    from shared join sizes using (item_id) where n_shared >= {containment} * n_shingles - 1e-9"""
