"""Quality by hierarchical empirical Bayes.

A document's own evidence comes from logistic regressions (good quality, and toxic) on its distinct words, hashed, and
on its looks in steps. They are fitted on a bounded sample of labelled documents: SAMPLE at most, those of the smallest
hashed ids, whole texts, and SAMPLE_BYTES of their features. The evidence is the log likelihood ratio: the regression's log odds less those of its sample.

Hosts and paths have posteriors of their own. Over all documents, grouped by path and by host, good documents are counted
(labels where there are any, else the regression's chance). A host's rate is shrunk to the rate of all, a path's to its
host's; how strongly is estimated by moments: the more the rates differ beyond what their sizes explain, the less they are
shrunk, and a sparse site takes over what is above it. A document's posterior log odds are the log odds of its path plus
its own evidence. It is kept if good quality is the likelier and toxicity isn't.

Defined results: null and blank texts count as texts without words; null hosts or paths are a site of their own; an empty
table gives no rows; without labels the evidence is zero and all rates are one half; repeated rows count and return each
time; labels repeated for an id count once, quality by the smaller, toxic by the larger; labels of null are ignored; very long
texts are taken whole; of equal hashed ids the smaller id is in the sample; a probability of exactly one half counts as good, and
as toxic; extra columns, whatever their names, are not read. Sites' counts are combined before they are shuffled, so the size of a host doesn't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import cut, small_batches, stored

#: Labelled documents to fit on, features, steps of the fit and its penalty.
SAMPLE, FEATURES, STEPS, PENALTY = 20_000, 1 << 18, 250, 0.05
#: Bytes of the sample's features that come to the driver; of a sample with more a share is taken that fits.
SAMPLE_BYTES = 64 << 20
#: Features count whose log likelihood ratio against the label reaches this (chance reaches it once in 500,000).
SIGNIFICANT = 22.0
#: Bounds of the estimated pseudo-counts; sites up to which their rates are broadcast (beyond it, joined by shuffle).
WEAKEST, STRONGEST, BROADCAST_ROWS = 2.0, 10_000.0, 50_000


#: Stripped from words at either end.
OUTER = b".,;:!?\"'()[]{}#*$%&|<>"


def feature_set(text: bytes) -> np.ndarray:
    """Hashed distinct words, A-Z lower-cased, less outer punctuation; and looks: shares of symbols, capitals, digits and
    repeated words and lines, in steps."""
    from zlib import crc32

    words = text.lower().split()
    n = max(len(words), 1)
    distinct = {w.strip(OUTER) for w in words}
    found = {crc32(w) & (FEATURES - 1) for w in distinct}
    raw = np.frombuffer(text, np.uint8)
    kinds = np.bincount(raw, minlength=256)
    lines = [x for x in text.split(b"\n") if x.strip()]
    shares = {
        b"symbols": sum(int(kinds[c]) for c in b"#*$%&|<>") / n,
        b"capitals": int(kinds[65:91].sum()) / n,
        b"digits": int(kinds[48:58].sum()) / n,
        b"shouts": int(kinds[33]) / n,
        b"repeats": 1 - len(distinct) / n,
        b"lines": 1 - len(set(lines)) / max(len(lines), 1),
    }
    for name, share in shares.items():
        step = int(min(share, 4) * 8)
        found |= {crc32(b"\0%s%d" % (name, k)) & (FEATURES - 1) for k in range(step + 1)}
    found |= {crc32(b"\0words%d" % k) & (FEATURES - 1) for k in range(len(words).bit_length() + 1)}
    return np.fromiter(found, np.int64, len(found))


@dataclass
class Evidence:
    """Weights and intercept of a regression, and the log odds of its sample."""

    weights: np.ndarray
    intercept: float
    prior: float

    def ratio(self, features: np.ndarray) -> float:
        return float(self.weights[features].sum()) + self.intercept - self.prior


def _significant(flat: np.ndarray, label: np.ndarray, n: int, positive: float) -> np.ndarray:
    """Features whose presence and the label hang together (G test of the two by two table)."""
    have = np.bincount(flat, minlength=FEATURES).astype(float)
    both = np.bincount(flat, weights=label, minlength=FEATURES)
    out = np.zeros(FEATURES)
    for seen, rows, columns in ((both, have, positive), (have - both, have, n - positive), (positive - both, n - have, positive), (n - have - positive + both, n - have, n - positive)):
        with np.errstate(divide="ignore", invalid="ignore"):
            out += np.where(seen > 0, 2 * seen * np.log(seen * n / (rows * columns)), 0)
    return out >= SIGNIFICANT


def fit_evidence(rows: list[np.ndarray], labels: np.ndarray) -> Evidence:
    """Logistic regression with a penalty, by steps scaled with past gradients."""
    n = len(rows)
    if not n or labels.min() == labels.max():
        return Evidence(np.zeros(FEATURES), 0.0, 0.0)
    flat, sizes = np.concatenate(rows), np.array([len(x) for x in rows])
    seen = _significant(flat, np.repeat(labels, sizes), n, float(labels.sum()))
    owner = np.repeat(np.arange(n), sizes)[seen[flat]]
    flat = flat[seen[flat]]
    share = np.clip(labels.mean(), 1e-6, 1 - 1e-6)
    prior = float(np.log(share / (1 - share)))
    weights, intercept = np.zeros(FEATURES), prior
    past, past0 = np.full(FEATURES, 1e-6), 1e-6
    for _ in range(STEPS):
        odds = np.bincount(owner, weights=weights[flat], minlength=n) + intercept
        wrong = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - labels
        grad = np.bincount(flat, weights=wrong[owner], minlength=FEATURES) + PENALTY * weights
        past += grad**2
        past0 += wrong.sum() ** 2
        weights -= 0.5 * grad / np.sqrt(past)
        intercept -= 0.1 * wrong.sum() / np.sqrt(past0)
    return Evidence(weights, float(intercept), prior)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [feature_set(t).astype(np.int32) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in found], pa.binary()), batch.column("quality"), batch.column("toxic")], ["features", "quality", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Evidence, Evidence]:
    """Evidence of good quality and of toxicity, from (id, text) and (id, quality, toxic)."""
    chosen = cut(labels.where("quality is not null or toxic is not null").orderBy(F.xxhash64("id"), "id").limit(sample))
    found = docs.select("id", "text").join(F.broadcast(chosen), "id").select("text", "quality", "toxic").mapInArrow(_sampled, "features binary, quality int, toxic int").limit(2 * sample)
    found = stored(found, "sample")
    size = found.agg(F.sum(F.octet_length("features")).alias("n")).first()["n"] or 0
    if size > SAMPLE_BYTES:  # a share of the labelled texts, by their content, that fits
        found = found.where(F.pmod(F.xxhash64("features", "quality", "toxic"), F.lit(1 << 20)) < F.lit((1 << 20) * SAMPLE_BYTES // size))
    found = found.collect()
    out = []
    for name in ("quality", "toxic"):
        own = sorted((r["features"], r[name]) for r in found if r[name] is not None)
        out.append(fit_evidence([np.frombuffer(x, np.int32).astype(np.int64) for x, _ in own], np.array([float(y) for _, y in own])))
    return out[0], out[1]


def _scored(quality: Evidence, toxic: Evidence):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [feature_set(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "host", "path")] + [pa.array([e.ratio(x) for x in found], pa.float64()) for e in (quality, toxic)], ["id", "host", "path", "eq", "et"])

    return run


def _log_odds(rate: Column) -> Column:
    return F.ln(rate / (1 - rate))


def _pseudo_counts(groups: DataFrame, above: str) -> float:
    """How strongly rates of groups (n, s) are shrunk to the column above: by moments of their differences from it."""
    rate, m = F.col("s") / F.col("n"), F.col(above)
    r = groups.agg(F.sum("n").alias("w"), F.sum(F.col("n") * (rate - m) ** 2).alias("d"), F.sum(m * (1 - m)).alias("noise"), F.sum(F.col("n") * m * (1 - m)).alias("spread")).first()
    if not r["w"]:
        return STRONGEST
    between = (r["d"] - r["noise"]) / r["w"]
    return STRONGEST if between <= 0 else float(min(max(r["spread"] / r["w"] / between - 1, WEAKEST), STRONGEST))


def site_rates(rows: DataFrame, value: str) -> DataFrame:
    """(host, path, host_rate, path_rate) by shrinkage; value: of each row, 0 to 1."""
    paths = cut(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(value).alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    overall = (whole["s"] + 1) / (whole["n"] + 2) if whole["n"] else 0.5
    hosts = hosts.withColumn("m", F.lit(overall))
    k = _pseudo_counts(hosts, "m")
    hosts = hosts.select("host", ((F.col("s") + k * overall) / (F.col("n") + k)).alias("host_rate"))
    joined = cut(paths.join(hosts, "host"))
    k = _pseudo_counts(joined, "host_rate")
    return joined.select("host", "path", "host_rate", ((F.col("s") + k * F.col("host_rate")) / (F.col("n") + k)).alias("path_rate"))


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """(id, evidence and rates, quality_prob, toxic_prob, kept) of each row. labels: (id, quality, toxic), 0 or 1."""
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")).alias(n) for c, n in ((host_col, "host"), (path_col, "path"))])
    own = labels.select(F.col(f"`{id_col}`").alias("id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).groupBy("id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    quality, toxic = fit(docs, own, sample)
    kind = dict(docs.dtypes)["id"]
    scored = docs.mapInArrow(_scored(quality, toxic), f"id {kind}, host string, path string, eq double, et double")
    chance = lambda e, prior: 1 / (1 + F.exp(-(F.col(e) + F.lit(prior))))
    rows = scored.join(own, "id", "left").withColumn("vq", F.coalesce(F.col("quality").cast("double"), chance("eq", quality.prior))).withColumn("vt", F.coalesce(F.col("toxic").cast("double"), chance("et", toxic.prior)))
    rows = stored(rows, "evidence")
    rates = site_rates(rows, "vq").join(site_rates(rows, "vt").select("host", "path", F.col("host_rate").alias("host_toxic"), F.col("path_rate").alias("path_toxic")), ["host", "path"])
    rates = cut(rates)
    few = rates.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(rates) if few else rates, ["host", "path"])
    posterior = lambda rate, e: 1 / (1 + F.exp(-(_log_odds(F.col(rate)) + F.col(e))))
    out = joined.withColumn("quality_prob", posterior("path_rate", "eq")).withColumn("toxic_prob", posterior("path_toxic", "et"))
    return out.select(
        F.col("id").alias(id_col), F.col("eq").alias("quality_evidence"), F.col("et").alias("toxic_evidence"), F.col("host_rate").alias("host_quality"), F.col("path_rate").alias("path_quality"), "host_toxic", "path_toxic",
        "quality_prob", "toxic_prob", ((F.col("quality_prob") >= 0.5) & (F.col("toxic_prob") < 0.5)).alias("kept"),
    )
