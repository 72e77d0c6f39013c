"""Quality rules as weak supervision, in SQL functions only.

Rules vote good or bad on each document, or abstain. Expectation-maximisation over the counts of vote patterns (3 to
the power of the number of rules at most, however many documents there are) estimates how often each rule votes
either way on good documents and on bad ones of each kind (a kind for each rule: defects differ, and a document with one
mostly passes all other rules, so a single class of bad documents would cling to the most frequent defect). The posterior probability of good quality replaces the rule that a document
must pass them all. The loop runs on the driver over that bounded table; documents are read once for the votes.

Defined results: a null or blank text has no words, fails the base rule and is not kept; an empty table gives no rows
(the model then is the start); repeated rows count each time; very long texts are taken whole; a posterior of exactly one half
is kept; a rule's bound itself votes as its expression says; other columns stay, and those that clash with a feature's name are
taken within a struct by ``judge`` and ``keep``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import WORD, stored, words

GOOD, BAD, ABSTAIN = 1, 0, 2
#: Rules: name, when they vote bad, when they vote good (else they abstain); SQL over the features, ANSI in both dialects.
RULES = [
    ("length", "n_words < 50", "n_words >= 80"),
    ("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    ("lines", "3 * n_dup_lines > n_lines", "20 * n_dup_lines <= n_lines"),
    ("windows", "5 * n_repeat_words > 2 * n_words", "20 * n_repeat_words <= n_words"),
    ("word_length", "word_chars < 3 * n_words or word_chars > 12 * n_words", "word_chars >= 4 * n_words and word_chars <= 9 * n_words"),
    ("shouting", "2 * n_capitals > 3 * n_words or 10 * n_exclamations > n_words", "2 * n_capitals <= n_words and 50 * n_exclamations <= n_words"),
]
#: Rounds of expectation-maximisation, and the share of good documents at the start.
ROUNDS, PRIOR = 40, 0.8
#: At the start: the chance that a rule votes bad, if it votes, on a good document, on a bad one of its own kind, and on
#: a bad one of another kind; and the votes that the start counts for.
ERRS, CATCHES, OTHERS, SEEN = 0.01, 0.9, 0.05, 1.0
#: A rule votes bad on no more than this share of good documents; it is far more accurate than chance, else it is no rule.
MOST_ERRS = 0.02


def features(df: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Adds the features, all long, and base_failed. Whole texts; repeated windows by a sort of their 64-bit hashes."""
    p = f"{prefix}_q_"
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    names = [F.col(f"`{c}`") for c in df.columns]
    a = df.select(*names, text.alias(f"{p}t"), words(F.col(f"`{text_col}`")).alias(f"{p}w"), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)).alias(f"{p}l"))
    w, n = F.col(f"{p}w"), F.size(f"{p}w")
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    b = a.select(
        *names,
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(F.col(f"{p}t"), F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(F.col(f"{p}t"), F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count(F.col(f"{p}t"), F.lit(r"!")).cast("long").alias("n_exclamations"),
        F.size(f"{p}l").cast("long").alias("n_lines"),
        (F.size(f"{p}l") - F.size(F.array_distinct(f"{p}l"))).cast("long").alias("n_dup_lines"),
        hashes.alias(f"{p}h"),
    )
    h = F.col(f"{p}h")
    # only texts with a repeated window take the sort of (hash, place)
    c = b.withColumn(f"{p}s", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col(f"{p}s")
    same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    twice = F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1))
    d = c.withColumn(f"{p}d", F.sort_array(F.transform(twice, lambda x: x["i"])))
    at = F.col(f"{p}d")
    covered = F.aggregate(F.transform(at, lambda x, j: F.coalesce(F.least(F.lit(3), F.get(at, j + 1) - x), F.lit(3))), F.lit(0), lambda acc, x: acc + x)
    out = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(f"{p}h", f"{p}s", f"{p}d")
    return out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def votes() -> Column:
    """The pattern of votes: a character for each rule."""
    return F.concat(*[F.expr(f"case when {bad} then '{BAD}' when {good} then '{GOOD}' else '{ABSTAIN}' end") for _, bad, good in RULES])


@dataclass
class LabelModel:
    """Classes: good documents, then the bad ones of each rule's kind. shares: of the classes; bad: each rule's chance
    of voting bad, if it votes, in each class."""

    shares: list[float]
    bad: list[list[float]]
    n: int = 0

    def weights(self, kind: int) -> list[dict[int, float]]:
        """By rule, what a vote adds to the log odds of a bad kind against good documents."""
        return [{BAD: math.log(p / q), GOOD: math.log((1 - p) / (1 - q)), ABSTAIN: 0.0} for p, q in zip(self.bad[kind], self.bad[0], strict=True)]

    def posterior(self, pattern: str) -> list[float]:
        """The chance of each class."""
        logs = [math.log(s) + sum(math.log(q if v == str(BAD) else 1 - q) for v, q in zip(pattern, own, strict=True) if v != str(ABSTAIN)) for s, own in zip(self.shares, self.bad, strict=True)]
        top = max(logs)
        odds = [math.exp(x - top) for x in logs]
        return [x / sum(odds) for x in odds]

    def quality(self, pattern: str) -> float:
        return self.posterior(pattern)[0]


def start() -> LabelModel:
    kinds = len(RULES)
    return LabelModel([PRIOR] + [(1 - PRIOR) / kinds] * kinds, [[ERRS] * kinds] + [[CATCHES if k == kind else OTHERS for k in range(kinds)] for kind in range(kinds)])


def fit_counts(counts: dict[str, int], rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over the counts of patterns."""
    model = first = start()
    total = sum(counts.values())
    rows = sorted(counts.items())
    for _ in range(rounds if total else 0):
        classes = range(len(model.shares))
        seen = [SEEN * s for s in first.shares]
        voted = [[SEEN] * len(RULES) for _ in classes]
        against = [[SEEN * q for q in own] for own in first.bad]
        for pattern, n in rows:
            for c, share in enumerate(model.posterior(pattern)):
                seen[c] += n * share
                for k, vote in enumerate(pattern):
                    if vote != str(ABSTAIN):
                        voted[c][k] += n * share
                        against[c][k] += n * share * (vote == str(BAD))
        bad = [[x / y for x, y in zip(a, v, strict=True)] for a, v in zip(against, voted, strict=True)]
        bad[0] = [min(x, MOST_ERRS) for x in bad[0]]
        model = LabelModel([x / (total + SEEN) for x in seen], bad, total)
    return model


def fit(marked: DataFrame) -> LabelModel:
    """The label model of a table with features: one aggregation, at most 3 ** len(RULES) rows to the driver."""
    counts = {r["v"]: r["n"] for r in marked.groupBy(votes().alias("v")).agg(F.count("*").alias("n")).collect()}
    return fit_counts(counts)


def apply(marked: DataFrame, model: LabelModel) -> DataFrame:
    """Adds quality_prob, and kept: false if base_failed, else whether good quality is the likelier."""
    against = F.lit(0.0)
    for kind in range(1, len(model.shares)):
        odds = F.lit(math.log(model.shares[kind] / model.shares[0]))
        for (_, bad, good), weight in zip(RULES, model.weights(kind), strict=True):
            odds = odds + F.expr(f"case when {bad} then {weight[BAD]!r}D when {good} then {weight[GOOD]!r}D else 0D end")
        against = against + F.exp(odds)
    return marked.withColumn("quality_prob", 1 / (1 + against)).withColumn("kept", ~F.col("base_failed") & (F.col("quality_prob") >= 0.5))


def judge(df: DataFrame, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Features and verdicts of all rows, with these columns of theirs; the features are stored once, without the text
    unless it is among the columns."""
    columns = [c for c in (columns if columns is not None else df.columns)]
    row = F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.struct(F.lit(1).alias("x"))
    marked = features(df.select(row.alias("_row"), F.col(f"`{text_col}`").alias("_text")), "_text").drop("_text")
    marked = stored(marked, "quality")
    return apply(marked, fit(marked))


def keep(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, with their columns as they were. Rows and features are stored once and the verdicts
    read from there: a filter on the feature expressions themselves would be copied into each of their lambdas."""
    return judge(df, text_col).where("kept").select("_row.*")
