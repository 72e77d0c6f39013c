"""Hidden Markov language model: Baum-Welch over the cluster, exact likelihoods by the scaled forward recursion.

Tokens are the words of a text, A-Z lower-cased, and one end. A state emits a class, and a class its word:
P(word | state) = P(class | state) * P(word | class). The second factor doesn't depend on the state, so training needs
only the chances of classes. Words seen COMMON times or more have a class by the hash of the word, rarer ones by that of their
last three bytes, which groups endings of a language; how many classes there are is a parameter (``Classes``): what a round sums
over the cluster is a row for each class and task, so a number that grew with the vocabulary would make it grow with the square of
the corpus. What grows are the counts of words, all of which are kept and scored by; the end has its own, and so has the unknown: a word that training has not seen. Its chance is learnt by state from the
words that training has seen once, which a held-out text would not know (leaving one out), so no word has chance zero
and the chances of all known words, the end and the unknown add up to one.

Counts: the words of all training texts are counted over the cluster, all of them kept. Texts are dealt into blocks; a
block asks for the counts of its own distinct words (by their rank in it, so answers need no words) and turns its texts
into sequences of classes, stored once, two bytes a token (four for more than 32,000 classes). Each round of Baum-Welch reads them, adds up the expected counts of
the block's sequences for STATES * classes numbers and sums those over the cluster, until a round gains less than TOLERANCE nats
a token, or ROUNDS. Forward and backward passes run over many texts at a time, one column each.

Defined results: a null or blank text is the end alone; an empty table gives no rows; without training rows every word is
unknown and only the start of the model is used; repeated rows count each time; extra columns, whatever their names, are
not read; very long texts are scored whole; ties don't occur, as nothing is ranked.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import shuffles_cleaned, small_batches, stored

STATES, ROUNDS, TOLERANCE = 6, 4, 0.002
#: Words of this count or more have a class by word.
COMMON = 8


@dataclass(frozen=True)
class Classes:
    """Classes by word, by ending, the end and the unknown, numbered in this order."""

    by_word: int = 20480
    by_ending: int = 8192

    @property
    def end(self) -> int:
        return self.by_word + self.by_ending

    @property
    def unknown(self) -> int:
        return self.end + 1

    @property
    def n(self) -> int:
        return self.end + 2

    @property
    def code(self) -> str:
        """How numbers are stored; their highest bit tells that the word was seen once in training (there it stands for the
        unknown)."""
        return "<u2" if self.n < 1 << 15 else "<u4"

    @property
    def once(self) -> int:
        return 1 << (8 * np.dtype(self.code).itemsize - 1)


#: The token of the end in the table of counts; no word holds a line feed.
END_WORD = b"\n"
#: Characters of texts of a block; tokens that are passed through at once.
BLOCK_CHARS, CELLS = 16_000_000, 1_000_000
#: Pseudo-counts of a class overall, of the overall shares in a state, and of a state after another.
SMOOTH, BACKOFF, SMOOTH_STATE = 0.5, 20.0, 1.0


def held_out(ident: Column) -> Column:
    """Whether the CRC-32 of the id as text leaves no remainder by 10; a null id's text is empty."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def class_column(word: Column, count: Column, classes: Classes) -> Column:
    ending = F.substring(word, F.greatest(F.octet_length(word) - 2, F.lit(1)), F.lit(3))
    return F.when(word == F.lit(END_WORD), F.lit(classes.end)).when(count >= COMMON, F.crc32(word) % classes.by_word).otherwise(classes.by_word + F.crc32(ending) % classes.by_ending).cast("int")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) over the texts of a task, in parts of bounded size."""
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            counts.update(text.lower().split())
            counts[END_WORD] += 1
        if len(counts) > 400_000:
            yield out()
            counts = Counter()
    if counts:
        yield out()


def _distinct(texts: pa.ChunkedArray) -> list[bytes]:
    """The distinct words of a block, in order: a word's rank is its place here."""
    words: set = set()
    for text in texts.cast(pa.binary()).to_pylist():
        words.update(text.lower().split())
    return sorted(words)


def _requests(block: pa.Table) -> pa.Table:
    words = _distinct(block["text"])
    return pa.table({"block": pa.array([block["block"][0].as_py()] * len(words), pa.int32()), "rank": pa.array(range(len(words)), pa.int32()), "word": pa.array(words, pa.binary())})


def _encoder(total: int, distinct: int, ends: int, masses: np.ndarray, classes_: Classes):
    """Texts of a block and the counts of its words, to class sequences and the parts of the scores outside the states."""
    scale = math.log10(total + 0.1 * (distinct + 1))

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        # words are numbered as they come, in one pass; their ranks among the block's words follow from the distinct ones
        numbers: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        parts, sizes = [], []
        for text in texts["text"].cast(pa.binary()).to_pylist():
            words = text.lower().split()
            parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
            sizes.append(len(words))
        words = list(numbers)
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        count, kind = np.zeros(len(rank), np.int64), np.full(len(rank), classes_.unknown, np.int64)
        at = answers["rank"].to_numpy()
        count[at], kind[at] = answers["c"].to_numpy(), answers["class"].to_numpy()
        count, kind = count[rank], kind[rank]
        base = np.log10(count + 0.1) - scale
        inner = np.where(count > 0, np.log10(count + 0.1) - np.log10(masses[kind]), 0.0)
        codes = (kind + np.where(count == 1, classes_.once, 0)).astype(classes_.code)
        end = np.array([classes_.end], classes_.code).tobytes()
        own = np.concatenate(parts) if parts else np.empty(0, np.int32)
        n = np.array(sizes, np.int64)
        of = np.repeat(np.arange(len(n)), n)
        total_of = lambda values: np.bincount(of, weights=values[own], minlength=len(n))
        raw, width, ends_at = codes[own].tobytes(), codes.dtype.itemsize, np.cumsum(n).tolist()
        classes = [raw[width * a : width * b] + end for a, b in zip([0, *ends_at], ends_at, strict=False)]
        last = math.log10(ends + 0.1) - scale
        return pa.table({"id": texts["id"], "held_out": texts["held_out"], "n_tokens": pa.array(n + 1), "n_known": pa.array(total_of(count > 0).astype(np.int64) + (ends > 0)), "base_score": pa.array(total_of(base) + last), "inner": pa.array(total_of(inner)), "classes": pa.array(classes, pa.binary())})

    return run


@dataclass
class Model:
    """first: chances of the first state; move[i, j]: of state j after i; emit[class, state]."""

    first: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def start(classes: Classes, states: int = STATES, seed: int = 7) -> Model:
    """States that differ by chance in each class and mostly stay. Chances of classes are up to a factor that all states
    share, which training doesn't feel; ``fit`` always ends with real ones."""
    rng = np.random.default_rng(seed)
    emit = np.exp(rng.normal(0, 0.7, (classes.n, states)))
    move = np.full((states, states), 0.02 / max(states - 1, 1))
    np.fill_diagonal(move, 0.98 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def _groups(sequences: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Sequences by falling length, so many at a time that their tokens stay within CELLS or so."""
    held: list[np.ndarray] = []
    size = 0
    for x in sequences:
        held.append(x)
        size += len(x)
        if size >= CELLS:
            yield sorted(held, key=len, reverse=True)
            held, size = [], 0
    if held:
        yield sorted(held, key=len, reverse=True)


def _laid_out(group: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a group step by step: (tokens, offset of each step, sequences that reach it), all the longer ones first."""
    lengths = np.array([len(x) for x in group])
    steps = np.arange(lengths[0])
    live = np.searchsorted(-lengths, -steps, side="left")  # sequences longer than the step
    offsets = np.concatenate([[0], np.cumsum(live)])
    tokens = np.empty(offsets[-1], np.int64)
    for k, x in enumerate(group):
        tokens[offsets[: len(x)] + k] = x
    return tokens, offsets, live


def forward(model: Model, group: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(natural log likelihoods, scaled forward chances and their scales by token, layout) of a group by falling length."""
    laid = tokens, offsets, live = _laid_out(group)
    emit = model.emit[tokens]
    alpha = np.empty_like(emit)
    scale = np.empty(len(tokens))
    now = np.repeat(model.first[None, :], len(group), axis=0)
    for t in range(len(live)):
        a, b = offsets[t], offsets[t + 1]
        now = (now[: live[t]] @ model.move if t else now) * emit[a:b]
        s = now.sum(axis=1)
        now /= s[:, None]
        alpha[a:b], scale[a:b] = now, s
    logs = np.bincount(np.arange(len(tokens)) - np.repeat(offsets[:-1], live), weights=np.log(scale), minlength=len(group))
    return logs, alpha, (emit, scale, laid)


def expected(model: Model, group: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of a group, (first, move, emit), and its log likelihood."""
    logs, alpha, (emit, scale, (tokens, offsets, live)) = forward(model, group)
    states = len(model.first)
    move = np.zeros((states, states))
    beta = np.ones((live[-1], states))
    for t in range(len(live) - 1, 0, -1):
        a, b = offsets[t], offsets[t + 1]
        if live[t] > len(beta):
            beta = np.concatenate([beta, np.ones((live[t] - len(beta), states))])
        ahead = emit[a:b] * beta / scale[a:b, None]
        before = alpha[offsets[t - 1] : offsets[t - 1] + live[t]]
        move += before.T @ ahead
        alpha[a:b] *= beta  # from here on, the chances of states given the whole text
        beta = ahead @ model.move.T
    if live[0] > len(beta):
        beta = np.concatenate([beta, np.ones((live[0] - len(beta), states))])
    alpha[: live[0]] *= beta
    counts = np.stack([np.bincount(tokens, weights=alpha[:, k], minlength=len(model.emit)) for k in range(states)], axis=1)
    return alpha[: live[0]].sum(axis=0), move * model.move, counts, float(logs.sum())


def _expectation(model: Model, classes: Classes):
    """Rows (class, e0..): a task's expected counts of classes; classes -1 and below: first, moves by state, and the log likelihood
    with the number of tokens."""
    states = len(model.first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((classes.n, states))
        told = np.zeros((1, states + 1))

        def sequences() -> Iterator[np.ndarray]:
            for batch in batches:
                for raw in batch.column("classes").to_pylist():
                    x = np.frombuffer(raw, classes.code).astype(np.int64)
                    yield np.where(x >= classes.once, classes.unknown, x)

        for group in _groups(sequences()):
            *own, logs = expected(model, group)
            for to, more in zip((first, move, emit), own, strict=True):
                to += more
            told[0, :2] += logs, sum(map(len, group))
        used = np.flatnonzero(emit.sum(axis=1))
        rows = np.concatenate([emit[used], first[None, :], move, told[:, :states]])
        names = np.concatenate([used, -1 - np.arange(states + 2)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(names), *[pa.array(rows[:, k]) for k in range(states)]], ["class", *[f"e{k}" for k in range(states)]])

    return run


def maximise(first: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
    """Chances from expected counts; a state's classes lean on their overall shares."""
    overall = emit.sum(axis=1) + SMOOTH
    overall /= overall.sum()
    emit = emit + BACKOFF * overall[:, None]
    move = move + SMOOTH_STATE
    first = first + SMOOTH_STATE
    return Model(first / first.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def fit(encoded: DataFrame, classes: Classes, rounds: int = ROUNDS, states: int = STATES, tolerance: float = TOLERANCE) -> Model:
    """Baum-Welch over the stored training sequences, until a round gains little; to the driver come a row for each class and some
    more a round."""
    model = start(classes, states)
    names = [f"e{k}" for k in range(states)]
    before = None
    for _ in range(max(rounds, 1)):
        found = encoded.select("classes").mapInArrow(_expectation(model, classes), "class int, " + ", ".join(f"{x} double" for x in names))
        with shuffles_cleaned(encoded.sparkSession):
            sums = found.groupBy("class").agg(*[F.sum(x).alias(x) for x in names]).toArrow()
        kind = sums["class"].to_numpy()
        rows = np.stack([sums[x].to_numpy() for x in names], axis=1).reshape(-1, states)
        emit, rest = np.zeros((classes.n, states)), np.zeros((states + 2, states))
        emit[kind[kind >= 0]] = rows[kind >= 0]
        rest[-1 - kind[kind < 0]] = rows[kind < 0]
        model = maximise(rest[0], rest[1 : states + 1], emit)
        logs, tokens = rest[states + 1, 0], rest[states + 1, min(1, states - 1)]
        if before is not None and logs - before < tolerance * tokens:
            break
        # the start's chances are none of whole words, so its likelihood isn't compared
        before = logs if before is not None else -np.inf
    return model


def _scorer(model: Model, classes: Classes):
    """Scores of stored sequences, by groups of like length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.frombuffer(x, classes.code).astype(np.int64) & (classes.once - 1) for x in batch.column("classes").to_pylist()]
            order = sorted(range(len(raw)), key=lambda k: -len(raw[k]))
            logs = np.zeros(len(raw))
            at = 0
            while at < len(order):
                size, end = 0, at
                while end < len(order) and (end == at or size + len(raw[order[end]]) <= CELLS):
                    size += len(raw[order[end]])
                    end += 1
                logs[order[at:end]] = forward(model, [raw[k] for k in order[at:end]])[0]
                at = end
            keep = [c for c in batch.schema.names if c not in ("classes", "inner")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(logs / math.log(10) + batch.column("inner").to_numpy(zero_copy_only=False))], [*keep, "score"])

    return run


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", holdout: Column | None = None, rounds: int = ROUNDS, states: int = STATES, block_chars: int = BLOCK_CHARS, classes: Classes = Classes()) -> DataFrame:  # noqa: B008
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; learns from those not held out."""
    spark = df.sparkSession
    small_batches(spark)
    ident = F.col(f"`{id_col}`")
    docs = df.select(ident.alias("id"), (held_out(ident) if holdout is None else holdout).alias("held_out"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    chars = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-chars // block_chars))
    found = docs.where(~F.col("held_out")).select("text").mapInArrow(_word_counts, "word binary, n long")
    counts = found.groupBy("word").agg(F.sum("n").alias("c"))
    counts = stored(counts, "words")
    sums = counts.agg(F.sum("c").alias("total"), F.count("*").alias("distinct"), F.max(F.when(F.col("word") == F.lit(END_WORD), F.col("c"))).alias("ends")).first()
    total, distinct, ends = sums["total"] or 0, sums["distinct"], sums["ends"] or 0
    counts = counts.withColumn("class", class_column(F.col("word"), F.col("c"), classes))
    masses = np.ones(classes.n)
    found = counts.groupBy("class").agg(F.sum(F.col("c") + 0.1).alias("m")).toArrow()
    masses[found["class"].to_numpy()] = found["m"].to_numpy()
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    asked = dealt.select("block", "text").groupBy("block").applyInArrow(_requests, "block int, rank int, word binary")
    answers = stored(asked.join(counts, "word").select("block", "rank", "c", "class"), "answers")
    kind = dict(docs.dtypes)["id"]
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, inner double, classes binary"
    encoded = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_encoder(total, distinct, ends, masses, classes), schema)
    encoded = stored(encoded, "sequences")
    model = fit(encoded.where(~F.col("held_out")), classes, rounds, states)
    out = encoded.mapInArrow(_scorer(model, classes), f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
