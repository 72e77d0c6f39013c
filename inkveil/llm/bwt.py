"""Burrows-Wheeler transforms of shards of a text, and their merge by iterative interleave refinement.

A shard's suffixes are sorted once, to a depth, which gives its transform: the symbol (here of two bytes) before each suffix,
in their order. The merge never sorts suffixes again. Its only state is the interleave, a vector that says which shard the
next suffix comes from, and the boundaries of blocks of suffixes that are equal so far. A round walks over the interleave and
sends each entry to the next free place of the block of the suffix that lies some bytes before its own (the LF mapping of
that many bytes), so an interleave that is right to one depth becomes right to a greater one. The first rounds take the
transforms' symbols themselves as blocks, two bytes a round; from then on the blocks found so far serve as symbols, the LF
mapping composed with itself, and each round doubles the depth. All of it is counting: rounds take linear time.

Where a boundary appears in a round, the neighbours' common prefix lies between the depths before and after it; the blocks
left at the full depth are the repeated intervals, of suffixes with a common prefix of the depth or more.

Shards don't run into each other: the text is laid out with a gap before, between and after them, as long as the depth, whose
places rank below all others as what follows a suffix. Suffixes shorter than the depth may share a block with longer ones
that go on with zero bytes; no interval of whole windows depends on them.
"""

from __future__ import annotations

import numpy as np

#: Bytes of a symbol of the transforms, and rounds that take them.
WIDTH, SYMBOL_ROUNDS = 2, 2


def _first_words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as numbers of the same order."""
    raw = np.concatenate([text, np.zeros(15, np.uint8)])
    out = np.empty(len(text), np.uint64)
    for r in range(8):
        n = len(out[r::8])
        out[r::8] = raw[r : r + 8 * n].view(">u8")
    return out


def counting_order(key: np.ndarray) -> np.ndarray:
    """A stable order of small numbers by counting (numpy sorts 16-bit numbers by radix), 16 bits at a time."""
    order = np.argsort(key.astype(np.uint16), kind="stable")
    bits = int(key.max(initial=0)).bit_length()
    for shift in range(16, bits, 16):
        order = order[np.argsort((key >> shift).astype(np.uint16)[order], kind="stable")]
    return order


def _steps(known: int, depth: int) -> list[int]:
    """The steps of the doubling rounds from the known depth on."""
    out = []
    while known < depth:
        out.append(min(known, depth - known))
        known += out[-1]
    return out


class Layout:
    """Places of the shards' bytes with gaps around them, and a rank for each place."""

    def __init__(self, sizes: list[int], depth: int) -> None:
        self.sizes = np.array(sizes, np.int64)
        self.begin = np.cumsum([depth, *(self.sizes[:-1] + depth)])
        self.end = self.begin + self.sizes
        self.n = int(self.sizes.sum())
        gaps = [np.arange(a - depth, a) for a in (*self.begin, self.end[-1] + depth)]
        self.gaps = np.concatenate(gaps)
        self.rank = np.zeros(int(self.end[-1]) + depth, np.int32)

    def pushed(self, which: np.ndarray, symbol: np.ndarray, inverse: np.ndarray, step: int) -> np.ndarray:
        """A round: the interleave after every entry went to the block of the suffix step bytes before its own. symbol: of
        each entry, that block, or one above all where there is no such suffix. What ends within the step has nothing
        behind it and goes first in its block; inverse: by place, the entry of its shard."""
        last = np.concatenate([np.arange(max(a, b - step), b) for a, b in zip(self.begin, self.end, strict=True)])
        of = np.repeat(np.arange(len(self.sizes)), np.minimum(self.sizes, step)).astype(np.uint8)
        by = np.lexsort((inverse[last], of, self.rank[last]))
        to = counting_order(np.concatenate([self.rank[last][by], symbol]))[: self.n]
        return np.concatenate([of[by], which])[to]

    def starts(self, order: np.ndarray, step: int) -> np.ndarray:
        """Where a new block begins: the block of the suffix or of the one step bytes on changes."""
        self.rank[self.gaps] = -1
        own, behind = self.rank[order], self.rank[order + step]
        return np.concatenate([[True], (own[1:] != own[:-1]) | (behind[1:] != behind[:-1])])

    def number(self, order: np.ndarray, starts: np.ndarray) -> None:
        """Ranks by blocks."""
        self.rank[order] = np.cumsum(starts, dtype=np.int32) - 1

    def before(self, order: np.ndarray, step: int) -> np.ndarray:
        """The block of the suffix step bytes before each; above all where there is none."""
        self.rank[self.gaps] = self.n
        return self.rank[order - step]


def shard_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of a shard's suffixes, sorted to the depth: by their first words, then by doubling."""
    words = _first_words(text)
    n = len(text)
    # a suffix that ends within its first word comes before the longer ones that go on with zero bytes
    seq = np.concatenate([np.arange(n - 1, max(n - 8, -1), -1), np.arange(max(n - 7, 0))])
    order = seq[np.argsort(words[seq], kind="stable")]
    ranked, short = words[order], order > n - 8
    starts = np.concatenate([[True], (ranked[1:] != ranked[:-1]) | short[1:] | short[:-1]])
    own = Layout([n], depth)
    order = (order + own.begin[0]).astype(np.int32)
    for step in _steps(8, depth):
        if starts.all():
            break
        own.number(order, starts)
        last = np.arange(max(own.begin[0], own.end[0] - step), own.end[0], dtype=np.int32)
        last = last[np.argsort(own.rank[last], kind="stable")]
        to = counting_order(np.concatenate([own.rank[last], own.before(order, step)]))[:n]
        order = np.concatenate([last, order - step])[to]
        starts = own.starts(order, step)
    return order - own.begin[0]


def transform(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A shard's transform: the symbol (WIDTH bytes) before each suffix, in their order; the greatest number where it has
    too few bytes before it."""
    before = np.concatenate([np.zeros(WIDTH, np.uint8), text])
    out = (before[order].astype(np.int32) << 8) | before[order + 1]
    out[order < WIDTH] = 1 << 16
    return out


def merge(text: np.ndarray, bounds: list[int], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, interleave, common) of all suffixes of a text whose shards, 256 at most, begin at the bounds: positions, the
    shard that each comes from, and of each with its predecessor a lower bound of their common prefix, the depth itself
    within a repeated interval."""
    ends = [*bounds[1:], len(text)]
    texts = [text[a:b] for a, b in zip(bounds, ends, strict=True)]
    orders = [shard_order(t, depth) for t in texts]
    transforms = [transform(t, own) for t, own in zip(texts, orders, strict=True)]
    at = Layout([len(t) for t in texts], depth)
    placed = [(own + a).astype(np.int32) for own, a in zip(orders, at.begin, strict=True)]
    inverse = np.zeros(len(at.rank), np.int32)
    for own in placed:
        inverse[own] = np.arange(len(own), dtype=np.int32)
    for t, a in zip(texts, at.begin, strict=True):
        at.rank[a : a + len(t)] = (t.astype(np.int32) << 8) | np.concatenate([t[1:], np.zeros(1, np.uint8)])
    which = np.repeat(np.arange(len(texts)), at.sizes).astype(np.uint8)

    def taken(parts: list[np.ndarray]) -> np.ndarray:
        """The shards' own entries, dealt out by the interleave."""
        out = np.empty(at.n, np.int32)
        for k, part in enumerate(parts):
            out[which == k] = part
        return out

    known = 0
    for _ in range(SYMBOL_ROUNDS):
        which = at.pushed(which, taken(transforms), inverse, WIDTH)
        known += WIDTH
    order = taken(placed)
    starts = at.starts(order, WIDTH)
    common = np.where(starts, 0, known).astype(np.int32)
    for step in _steps(known, depth):
        if starts.all():
            break
        at.number(order, starts)
        which = at.pushed(which, at.before(order, step), inverse, step)
        order = taken(placed)
        seen, starts = starts, at.starts(order, step)
        starts |= seen
        common[~seen] = np.where(starts[~seen], known, known + step)
        known += step
    return order - (at.begin - np.array(bounds))[which], which, common


def earlier(text: np.ndarray, bounds: list[int], depth: int, place: np.ndarray) -> np.ndarray:
    """By position: whether its interval at the depth holds one of a smaller place. place: by position; negative: the
    position has no whole window and counts for nothing."""
    order, _, common = merge(text, bounds, depth)
    starts = common < depth
    where = place[order]
    open_ = where >= 0
    least = np.minimum.reduceat(np.where(open_, where, np.iinfo(np.int64).max), np.flatnonzero(starts))
    out = np.zeros(len(text), bool)
    out[order] = open_ & (least[np.cumsum(starts) - 1] < where)
    return out
