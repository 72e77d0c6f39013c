"""Anchors of byte strings: positions chosen by content, so that equal windows choose equal ones.

Each window of ``length`` bytes chooses, among the grams of some bytes in it (GRAM unless said), the one with the smallest
hash (the leftmost of several). Two equal windows choose the same gram at the same offset, so whatever repeats meets at it; a
position serves all windows of a run, some forty bytes on average.
"""

from __future__ import annotations

import numpy as np

GRAM = 20


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each gram of that many bytes (uint64), 16 at least, from its words of eight bytes, the last of which
    may overlap."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.empty(len(data) - 7, np.uint64)
    for r in range(8):
        own = raw[r : r + (len(words[r::8])) * 8].view("<u8")
        words[r::8] = own[: len(words[r::8])]
    factors = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k, at in enumerate([*range(0, gram - 8, 8), gram - 8, None]):
            if at is not None:
                h += words[at : at + n]
            h *= np.uint64(factors[k % 4])
            h ^= h >> np.uint64(29 + 3 * (k % 2))
    return h


def anchors(data: np.ndarray, starts: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last): the chosen grams, and the run of windows' starts that choose each. starts: of all windows
    that count, ascending (those within one text)."""
    if not len(starts):
        return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 2
    h = gram_hashes(data, gram)
    w = length - gram + 1
    n = len(h)
    # the smallest of each w keys, by running minima over blocks of w from either end; ties go to the left
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = key
    padded = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    chosen = (np.minimum(behind[starts], ahead[starts + w - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)])
    at = np.flatnonzero(new)
    ends = np.concatenate([at[1:], [len(starts)]]) - 1
    return h[chosen[at]], starts[at], starts[ends]
