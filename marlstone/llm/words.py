"""Words of many texts at once: their places and 64-bit hashes, by numpy over the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
SYMBOL = np.zeros(256, dtype=np.int64)
SYMBOL[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_TURN = np.uint64(0x9E3779B97F4A7C15)

_BASE = 0x100000001B3
_BACK = pow(_BASE, -1, 1 << 64)
_STEP = 1 << 20  # the power tables' size


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), np.uint64(base))]), dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * _TURN
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """raw: the texts' bytes; start and end: each word's place there; hash: of the word in lower case with its ASCII symbols
    blanked; counts: each text's number of words."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    counts: np.ndarray


def words_of(texts: list[str]) -> Words:
    data = [t.encode() for t in texts]
    raw = np.frombuffer(b" ".join(data) + b" ", dtype=np.uint8)
    space = _SPACES[raw]
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    counts = np.diff(np.concatenate([[0], np.searchsorted(start, np.cumsum([len(d) + 1 for d in data]))]))
    with np.errstate(over="ignore"):
        # A polynomial hash of each word, by differences of running sums.
        at = np.arange(len(raw)) % _STEP
        up, down = _powers(_BASE, min(len(raw), _STEP)), _powers(_BACK, min(len(raw), _STEP))
        letters = np.where(SYMBOL[raw] > 0, np.uint64(0), _LOWER[raw])
        sums = np.concatenate([[np.uint64(0)], np.cumsum(letters * up[at], dtype=np.uint64)])
        h = sums[end] - sums[start]
        # A word over the end of a power table starts its powers anew; such words are hashed by themselves.
        whole = start % _STEP <= (end - 1) % _STEP
        h = h * down[start % _STEP]
        for k in np.flatnonzero(~whole):
            own = letters[start[k] : end[k]]
            h[k] = (own * _powers(_BASE, len(own))).sum(dtype=np.uint64)
    return Words(raw, start, end, h, counts)


def in_batches(texts: list[str], size: int = 1 << 21) -> Iterator[list[str]]:
    """The texts in runs of about ``size`` characters."""
    some, n = [], 0
    for t in texts:
        some.append(t)
        n += len(t)
        if n >= size:
            yield some
            some, n = [], 0
    if some:
        yield some
