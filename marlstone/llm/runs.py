"""Periodic runs of words, by an enhanced suffix array.

The words of a batch of texts are numbered so that no two texts share a number, and sorted into one suffix array by doubling; the longest common
prefixes (LCP) of neighbours come from the ranks of the doubling rounds. An LCP interval of depth d is a stretch of the array whose suffixes share their
first d words. For each suffix i of an interval's children but the largest, ``ISA[i + d]`` and ``ISA[i - d]`` are looked up: where one lies in the
interval but in another child, the two suffixes are apart by d and branch after d words, which is a square that no next word carries on. Such squares are
rotated to the left as far as they go and merged into runs. No tree nodes are made: intervals are pairs of places in the array.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_of
from .words import in_batches

#: A run's least length, in words and in periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Characters of the texts whose words are sorted together; a longer text is sorted by itself.
AT_ONCE = 1 << 21


def numbered_words(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal only for equal words of one text, and where each text begins (with the end)."""
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    numbers = np.empty(first[-1], dtype=np.int64)
    for words, a, b in zip(texts, first[:-1], first[1:], strict=True):
        seen: dict[bytes, int] = {}
        numbers[a:b] = np.fromiter(map(seen.setdefault, words, count(a)), dtype=np.int64, count=b - a)
    return numbers, first


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array, and the ranks by the first 1, 2, 4, ... numbers, each with -1 for the empty suffix; only what still ties is sorted again."""
    n = len(s)
    order = np.argsort(s, kind="stable").astype(np.int64)
    new = np.concatenate([[True], np.diff(s[order]) != 0]) if n else np.zeros(0, dtype=bool)
    rank = np.full(n + 1, -1, dtype=np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks, width = [rank], 1
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(tied):
        suffix, rank = order[tied], rank.copy()
        group = ranks[-1][suffix].astype(np.int64)
        key = group * (n + 1) + ranks[-1][np.minimum(suffix + width, n)] + 1
        by = np.argsort(key, kind="stable")
        suffix, key = suffix[by], key[by]
        order[tied] = suffix
        new = np.concatenate([[True], np.diff(key) != 0])
        rank[suffix] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        ranks.append(rank)
        tied, width = tied[~(new & np.append(new[1:], True))], 2 * width
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """lcp[k]: what the suffixes at places k-1 and k share; -1 at both ends."""
    n = len(order)
    lcp = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
    a, b, shared = order[at - 1].copy(), order[at].copy(), np.zeros(len(at), dtype=np.int64)
    for power in range(len(ranks) - 1, -1, -1):
        same = ranks[power][a] == ranks[power][b]
        step = same.astype(np.int64) << power
        a, b, shared = a + step, b + step, shared + step
    lcp[at] = shared
    lcp[0] = lcp[n] = -1
    return lcp


def _smaller(lcp: np.ndarray, places: np.ndarray, step: int) -> np.ndarray:
    """For each place the nearest one before (step -1) or after it (1) with a smaller value, by jumps over what is known not to be smaller."""
    jump = np.arange(len(lcp)) + step
    jump[0], jump[-1] = 0, len(lcp) - 1
    left = places
    while len(left):
        left = left[lcp[jump[left]] >= lcp[left]]
        jump[left] = jump[jump[left]]
    return jump[places]


def branching_squares(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and half length of every square that is not carried on by its next word; only intervals of enough suffixes for a run are looked at."""
    n = len(order)
    inverse = np.full(n + 1, -1, dtype=np.int64)
    inverse[order] = np.arange(n)
    places = np.flatnonzero(lcp > 0)
    left, right = _smaller(lcp, places, -1), _smaller(lcp, places, 1)  # an interval's suffixes: left to right - 1
    wide = right - left >= np.where(lcp[places] == 1, LEAST_WORDS, LEAST_PERIODS)
    places, left, right = places[wide], left[wide], right[wide]
    # Children begin at the interval's first place and at each of its own places.
    by = np.lexsort((places, right, left))
    places, left, right = places[by], left[by], right[by]
    head = np.ones(len(places), dtype=bool)
    head[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    starts = np.concatenate([left[head], places])
    low, high, depth = np.concatenate([left[head], left]), np.concatenate([right[head], right]), np.concatenate([lcp[places[head]], lcp[places]])
    by = np.lexsort((starts, high, low))
    starts, low, high, depth = starts[by], low[by], high[by], depth[by]
    last = np.ones(len(starts), dtype=bool)
    last[:-1] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    ends = np.where(last, high, np.append(starts[1:], 0))
    # All children but an interval's largest (the first of these).
    first = np.flatnonzero(np.append(True, last[:-1])) if len(starts) else np.zeros(0, dtype=np.int64)
    largest = np.maximum.reduceat(ends - starts, first) if len(first) else first
    interval = np.cumsum(np.append(True, last[:-1])) - 1 if len(starts) else first
    is_largest = np.flatnonzero(ends - starts == largest[interval]) if len(first) else first
    smaller = np.ones(len(starts), dtype=bool)
    smaller[is_largest[np.unique(interval[is_largest], return_index=True)[1]]] = False
    starts, ends, low, high, depth = starts[smaller], ends[smaller], low[smaller], high[smaller], depth[smaller]
    sizes = ends - starts
    child = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[child]
    suffix, d = order[place], depth[child]
    out_start, out_half = [], []
    for other, start in ((suffix + d, suffix), (suffix - d, suffix - d)):
        where = inverse[np.where((other < 0) | (other > n), n, other)]
        inside = (where >= low[child]) & (where < high[child]) & ((where < starts[child]) | (where >= ends[child]))
        out_start.append(start[inside])
        out_half.append(d[inside])
    both = np.unique(np.stack([np.concatenate(out_start), np.concatenate(out_half)]), axis=1)
    return both[0], both[1]


def _rotations(s: np.ndarray, start: np.ndarray, half: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many places each square can be rotated to the left, ``most`` at the highest."""
    turned = np.zeros(len(start), dtype=np.int64)
    going, steps = np.arange(len(start)), 0
    while len(going) and steps < 64:
        can = turned[going] < most[going]
        at = start[going] - turned[going] - 1
        going = going[can & (s[at] == s[at + half[going]])]
        turned[going] += 1
        steps += 1
    for k in going:  # long runs: growing stretches at once
        size = 64
        while turned[k] < most[k]:
            end = start[k] - turned[k]
            a = max(end - size, start[k] - most[k])
            other = np.flatnonzero(s[a:end] != s[a + half[k] : end + half[k]])
            if len(other):
                turned[k] += end - a - 1 - other[-1]
                break
            turned[k] += end - a
            size *= 2
    return turned


def runs_of(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start and period. s, first: as of ``numbered_words``."""
    if not len(s):
        return np.zeros((0, 4), dtype=np.int64)
    order, ranks = suffix_array(s)
    start, half = branching_squares(order, common_prefixes(order, ranks))
    by = np.lexsort((half, start + 2 * half))
    start, half = start[by], half[by]
    text = np.searchsorted(first, start, side="right") - 1
    found = []
    while len(start):
        # The square with the least period of each end; further ones there are of the same run if the run's period divides theirs.
        head = np.append(True, np.diff(start + 2 * half) != 0)
        s0, h0, t0 = start[head], half[head], text[head]
        turned = _rotations(s, s0, h0, s0 - first[t0])
        found.append(np.stack([t0, s0 - turned, 2 * h0 + turned, h0]))
        run = np.cumsum(head) - 1
        rest = ~head & ~((half % h0[run] == 0) & (start >= (s0 - turned)[run]))
        start, half, text = start[rest], half[rest], text[rest]
    t, a, length, period = np.concatenate(found, axis=1) if found else np.zeros((4, 0), dtype=np.int64)
    long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    made = np.stack([t, a - first[t], length, period])[:, long]
    return made[:, np.lexsort((made[3], made[1], made[0]))].T


def looped(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of the contract's text: of a tenth of the ids, those from one place on repeat a stretch. A null id counts as the empty text."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    again = words[a : a + p]
    return words[:a] + (again * (-(-(n - a) // p)))[: n - a]


def digest(words: list[bytes], runs: np.ndarray) -> tuple:
    """n_runs, the run with the greatest exponent (ties: smallest start, then period) and both hashes of a text; runs by start and period."""
    if not len(runs):
        return 0, None, None, None, None, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()
    best = runs[0].tolist()
    for r in runs[1:].tolist():
        if r[1] * best[2] > best[1] * r[2]:
            best = r
    kept = np.ones(len(words), dtype=bool)
    for a, length, period in runs.tolist():
        kept[a + period : a + length] = False
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs.tolist())
    collapsed = b" ".join([words[k] for k in np.flatnonzero(kept).tolist()])
    return len(runs), *best, 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()


def _by_text(texts: list[list[bytes]]) -> Iterator[np.ndarray]:
    s, first = numbered_words(texts)
    found = runs_of(s, first)
    ends = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield found[a:b, 1:]


def _texts(docs: DataFrame) -> DataFrame:
    """Ids as text, since pandas holds a column of longs with nulls as floats."""
    return docs.select(F.col("doc_id").cast("long").cast("string").alias("id"), text_of(docs).alias("text"))


def _ids(ids: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(i) else int(i) for i in ids], dtype="Int64")


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id and ``runs`` (array of start, length, period, by start then period) of every row of ``docs`` (doc_id, text; other columns are not
    read): the stretches of words with a smallest period q, at least 6 words and 4 periods long, that no neighbouring word carries on.

    Words are `[^\\x20\\x09-\\x0D]+`, case kept, numbered from 0. Null and empty texts have none; repeated rows and null ids are kept. Each
    text is looked at by itself, so an empty table gives no rows and nothing is shuffled. A task holds the words of about ``AT_ONCE`` characters, or of one
    longer text, some 200 bytes a word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = 0
            for some in in_batches(b["text"].tolist(), AT_ONCE):
                found = [[{"start": x, "length": y, "period": z} for x, y, z in r.tolist()] for r in _by_text([t.encode().split() for t in some])]
                yield pd.DataFrame({"doc_id": _ids(b["id"].iloc[at : at + len(some)]), "runs": found})
                at += len(some)

    return _texts(docs).mapInPandas(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all ``documents``, a tenth of which is looped first; see periodic_runs, looped and digest."""
    docs = read_table(spark, sf_dir, "documents")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = 0
            for some in in_batches(b["text"].tolist(), AT_ONCE):
                ids = _ids(b["id"].iloc[at : at + len(some)]).tolist()
                ids = [None if i is pd.NA else i for i in ids]
                texts = [looped(t.encode().split(), i) for t, i in zip(some, ids, strict=True)]
                rows = [(i, *digest(words, r)) for i, words, r in zip(ids, texts, _by_text(texts), strict=True)]
                yield pd.DataFrame(rows, columns=["doc_id", *_DIGEST]).astype({c: "Int64" for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")})
                at += len(some)

    columns = ", ".join(f"{c} {'string' if 'sha' in c else 'long'}" for c in ("doc_id", *_DIGEST))
    return _texts(docs).mapInPandas(run, columns)


_DIGEST = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")

QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLE_SQL: dict[str, str] = {}
