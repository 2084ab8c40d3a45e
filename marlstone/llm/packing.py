"""Best-fit packing of tokenised documents into fixed-size sequences by a linear grouping scheme.

The work on documents (tokenising, cutting, ranking, placing) is done by Spark tasks. Only the
histogram of piece lengths, which has at most ``capacity`` rows at any corpus size, reaches the driver,
where the scheme lays out runs of equal sequences: lengths above a share of the capacity are rounded up
within groups of equal cardinality, few-size configurations are optimised by column generation, actual
lengths take the places of the rounded ones, and the short lengths are then placed best-fit.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from struct import pack

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read_table, text_of

CAPACITY = 4096
END_ID = 1
#: Lengths over capacity/LARGE_PART are large: at most LARGE_PART of them share a sequence.
LARGE_PART = 6
GROUPS = 48

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, nth long"


# ---------------------------------------------------------------- tokens

#: Chunks of ASCII and Latin-1 letters need no normalising but lower-casing.
_PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
_PARTS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")
_SPACES = re.compile(r"[ \t-\r]+")
#: Keys of a generation: chunks, which are put together from parts, and parts, which go through the tokenizer.
_CHUNKS_KEPT = 200_000
_PARTS_KEPT = 400_000


class Memory(dict):
    """What ``make`` gives for each key, remembered in two generations of up to ``kept`` keys."""

    def __init__(self, make: Callable[[str], bytes], kept: int):
        super().__init__()
        self.make, self.kept, self.old = make, kept, {}

    def __missing__(self, key: str) -> bytes:
        if (found := self.old.get(key)) is None:
            found = self.make(key)
        self[key] = found
        return found

    def turn(self) -> None:
        if len(self) > self.kept:
            self.old = dict(self)
            self.clear()


class WordTokens:
    """Ids of texts as little-endian 32-bit bytes, put together from those of white-space-free chunks.

    The vocabulary drops white space and never joins across it, nor across its words, digits and runs of symbols. So a text's ids
    are its chunks' ids in a row, and a plain chunk's those of its parts; other chunks go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        # The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for letters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.parts, self.chunks = Memory(self._part, _PARTS_KEPT), Memory(self._chunk, _CHUNKS_KEPT)

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(part)]
        return pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk):
            return b"".join(map(self.parts.__getitem__, _PARTS.findall(chunk.lower())))
        ids = self.whole.encode(chunk, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        self.parts.turn()
        self.chunks.turn()
        out = []
        for text in texts:
            # str.split also splits at characters that are spaces to Python alone.
            chunks = filter(None, _SPACES.split(text)) if _ODD_SPACE.search(text) else text.split()
            out.append(b"".join(map(self.chunks.__getitem__, chunks)))
        return out


_tokens: dict[str, WordTokens] = {}


def _tokenizer(path: str) -> WordTokens:
    if path not in _tokens:
        _tokens[path] = WordTokens(path)
    return _tokens[path]


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document's ids, the end id included: doc_id, piece, start, length,
    ids_crc32, nth (the piece's number among those of its length in its partition), and the ids
    (little-endian, 32 bits each) if ``with_ids``. Only documents over ``capacity`` are cut."""
    last = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * capacity

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, seen = _tokenizer(tokenizer_path), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                rows = []
                for doc_id, ids in zip(part["doc_id"], tokenizer.encode(part["text"].tolist()), strict=True):
                    ids += last
                    for k, a in enumerate(range(0, len(ids), step)):
                        raw = ids[a : a + step]
                        n = len(raw) // 4
                        rows.append((doc_id, k, a // 4, n, zlib.crc32(raw), seen[n], *([raw] if with_ids else ())))
                        seen[n] += 1
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "nth", *(["ids"] if with_ids else [])])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInPandas(cut_up, PIECES + (", ids binary" if with_ids else ""))


# ---------------------------------------------------------------- layout on the histogram


class Layout:
    """Runs of equally filled sequences, and runs of pieces placed in them.

    ``free[f]`` holds (first sequence, number) of runs with f places left. A placed run says: of the
    pieces of a length, those from ``rank`` on go ``each`` to a sequence, the first at ``offset``.
    """

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.free: dict[int, list[tuple[int, int]]] = {}
        self.levels: list[int] = []
        self.placed: list[tuple[int, int, int, int, int]] = []  # length, rank, sequence, each, offset

    def leave(self, first: int, n: int, free: int) -> None:
        if n and free:
            if free not in self.free:
                self.free[free] = []
                insort(self.levels, free)
            self.free[free].append((first, n))

    def open(self, n: int) -> int:
        first = self.sequences
        self.sequences += n
        return first

    def put(self, length: int, rank: int, first: int, n: int, free: int, each: int) -> None:
        self.placed.append((length, rank, first, each, self.capacity - free))
        self.leave(first, n, free - each * length)

    def best_fit(self, length: int, rank: int, n: int) -> None:
        """Place n pieces of one length, each where it leaves the least room; open sequences only when none fits."""
        while n:
            k = bisect_left(self.levels, length)
            if k == len(self.levels):
                each = self.capacity // length
                self.leave(self.open(-(-n // each)), -(-n // each), self.capacity)
                continue
            free = self.levels[k]
            first, count = self.free[free].pop()
            if not self.free[free]:
                del self.free[free], self.levels[k]
            each = min(free // length, n)
            used = min(count, n // each)
            self.put(length, rank, first, used, free, each)
            self.leave(first + used, count - used, free)
            rank, n = rank + used * each, n - used * each


def _groups(lengths: list[int], counts: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Lengths, descending, in groups of equal cardinality: each a list of [length, first rank, number]."""
    total = sum(counts[x] for x in lengths)
    size = max(1, -(-total // groups))
    out: list[list[list[int]]] = [[]]
    room = size
    for x in lengths:
        rank, n = 0, counts[x]
        while n:
            if not room:
                out.append([])
                room = size
            k = min(n, room)
            out[-1].append([x, rank, k])
            rank, n, room = rank + k, n - k, room - k
    return [g for g in out if g]


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """Column generation for min sum(x) with configurations of the sizes covering the demand: (times, configuration)."""
    g, most = len(sizes), int(capacity // sizes.min())
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(6 * g + 100):
        value = np.linalg.solve(basis.T, np.ones(g))
        best = np.zeros(capacity + 1)
        steps = []
        for _ in range(most):  # one more item at most in each round
            made, by = best.copy(), np.full(capacity + 1, -1, dtype=np.int32)
            for i, s in enumerate(sizes):
                if value[i] > 0:
                    better = best[:-s] + value[i] > made[s:] + 1e-12
                    made[s:][better] = best[:-s][better] + value[i]
                    by[s:][better] = i
            steps.append(by)
            best = made
        if best[capacity] <= 1 + 1e-7:
            break
        column, left = np.zeros(g), capacity
        for by in reversed(steps):
            if by[left] >= 0:
                column[by[left]] += 1
                left -= sizes[by[left]]
        x, d = np.linalg.solve(basis, demand), np.linalg.solve(basis, column)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    x = np.floor(np.maximum(np.linalg.solve(basis, demand), 0) + 1e-9).astype(np.int64)
    return [(int(n), basis[:, j].round().astype(np.int64)) for j, n in enumerate(x) if n]


def lay_out(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> Layout:
    """The linear grouping scheme over a histogram of lengths (each from 1 to ``capacity``)."""
    layout = Layout(capacity)
    if counts.get(capacity):
        layout.placed.append((capacity, 0, layout.open(counts[capacity]), 1, 0))
    large = sorted((x for x in counts if capacity / LARGE_PART < x < capacity), reverse=True)
    if large:
        grouped = _groups(large, counts, groups)
        sizes, which = np.unique([g[0][0] for g in grouped], return_inverse=True)
        stock: list[list[list[int]]] = [[] for _ in sizes]
        for g, k in zip(grouped, which, strict=True):
            stock[k] += g
        demand = np.array([sum(n for *_, n in s) for s in stock], dtype=float)
        for times, config in _configurations(sizes, demand, capacity):
            runs = [(layout.open(times), times, capacity)]
            for k in np.repeat(np.arange(len(sizes)), config)[::-1]:
                after = []
                for first, n, free in runs:
                    while n and stock[k]:
                        top = stock[k][0]
                        used = min(n, top[2])
                        layout.placed.append((top[0], top[1], first, 1, capacity - free))
                        after.append((first, used, free - top[0]))
                        top[1], top[2], first, n = top[1] + used, top[2] - used, first + used, n - used
                        if not top[2]:
                            stock[k].pop(0)
                    if n:
                        after.append((first, n, free))
                runs = after
            for run in runs:
                layout.leave(*run)
        for length, rank, n in sorted((x for s in stock for x in s), reverse=True):
            layout.best_fit(length, rank, n)
    for length in sorted((x for x in counts if x <= capacity / LARGE_PART), reverse=True):
        layout.best_fit(length, 0, counts[length])
    return layout


# ---------------------------------------------------------------- operator


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, groups: int = GROUPS, with_ids: bool = False) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the
    ids if ``with_ids``; sorting a sequence's pieces by offset gives it without gaps. Null and empty texts
    are a piece with the end id alone; rows with a repeated or null doc_id are packed one by one; other
    columns are not read, whatever their names. An empty table gives no rows.
    """
    pieces = cut(pieces_of(docs, tokenizer_path, capacity, end_id, with_ids).withColumn("block", F.spark_partition_id()))
    in_block = pieces.groupBy("length", "block").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(_by_length())
    starts = cut(in_block.select("length", "block", "n", (earlier - F.col("n")).alias("before")))
    counts = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    runs = np.array(sorted(lay_out(counts, capacity, groups).placed), dtype=np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast(runs)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table, x, r = shared.value, length.to_numpy(np.int64), rank.to_numpy(np.int64)
        key = lambda a, b: (a << 48) | b  # noqa: E731  lengths fit 15 bits, ranks 48
        run = table[np.searchsorted(key(table[:, 0], table[:, 1]), key(x, r), side="right") - 1]
        nth = r - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 2] + nth // run[:, 3], "offset": run[:, 4] + nth % run[:, 3] * x})

    placed = pieces.join(starts.select("length", "block", "before"), ["length", "block"]).withColumn("at", place("length", F.col("before") + F.col("nth")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *(["ids"] if with_ids else []))


def _by_length():
    from pyspark.sql import Window

    return Window.partitionBy("length").orderBy("block")


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all of ``documents``; see pack_documents."""
    return pack_documents(read_table(spark, sf_dir, "documents"), word_tokenizer_path())


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
