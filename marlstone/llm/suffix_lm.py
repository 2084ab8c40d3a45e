"""Language-model scores from a probabilistic suffix tree.

Texts are lower-cased words, each spelt as its UTF-8 bytes and a separator, and then an end; the tree's symbols are these
bytes. Its contexts are of variable length, up to ``DEPTH`` symbols: those that occur ``LEAST_COUNT`` times or more and whose
next-symbol distribution diverges from that of the context one symbol shorter, the contexts that these end in, and every single
symbol. Distributions are smoothed by those of the shorter contexts, and each symbol is scored in the longest context of the
tree that ends the history. All training texts are counted, and the tree grows with them.

One task's part of the documents is a unit. A unit's distinct grams (a symbol and the ``DEPTH`` before it) are summed with the
other units' by parts of the grams' hashes. Contexts of two symbols are learned once for all, from the counts of three symbols in a row. Where such a
context is in the tree by its own divergence, nothing that lies behind it can change that, so the contexts of three symbols that end
in it are roots of subtrees learned apart from each other; other contexts of two symbols are roots themselves. Subtrees are dealt
into buckets by hash. The probabilities go back by the same parts to the units, which score their documents with them. No task and
no broadcast holds the tree.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fold_of, read_table, shared_folder, text_of
from .words import mixed

DEPTH = 6
#: A context must occur so often.
LEAST_COUNT = 4
#: Log-likelihood gain that a context must bring for each of its next symbols.
GAIN = 2.0
END = b"\n"

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SYMBOLS_AT_ONCE = 1 << 20


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_LOWER).split()


def spelt(words: list[bytes]) -> bytes:
    return b" ".join(words) + b" \n" if words else END


def grams_of(data: list[bytes], depth: int = DEPTH) -> np.ndarray:
    """For every symbol of the spelt texts in a row, it and the ``depth`` before it as a number."""
    pad = END * depth
    raw = np.frombuffer(b"".join([pad + d for d in data]), dtype=np.uint8)
    grams = np.zeros(len(raw), dtype=np.int64)
    for j in range(depth + 1):
        grams[depth:] <<= 8
        grams[depth:] |= raw[j : len(raw) - depth + j]
    own = np.ones(len(raw), dtype=bool)
    first = np.cumsum([0, *(len(d) + depth for d in data[:-1])])
    own[(first[:, None] + np.arange(depth)).ravel()] = False
    return grams[own]


def _runs(data: list[bytes]) -> Iterator[slice]:
    """Consecutive texts of about ``_SYMBOLS_AT_ONCE`` symbols."""
    first, n = 0, 0
    for k, d in enumerate(data):
        n += len(d)
        if n >= _SYMBOLS_AT_ONCE or k + 1 == len(data):
            yield slice(first, k + 1)
            first, n = k + 1, 0


def summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of sorted runs, sorted, and the sums of their numbers."""
    every, counts = np.concatenate(keys), np.concatenate(n)
    if not len(every):
        return every, counts
    order = np.argsort(every, kind="stable")  # which merges runs
    every, counts = every[order], counts[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[first], np.add.reduceat(counts, first)


# ---------------------------------------------------------------- the tree


def _diverges(of: np.ndarray, m: np.ndarray, share: np.ndarray, expected: np.ndarray, total: np.ndarray, kinds: np.ndarray, least: int, gain: float) -> np.ndarray:
    """Whether each context occurs ``least`` times and its next symbols (of: the context of each) differ from what is expected."""
    seen = m > 0
    divergence = np.bincount(of[seen], weights=m[seen] * np.log(share[seen] / expected[seen]), minlength=len(total))
    return (total >= least) & (divergence > gain * kinds)


class Triples:
    """Three symbols in a row with their counts over the whole corpus, sorted; and of each context of two symbols its count, the
    number of its next symbols, and whether it diverges. At most 2^24 rows, whatever the corpus."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, least: int = LEAST_COUNT, gain: float = GAIN):
        self.keys, self.n = keys, n.astype(np.float64)
        self.pairs = np.bincount(keys & 0xFFFF, weights=self.n, minlength=1 << 16).reshape(256, 256)
        of = keys >> 8
        self.total, self.kinds = np.bincount(of, weights=self.n, minlength=1 << 16), np.bincount(of, minlength=1 << 16).astype(np.float64)
        plain = (self.pairs / np.maximum(self.pairs.sum(axis=1)[:, None], 1)).ravel()
        self.kept = _diverges(of, self.n, self.n / self.total[of], plain[keys & 0xFFFF], self.total, self.kinds, least, gain)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.n[at], 0.0)

    def bucket(self, grams: np.ndarray, buckets: int) -> np.ndarray:
        """The bucket of each gram's subtree."""
        context = grams >> 8
        root = np.where(self.kept[context & 0xFFFF], context & 0xFFFFFF | 1 << 24, context & 0xFFFF)
        return (mixed(root.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def probabilities(
    grams: np.ndarray, n: np.ndarray, pairs: np.ndarray, depth: int = DEPTH, least: int = LEAST_COUNT, gain: float = GAIN, triples: Triples | None = None
) -> np.ndarray:
    """The smoothed probability of each distinct gram's last symbol in the longest context of the tree.

    grams: all there are of some subtrees, with their counts in training (0 allowed); without ``triples``, all there are whose contexts
    end in some pairs of symbols. pairs: (256, 256) counts of symbols after each symbol, over the whole corpus."""
    root = pairs.sum(axis=0) + 1.0
    root /= root.sum()
    total, kinds = pairs.sum(axis=1)[:, None], (pairs > 0).sum(axis=1)[:, None]
    single = np.where(total > 0, (pairs + kinds * root) / np.maximum(total + kinds, 1), root)
    plain = pairs / np.maximum(total, 1)
    levels = []
    for d in range(2, depth + 1):
        keys, at = np.unique(grams & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
        m = np.bincount(at, weights=n, minlength=len(keys))
        contexts, of = np.unique(keys >> 8, return_inverse=True)
        whole = d == 2 and triples is not None
        if whole:
            m, total, kinds = triples.counts(keys), triples.total[contexts], triples.kinds[contexts]
        else:
            total, kinds = np.bincount(of, weights=m), np.bincount(of, weights=m > 0)
        shorter = keys & ((1 << 8 * d) - 1)
        below = np.searchsorted(levels[-1][0], shorter) if levels else None
        expected = levels[-1][6][below] if levels else plain[shorter >> 8, shorter & 255]
        share = m / np.maximum(total[of], 1)
        kept = triples.kept[contexts] if whole else _diverges(of, m, share, expected, total, kinds, least, gain)
        levels.append((keys, m, contexts, of, total, kinds, share, kept, below, at))
    for d in range(depth, 2, -1):
        ends = levels[d - 2][2][levels[d - 2][7]] & ((1 << 8 * (d - 1)) - 1)
        levels[d - 3][7][np.searchsorted(levels[d - 3][2], ends)] = True
    if not levels:
        return single[(grams >> 8) & 255, grams & 255]
    p = None
    for keys, m, _, of, total, kinds, _, kept, below, _ in levels:
        short = single[(keys >> 8) & 255, keys & 255] if p is None else p[below]
        p = np.where(kept[of], (m + kinds[of] * short) / np.maximum(total + kinds, 1)[of], short)
    return p[levels[-1][9]]


# ---------------------------------------------------------------- units and parts


def packed(a: np.ndarray) -> bytes:
    """Whole or real numbers as compressed planes of their bytes."""
    return zlib.compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes(), 1) if len(a) else b""


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), dtype=np.uint8).reshape(size, -1).T).view(kind).ravel() if raw else np.zeros(0, dtype=kind)


_UNIT_ROWS = "kind string, unit int, doc_id long, held_out boolean, words binary, part int, keys binary, n binary"
_NONE = dict.fromkeys(c.split()[0] for c in _UNIT_ROWS.split(", "))


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame([_NONE | r for r in rows], columns=list(_NONE))
    return out.astype({"doc_id": "Int64", "part": "Int32", "held_out": "boolean"})


def _order(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of some sorted keys by parts, and where the parts begin and end in it."""
    part = (mixed(keys.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _by_part(kind: str, unit: int, parts: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pd.DataFrame]:
    """A row for each part of some sorted keys: the keys and their numbers."""
    order, ends = _order(keys, parts)
    cuts = [(k, order[a:b]) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]
    yield _frame([{"kind": kind, "unit": unit, "part": k, "keys": packed(keys[at]), "n": packed(n[at])} for k, at in cuts])


def _word_keys(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)).view(np.int64)


def _triples(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grams' last three symbols with the sums of their counts, those in training."""
    taught = n > 0
    keys, at = np.unique((grams[taught] & 0xFFFFFF).astype(np.int32), return_inverse=True)
    return keys, np.bincount(at, weights=n[taught], minlength=len(keys)).astype(np.int64)


_ANSWERS = "kind string, unit int, part int, keys binary, value binary"


def _unit_rows(docs: DataFrame, parts: int, depth: int) -> DataFrame:
    """Of each unit, rows of kind 'doc' (its documents as numbers of its words), 'names' (its words), 'word' and 'gram' (by part, its
    distinct words and grams with their counts in training), and 'triple' (its three symbols in a row with their counts in training)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, numbers = TaskContext.get().partitionId(), {END: 0}
        seen = np.zeros(1 << 16, dtype=np.int64)
        keys, counts, held = [], [], 0
        for b in batches:
            rows, data = [], []
            for doc_id, text, held_out in zip(b["doc_id"], b["text"], b["held_out"], strict=True):
                words = words_of(text)
                data.append(spelt(words))
                local = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.uint32)
                if len(numbers) > len(seen):
                    seen = np.concatenate([seen, np.zeros(len(numbers), dtype=np.int64)])
                if not held_out:
                    seen[0] += 1
                    some, n = np.unique(local, return_counts=True)
                    seen[some] += n
                rows.append({"kind": "doc", "unit": unit, "doc_id": doc_id, "held_out": held_out, "words": packed(local)})
            if rows:
                yield _frame(rows)
            apart = b["held_out"].to_numpy(bool)
            for some in _runs(data):
                grams = grams_of(data[some], depth) << 1
                grams |= np.repeat(apart[some], [len(d) for d in data[some]])
                k, n = np.unique(grams, return_counts=True)
                keys.append(k >> 1)
                counts.append(np.where(k & 1, 0, n))
                held += len(k)
                if held > 600_000:
                    k, n = summed(keys, counts)
                    keys, counts, held = [k], [n], 0
        if keys:
            k, n = summed(keys, counts)
            del keys, counts
            yield from _by_part("gram", unit, parts, k, n)
            triple, m = _triples(k, n)
            yield _frame([{"kind": "triple", "unit": unit, "keys": packed(triple), "n": packed(m)}])
            words = list(numbers)
            yield _frame([{"kind": "names", "unit": unit, "words": zlib.compress(b" ".join(words[1:]), 1)}])
            word = _word_keys(words)
            order = np.argsort(word)
            yield from _by_part("word", unit, parts, word[order], seen[order])

    return docs.mapInPandas(run, _UNIT_ROWS)


def _totals(entries: DataFrame, triples: Triples, buckets: int) -> DataFrame:
    """(part, bucket, keys, n): the grams' sums over the units, those of each bucket of subtrees by themselves."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        keys, n = summed([unpacked(x, "<i8") for x in rows["keys"]], [unpacked(x, "<i8") for x in rows["n"]])
        bucket = triples.bucket(keys, buckets)
        order = np.argsort(bucket, kind="stable")
        kinds, first = np.unique(bucket[order], return_index=True)
        cuts = np.split(order, first[1:])
        return pd.DataFrame({"part": rows["part"].iloc[0], "bucket": kinds, "keys": [packed(keys[k]) for k in cuts], "n": [packed(n[k]) for k in cuts]})

    return entries.groupBy("part").applyInPandas(add, "part int, bucket long, keys binary, n binary")


def _subtrees(totals: DataFrame, triples: Triples, depth: int, least: int, gain: float) -> DataFrame:
    """(part, keys, value): the log10 probabilities of the grams."""

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [unpacked(x, "<i8") for x in rows["keys"]]
        p = probabilities(np.concatenate(keys), np.concatenate([unpacked(x, "<i8") for x in rows["n"]]).astype(np.float64), triples.pairs, depth, least, gain, triples)
        log = np.split(np.log10(p).astype(np.float32), np.cumsum([len(k) for k in keys])[:-1])
        return pd.DataFrame({"part": rows["part"].to_numpy(), "keys": rows["keys"].to_numpy(), "value": [packed(x) for x in log]})

    return totals.groupBy("bucket").applyInPandas(learn, "part int, keys binary, value binary")


def _gram_answers(entries: DataFrame, table: DataFrame) -> DataFrame:
    """(kind, unit, part, keys, value) for each row of the entries, with the table's values of its keys."""

    def look_up(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([unpacked(x, "<i8") for x in known["keys"]])
        values = np.concatenate([unpacked(x, "<f4") for x in known["value"]])
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        found = [packed(values[np.searchsorted(keys, unpacked(x, "<i8"))]) for x in asked["keys"]]
        return asked[["kind", "unit", "part", "keys"]].assign(value=found)

    return entries.groupBy("part").cogroup(table.groupBy("part")).applyInPandas(look_up, _ANSWERS)


def _word_answers(entries: DataFrame) -> DataFrame:
    """(kind, unit, part, keys, value) for each row of the entries, with its words' counts over all units and without the keys; and for
    each part a row of kind 'sums' with the number of its tokens and of its distinct words in training."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        asked = [unpacked(x, "<i8") for x in rows["keys"]]
        keys, n = summed(asked, [unpacked(x, "<i8") for x in rows["n"]])
        out = rows[["kind", "unit", "part"]].assign(keys=None, value=[packed(n[np.searchsorted(keys, k)]) for k in asked])
        sums = pd.DataFrame({"kind": ["sums"], "unit": [-1], "part": rows["part"].iloc[:1].to_numpy(), "keys": [None], "value": [np.array([n.sum(), (n > 0).sum()]).tobytes()]})
        return pd.concat([out, sums])

    return entries.groupBy("part").applyInPandas(add, _ANSWERS)


class Scores:
    """Log10 probabilities of known grams, found by tables of slots: each table holds one gram a slot, the next one what is left."""

    def __init__(self, keys: np.ndarray, log: np.ndarray):
        self.keys, self.log, self.tables = keys, log.astype(np.float64), []
        left = np.arange(len(keys))
        while len(left):
            shift = 63 - max(8, len(left).bit_length())
            slot = np.zeros(1 << (64 - shift), dtype=np.int32)
            at = self._slots(keys[left], len(self.tables), shift)
            slot[at] = left
            left = left[slot[at] != left]
            self.tables.append((shift, slot))

    @staticmethod
    def _slots(grams: np.ndarray, table: int, shift: int) -> np.ndarray:
        turn = np.uint64((0x9E3779B97F4A7C15 * (2 * table + 1)) & (1 << 64) - 1)
        with np.errstate(over="ignore"):
            h = grams.view(np.uint64) * turn
            h ^= h >> np.uint64(32)
            h *= turn
        return (h >> np.uint64(shift)).view(np.int64)

    def of(self, data: list[bytes], depth: int = DEPTH) -> np.ndarray:
        """The score of each spelt text."""
        out = []
        for some in _runs(data):
            grams = grams_of(data[some], depth)
            at = self.tables[0][1][self._slots(grams, 0, self.tables[0][0])]
            missed = np.flatnonzero(self.keys[at] != grams)
            for k, (shift, slot) in enumerate(self.tables[1:], 1):
                at[missed] = slot[self._slots(grams[missed], k, shift)]
                missed = missed[self.keys[at[missed]] != grams[missed]]
            out.append(np.add.reduceat(self.log[at], np.cumsum([0, *(len(d) for d in data[some][:-1])])))
        return np.concatenate(out) if out else np.zeros(0)


# ---------------------------------------------------------------- operator


def score_texts(docs: DataFrame, held_out: Column, depth: int = DEPTH, least: int = LEAST_COUNT, gain: float = GAIN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every text.

    Rows where ``held_out`` is true are scored but teach nothing. Null and empty texts have the end as their
    only token; rows with repeated or null ids each count and keep their row; other columns are not read. Without
    training rows every symbol is equally likely. An empty table gives no rows. ``depth``: 1 to 6 symbols, as a gram is one number.
    """
    if not 1 <= depth <= 6:
        raise ValueError(f"depth {depth} is not from 1 to 6")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"), held_out.alias("held_out"))
    # As many tasks as units or parts, so that what a task reads does not grow with the corpus.
    tasks = max(1, rows.rdd.getNumPartitions())
    parts = 4 * ceil(tasks ** (2 / 3))
    path = f"{shared_folder(spark)}/suffix-tree-{uuid.uuid4().hex}"
    _unit_rows(rows, parts, depth).write.partitionBy("kind").parquet(path)
    units = spark.read.schema(_UNIT_ROWS).parquet(path)

    def of_kind(kind: str) -> DataFrame:
        return units.filter(F.col("kind") == kind).select("kind", "unit", "part", "keys", "n").repartition(parts, "part")

    def triple_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, n in zip(b["keys"], b["n"], strict=True):
                yield pd.DataFrame({"triple": unpacked(k, "<i4"), "n": unpacked(n, "<i8")})

    # At most 2^24 rows, as columns.
    found = units.filter("kind = 'triple'").select("keys", "n").mapInPandas(triple_rows, "triple int, n long").groupBy("triple").agg(F.sum("n").alias("n")).toArrow()
    known = found["triple"].to_numpy().astype(np.int64)
    order = np.argsort(known)
    triples = Triples(known[order], found["n"].to_numpy()[order], least, gain)
    counted = cut(_word_answers(of_kind("word")))

    def both_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(np.array([np.frombuffer(x, dtype="<i8") for x in b["value"]]).reshape(-1, 2), columns=["tokens", "kinds"])

    sums = counted.filter("kind = 'sums'").select("value").mapInPandas(both_sums, "tokens long, kinds long").agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds")).first()
    tokens, kinds = int(sums["tokens"] or 0), int(sums["kinds"] or 0)
    grams = of_kind("gram")
    answers = counted.filter("kind = 'word'").unionByName(_gram_answers(grams, _subtrees(_totals(grams, triples, parts), triples, depth, least, gain).repartition(parts, "part")))
    log_all = float(np.log10(tokens + kinds + 1))

    def score(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        named = docs["kind"] == "names"
        words = [END, *zlib.decompress(docs["words"][named].iloc[0]).split()]
        docs = docs[~named]
        keys = _word_keys(words)
        order = np.argsort(keys)
        own = answers[answers["kind"] == "word"].sort_values("part")
        c = np.zeros(len(words), dtype=np.int64)
        c[order[_order(keys[order], parts)[0]]] = np.concatenate([unpacked(x, "<i8") for x in own["value"]])
        log = np.log10(c + 1.0)
        own = answers[answers["kind"] == "gram"]
        scores = Scores(np.concatenate([unpacked(x, "<i8") for x in own["keys"]]), np.concatenate([unpacked(x, "<f4") for x in own["value"]]))
        n, known, base, found = [], [], [], []
        for at in range(0, len(docs), 256):
            data = []
            for raw in docs["words"].iloc[at : at + 256]:
                local = unpacked(raw, "<u4")
                data.append(spelt([words[k] for k in local.tolist()]))
                n.append(len(local) + 1)
                known.append(int((c[local] > 0).sum()) + int(c[0] > 0))
                base.append(float(log[local].sum() + log[0]) - n[-1] * log_all)
            found.append(scores.of(data, depth))
        out = docs[["doc_id", "held_out"]].assign(n_tokens=n, n_known=known, train_tokens=tokens, base_score=base, score=np.concatenate(found) if found else [])
        return out.astype({"doc_id": "Int64"})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    texts = units.filter("kind IN ('doc', 'names')").select("kind", "unit", "doc_id", "held_out", "words")
    return texts.repartition(tasks, "unit").groupBy("unit").cogroup(answers.repartition(tasks, "unit").groupBy("unit")).applyInPandas(score, schema)


def op3_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all of ``documents``, learned from those outside fold 2 of 7; see score_texts."""
    docs = read_table(spark, sf_dir, "documents")
    return score_texts(docs, fold_of(docs["doc_id"], 7) == 2)


QUERIES = {"op3_suffix_tree_lm": op3_suffix_tree_lm}
ORACLE_SQL: dict[str, str] = {}
