"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

Every word has a sparse ternary index vector drawn from its hash. A word's vector is its index vector plus the
scaled sum of the index vectors around its occurrences in the training sample. A document is the mean of the
vectors of its words; a token's shape (case, digits, symbols, length) and whether it repeats a recent one count as words
too. The network is trained, and its temperature set, on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fold_of, labelled_sample, read_table, text_of
from .words import SYMBOL, in_batches, mixed, words_of

DIMENSIONS = 64
NONZERO = 6
BUCKETS = 1 << 14
SHAPES = 256
SAMPLE_ROWS = 12_000
HIDDEN = 32
#: Characters and words that a task looks at together.
TEXT_AT_ONCE = 1 << 19
WORDS_AT_ONCE = 1 << 15
EPOCHS = 200

_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, dtype=np.int64)
_DIGIT[48:58] = 1


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the tokens of all texts in a row, (tokens, 3): word, shape, repetition; and each text's number of tokens."""
    w = words_of(texts)
    raw, start, end, word = w.raw, w.start, w.end, w.hash
    if not len(start):
        return np.zeros((0, 3), dtype=np.int32), w.counts
    n = end - start
    total = lambda table: (c := np.concatenate([[0], np.cumsum(table[raw])]))[end] - c[start]
    upper, digit, symbol = total(_UPPER), total(_DIGIT), total(SYMBOL)
    last = np.where(SYMBOL[raw[end - 1]] > 0, raw[end - 1], 0).astype(np.int64)
    shape = np.minimum(upper, 3) + 4 * np.minimum(digit, 2) + 12 * np.minimum(symbol, 3) + 48 * np.minimum(n // 6, 3) + 192 * last
    bucket = (mixed(word) % np.uint64(BUCKETS)).astype(np.int64)
    repeats = np.zeros(len(start), dtype=np.int64)
    text = np.repeat(np.arange(len(w.counts)), w.counts)
    for lag in (1, 2, 3, 4, 5, 6, 8, 10, 12):
        repeats[lag:] |= (word[lag:] == word[:-lag]) & (text[lag:] == text[:-lag]) & (n[lag:] > 4)
    shapes = (mixed(shape.astype(np.uint64)) % np.uint64(SHAPES)).astype(np.int64)
    return np.stack([bucket, BUCKETS + shapes, BUCKETS + SHAPES + repeats], axis=1), w.counts


def index_vectors() -> np.ndarray:
    """The sparse ternary vectors of all buckets, the same everywhere."""
    rows = BUCKETS + SHAPES + 2
    h = mixed(np.arange(rows * NONZERO, dtype=np.uint64) + np.uint64(1)).reshape(rows, NONZERO)
    out = np.zeros((rows, DIMENSIONS), dtype=np.float32)
    for k in range(NONZERO):
        np.add.at(out, (np.arange(rows), (h[:, k] % np.uint64(DIMENSIONS)).astype(int)), np.where(h[:, k] >> np.uint64(63), 1.0, -1.0))
    return out


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """The mean word vector of each text and the logarithm of its number of tokens; zeros for a text without tokens."""
    out = []
    for some in in_batches(texts, TEXT_AT_ONCE):
        buckets, counts = tokens_of(some)
        sums, first = np.zeros((len(some), vectors.shape[1])), 0
        for i, c in enumerate(counts):
            if c:
                own = np.bincount(buckets[first : first + c].ravel(), minlength=0)
                used = np.flatnonzero(own)
                sums[i] = own[used].astype(np.float32) @ vectors[used]
                first += c
        out.append(np.hstack([sums / np.maximum(counts, 1)[:, None], np.log1p(counts)[:, None]]))
    return np.vstack(out) if out else np.zeros((0, vectors.shape[1] + 1))


def context_sums(texts: list[str], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket, the sum of the index vectors of the words next to it, and its number of occurrences."""
    sums, seen = np.zeros_like(index, dtype=np.float64), np.zeros(len(index), dtype=np.int64)
    for some in in_batches(texts, TEXT_AT_ONCE):
        buckets, counts = tokens_of(some)
        words, text = buckets[:, 0], np.repeat(np.arange(len(some)), counts)
        same = (text[1:] == text[:-1])[:, None]
        for a in range(0, len(words), WORDS_AT_ONCE):
            b = min(a + WORDS_AT_ONCE, len(words))
            near = np.zeros((b - a, index.shape[1]), dtype=np.float32)
            after, before = max(a, 1), min(b, len(words) - 1)
            near[after - a :] += index[words[after - 1 : b - 1]] * same[after - 1 : b - 1]
            near[: before - a] += index[words[a + 1 : before + 1]] * same[a:before]
            for column in buckets[a:b].T:
                order = np.argsort(column, kind="stable")
                own, first = np.unique(column[order], return_index=True)
                sums[own] += np.add.reduceat(near[order], first, axis=0)
                seen[own] += np.diff(np.append(first, len(column)))
    return sums, seen


# ---------------------------------------------------------------- network


@dataclass
class Model:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, texts: list[str]) -> np.ndarray:
        return _sigmoid(self.logits(pooled(texts, self.vectors)) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, decay: float = 1e-4) -> Model:
    """Adam on the log loss over four fifths of the rows; the temperature is the best on the rest."""
    rng = np.random.default_rng(7)
    order = rng.permutation(len(x))
    held, kept = order[: len(x) // 5], order[len(x) // 5 :]
    centre, scale = x[kept].mean(axis=0), x[kept].std(axis=0) + 1e-6
    z, t = (x[kept] - centre) / scale, y[kept]
    rate = float(np.clip(t.mean(), 1e-3, 1 - 1e-3))
    weights = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), np.array(np.log(rate / (1 - rate)))]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // 2048)):
            step += 1
            h = np.tanh(z[rows] @ weights[0] + weights[1])
            d = (_sigmoid(h @ weights[2] + weights[3]) - t[rows]) / len(rows)
            back = np.outer(d, weights[2]) * (1 - h * h)
            for k, g in enumerate((z[rows].T @ back + decay * weights[0], back.sum(axis=0), h.T @ d + decay * weights[2], d.sum())):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - 0.01 * (1 - epoch / epochs) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    model = Model(vectors.astype(np.float32), centre, scale, weights[0], weights[1], weights[2], float(weights[3]), 1.0)
    if len(held) >= 20:
        logits, target = model.logits(x[held]), y[held]
        loss = lambda t: -np.mean(np.log(np.clip(np.where(target > 0, _sigmoid(logits / t), 1 - _sigmoid(logits / t)), 1e-12, 1)))
        model.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return model


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out_fold: int = 2, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The classifier from at most about ``sample_rows`` labelled rows. Without labels its score is one half; with one
    label only, near that label."""
    sample = cut(labelled_sample(docs, labels, "quality", folds, held_out_fold, sample_rows))
    index = index_vectors()

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, seen = np.zeros_like(index, dtype=np.float64), np.zeros(len(index), dtype=np.int64)
        for b in batches:
            s, n = context_sums(b["text"].tolist(), index)
            sums, seen = sums + s, seen + n
        own = np.flatnonzero(seen)
        if len(own):
            yield pd.DataFrame({"bucket": own, "n": seen[own], "near": list(sums[own])})

    # The sample is bounded, and so are the rows of each of its few partitions: at most one for each bucket.
    sums, seen = np.zeros_like(index, dtype=np.float64), np.zeros(len(index))
    parts = sample.select("text").mapInPandas(contexts, "bucket int, n long, near array<double>")
    added = parts.groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(F.col("near")[k]).cast("float").alias(f"d{k}") for k in range(DIMENSIONS)])
    got = added.toPandas()
    if len(got):
        seen[got["bucket"]] = got["n"]
        sums[got["bucket"]] = got[[f"d{k}" for k in range(DIMENSIONS)]].to_numpy(np.float64)
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    vectors = (index + np.sqrt(NONZERO) * sums / np.maximum(length, 1) * (seen > 2)[:, None]).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["doc_id"].to_numpy(), "x": list(pooled(b["text"].tolist(), shared.value)), "label": b["label"].to_numpy()})

    rows = sample.mapInPandas(pool, "id long, x array<double>, label int").toPandas().sort_values("id")
    if not len(rows):
        return Model(vectors, np.zeros(DIMENSIONS + 1), np.ones(DIMENSIONS + 1), np.zeros((DIMENSIONS + 1, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0)
    return train(np.vstack(rows["x"]), rows["label"].to_numpy(float), vectors)


# ---------------------------------------------------------------- operator


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with quality (0 to 1); a column of that name is replaced. Null and empty texts get the score of a text
    without words; rows with repeated or null ids are scored one by one; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS vectors of DIMENSIONS floats

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts.tolist()))

    return docs.select(*[docs[c] for c in docs.columns if c != "quality"], score(text_of(docs)).alias("quality"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all of ``documents`` with what rows outside fold 2 of 4 teach; see fit and score_quality."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
