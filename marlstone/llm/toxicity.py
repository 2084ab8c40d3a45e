"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding maps look-alike letters of other scripts, digits and symbols inside words to one small alphabet, so that
disguised spellings meet the lexicon's. The lexicon (whole words and word beginnings with log-odds weights) and the
logistic scale from length-normalised hits to a probability are learned from a bounded sample of labelled
rows. A hit inside an exception phrase does not count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fold_of, labelled_sample, read_table, text_of

#: Letters that look alike, by the Latin letter they are read as.
HOMOGLYPHS = {
    "a": "аαａ", "b": "вβｂ", "c": "сｃ", "d": "ԁｄ", "e": "еεｅ", "g": "ɡｇ", "h": "һнｈ", "i": "іιｉı", "j": "јｊ", "k": "кκｋ", "l": "ӏｌ",
    "m": "мｍ", "n": "ոｎ", "o": "оοｏ", "p": "рρｐ", "q": "ԛｑ", "r": "гｒ", "s": "ѕｓ", "t": "тτｔ", "u": "υսｕ", "v": "νѵｖ", "w": "ԝωｗ", "x": "хχｘ", "y": "уγｙ", "z": "ｚ",
}
#: Digits read as letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
#: Symbols read as letters between letters.
SYMBOLS = {"@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}
#: Phrases in which a listed word is meant otherwise.
EXCEPTIONS = (
    "trash can", "trash cans", "trash bin", "trash bag", "trash collection", "take out the trash", "white trash novel", "class clown",
    "clown fish", "circus clown", "birthday clown", "idiot proof", "idiot light", "pond scum", "soap scum", "sore loser", "stupid question",
    "worthless stock", "worthless bonds", "oxy moron",
)

SAMPLE_ROWS = 12_000
#: A term must be in so many of the sample's texts of label 1.
LEAST_TEXTS = 3
PREFIXES = range(4, 9)
FEATURES = 5


@cache
def _table() -> dict[int, str]:
    table = {i: " " for i in range(128) if not chr(i).isalpha()}
    table |= {ord(g): a for a, glyphs in HOMOGLYPHS.items() for g in glyphs}
    table |= {ord(d): a for d, a in DIGITS.items()}
    table |= dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370)], "")
    table |= {x: " " for x in (0x85, 0xA0, 0xA1, 0xAB, 0xB7, 0xBB, 0xBF, *range(0x2000, 0x200B), *range(0x2010, 0x2028), 0x3000)}
    return {k: "i" if v == "l" else v for k, v in table.items()} | {ord("l"): "i"}


_INSIDE = re.compile(r"(?<=[^\W\d_])[@$!|+](?=[^\W\d_])")


def fold(text: str) -> str:
    """Words in the matching alphabet (l reads as i), one space or more around each."""
    text = text.lower()
    if any(s in text for s in SYMBOLS):
        text = _INSIDE.sub(lambda m: SYMBOLS[m[0]], text)
    return f" {text.translate(_table())} "


class Lexicon:
    """Terms (" word " or " beginning") with weights, and exception phrases, in one automaton."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term, weight in weights.items():
            self.automaton.add_word(term, (len(term), weight))
        for phrase in exceptions:
            folded = f" {' '.join(fold(phrase).split())} "
            self.automaton.add_word(folded, (len(folded), None))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> dict[int, float]:
        """The largest weight by the start of each matched word."""
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, weight) in () if self.empty else self.automaton.iter(folded):
            start = end - n + 1
            if weight is None:
                spared.append((start, end))
            elif found.get(start, 0.0) < weight:
                found[start] = weight
        for a, b in spared:
            for start in [s for s in found if a <= s < b]:
                del found[start]
        return found

    def features(self, text: str) -> tuple[float, ...]:
        """Hit weights, whole and by length, of a text."""
        folded = fold(text)
        words = folded.count(" ") + 1
        weights = list(self.hits(folded).values())
        total, top = sum(weights), sorted(weights)[-2:]
        return (np.log1p(total), total / np.sqrt(words), top[-1] if top else 0.0, top[0] if len(top) == 2 else 0.0, np.log(words))


# ---------------------------------------------------------------- learning


def terms_of(text: str) -> set[str]:
    """The terms a text could put into a lexicon."""
    words = {w for w in fold(text).split() if len(w) > 2}
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in PREFIXES if len(w) >= k}


def learn_lexicon(sample: DataFrame, least: int = LEAST_TEXTS) -> dict[str, float]:
    """Log-odds weights of the terms surely tied to label 1. ``sample``: text, label; it is bounded, and so is the lexicon."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = (Counter(), Counter())
            for text, label in zip(b["text"], b["label"], strict=True):
                seen[label].update(terms_of(text))
            for label, c in enumerate(seen):
                if not c:  # an empty column of strings cannot be sent
                    continue
                yield pd.DataFrame({"term": list(c.keys()), "label": label, "n": list(c.values())})

    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return {}
    counts = sample.mapInPandas(count, "term string, label int, n long").groupBy("term").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b"))
    weight = F.log((F.col("a") + 0.5) / (pos + 1)) - F.log((F.col("b") + 0.5) / (neg + 1))
    sure = weight / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    kept = counts.filter(F.col("a") >= least).select("term", weight.alias("weight"), sure.alias("sure")).filter("weight > 1.5 and sure > 2").orderBy("term")
    return {r["term"]: r["weight"] for r in kept.collect()}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights (the last one the intercept) by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
    return w


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out_fold: int = 0, sample_rows: int = SAMPLE_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> tuple[dict[str, float], list[float]]:
    """The lexicon's weights and the scale's. Two thirds of at most about ``sample_rows`` labelled rows
    make the lexicon, the rest the scale."""
    sample = cut(labelled_sample(docs, labels, "toxic", folds, held_out_fold, sample_rows))
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(3))
    weights = learn_lexicon(sample.filter(part != 0))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(weights, exceptions)
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["doc_id"].to_numpy(), "x": [np.array(lexicon.features(t)) for t in b["text"]], "label": b["label"].to_numpy()})

    # At most about sample_rows/3 rows of numbers.
    measured = sample.filter(part == 0).mapInPandas(measure, "id long, x array<double>, label int").toPandas().sort_values("id")
    if measured["label"].nunique() < 2:
        rate = (measured["label"].sum() + 0.5) / (len(measured) + 1) if len(measured) else 0.01
        return weights, [0.0] * FEATURES + [float(np.log(rate / (1 - rate)))]
    return weights, logistic(np.vstack(measured["x"]), measured["label"].to_numpy(float)).tolist()


# ---------------------------------------------------------------- operator


def score_toxicity(docs: DataFrame, model: tuple[dict[str, float], list[float]], exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """``docs`` with toxicity (0 to 1) and n_hits; a column of either name is replaced. Null and empty texts get the
    score of no hits; rows with repeated or null ids are scored one by one; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # terms of a bounded sample

    @F.pandas_udf("score double, n_hits long")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights, scale = shared.value
        lexicon, w = Lexicon(weights, exceptions), np.array(scale)
        for texts in batches:
            x = np.array([lexicon.features(t) for t in texts]).reshape(-1, FEATURES)
            yield pd.DataFrame({"score": 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))), "n_hits": (x[:, 2] > 0).astype(np.int64) + (x[:, 3] > 0)})

    kept = [docs[c] for c in docs.columns if c not in ("toxicity", "n_hits", "_toxicity")]
    return docs.select(*kept, score(text_of(docs)).alias("_toxicity")).select(*[c for c in docs.columns if c not in ("toxicity", "n_hits", "_toxicity")], F.col("_toxicity.score").alias("toxicity"), F.col("_toxicity.n_hits").alias("n_hits"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all of ``documents`` with what rows outside fold 0 of 5 teach; see fit and score_toxicity."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE_SQL: dict[str, str] = {}
