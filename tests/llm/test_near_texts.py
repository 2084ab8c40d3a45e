"""Near copies against brute force by exact Jaccard over sets of five-word shingles."""

from __future__ import annotations

import random
from collections import defaultdict
from itertools import combinations

import corpus_pipeline as C
import numpy as np
import pyarrow.parquet as pq
import pytest
from compare import SF

from marlstone.llm import near_texts as N
from marlstone.llm import simhash


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    """The smallest id of each row's component, by all pairs."""
    sets, low = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}

    def root(x):
        return x if low[x] == x else root(low[x])

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if 5 * len(x & y) >= 4 * len(x | y) and root(i) != root(j):
                low[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i, _ in rows}


def found(spark, rows):
    return {r["doc_id"]: r["component_id"] for r in N.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_documents_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert found(spark, rows) == want and len(set(want.values())) < len(rows)


def _changed(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.random()}"
    return " ".join(out)


def test_recall_by_direct_pairs(spark):
    """Pairs of their own: all from 0.8 up are together, none below."""
    rng, rows = random.Random(3), []
    for k in range(150):
        words = [f"w{k}x{j}" for j in range(rng.choice((20, 60, 200)))]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, _changed(rng, words, rng.randrange(0, len(words) // 25 + 2)))]
    want = brute(rows)
    together = sum(want[2 * k + 1] == 2 * k for k in range(150))
    assert 20 < together < 130
    assert found(spark, rows) == want


def test_crowds_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "VOLUME", 900)
    rng = random.Random(4)
    base = [f"w{j}" for j in range(60)]
    rows = [(i, _changed(rng, base, rng.choice((0, 1, 2, 3)))) for i in range(120)]
    assert found(spark, rows) == brute(rows)


def test_pipeline_keeps_texts_below_the_threshold(spark):
    """70 and 92 are at a similarity of 0.71 and were taken for near copies."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id IN (70, 92, 87, 144, 106, 185)")
    kept = sorted(r["doc_id"] for r in C.keep_one_of_near_copies(spark, docs, SF).collect())
    assert kept == [70, 87, 92, 106, 144, 185]


def test_recall_by_bands_of_similarity():
    """Of all pairs of sf0.01 that share a five-word shingle and are at 0.8 or more: what shares a band, by similarity."""
    texts = {t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist() if t}
    sets = [shingles(t) for t in texts]
    bands = [set(N.bands_of(N.shingle_set(t)).tolist()) for t in texts]
    by_shingle = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            by_shingle[x].append(k)
    pairs = {p for ks in by_shingle.values() for p in combinations(ks, 2)}
    found = defaultdict(list)
    for a, b in pairs:
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if j >= 0.8:
            found[int(j * 20)].append(bool(bands[a] & bands[b]))
    assert sum(map(len, found.values())) > 0 and all(sum(x) >= 0.9 * len(x) for x in found.values())


def test_texts_of_repeated_words_stay_apart(spark):
    assert found(spark, [(1, "a b"), (2, "a b a b a b"), (3, "a b")]) == {1: 1, 2: 2, 3: 1}


def test_texts_ruled_by_one_line_stay_apart(spark):
    """Equal fingerprints by majority, different sets of shingles."""
    line = "the same line of seven words here " * 40
    rows = [(i, line + " ".join(f"own{i}x{k}" for k in range(20))) for i in range(3)]
    assert len({simhash.fingerprint(t, 2) for _, t in rows}) == 1
    assert found(spark, rows) == {0: 0, 1: 1, 2: 2}


@pytest.mark.parametrize("seed", range(4))
def test_forests_against_all_pairs(seed):
    """Components of a crowd that shares a passage, with near copies of several sizes, between two sides."""
    rng = np.random.default_rng(seed)
    passage, sets = rng.integers(0, 2**60, 150), []
    for _ in range(60):
        own = rng.integers(0, 2**60, int(rng.integers(1, 60)))
        sets.append(np.unique(np.concatenate([passage[rng.random(150) < rng.choice([1, 0.97, 0.9])], own])))
        if rng.random() < 0.5:
            sets.append(np.unique(np.concatenate([sets[-1][rng.random(len(sets[-1])) < 0.95], rng.integers(0, 2**60, 5)])))
    sets += [rng.integers(0, 2**60, k) for k in (1, 1, 2, 4, 5)] + [np.array([7]), np.array([7])]
    n = len(sets)
    cut = n if seed % 2 else n // 2
    left, right = np.arange(cut), np.arange(n) if seed % 2 else np.arange(cut, n)

    def joined(links):
        low = list(range(n))
        for a, b in links:
            a, b = low[a], low[b]
            low = [min(a, b) if x in (a, b) else x for x in low]
        return low

    alike = [(i, j) for i in left for j in right if i != j and 5 * len(s := np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]) - len(s))]
    got = N._forest(np.arange(n), sets, left, right)
    assert len(alike) > 10 and joined(got) == joined(alike)


def test_crowd_below_the_threshold(spark):
    """Texts that share a passage of 150 words and have 30 of their own, and a few real copies among them."""
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(150)]
    rows = [(i, " ".join(passage + [f"own{i}x{k}" for k in range(30)])) for i in range(400)]
    rows += [(1000 + i, _changed(rng, rows[i][1].split(), 2)) for i in range(20)]
    assert found(spark, rows) == {i: i % 1000 for i, _ in rows}
