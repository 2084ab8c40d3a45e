"""Toxicity and quality: held-out accuracy, and the parts against plain versions."""

from __future__ import annotations

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import quality as Q
from marlstone.llm import toxicity as T
from marlstone.llm.common import fold_of, labelled_sample

DATA = "/root/testdata/sf0.01"


def held_out_accuracy(spark, found, label):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    rows = found.filter("held_out").join(labels, "doc_id").select("predicted", "y").collect()
    return np.mean([r["predicted"] == r["y"] for r in rows])


def test_toxicity_held_out(spark):
    found = T.op6_toxicity(spark, DATA)
    assert found.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert held_out_accuracy(spark, found, "toxic") > 0.9


def test_quality_held_out(spark):
    found = Q.op10_quality_classifier(spark, DATA)
    assert found.filter("score < 0 or score > 1 or score is null").count() == 0
    assert held_out_accuracy(spark, found, "quality") > 0.9


def test_models_are_repeatable(spark):
    """Repeated labelled texts, and tables dealt otherwise, give the same bytes."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    more = docs.unionByName(docs.selectExpr("doc_id + 1000000 AS doc_id", "text"))
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    labels = labels.unionByName(labels.selectExpr("doc_id + 1000000 AS doc_id", "1 - quality AS quality", "1 - toxic AS toxic"))
    first = T.fit(more, labels), Q.fit(more, labels)
    again = T.fit(more.repartition(7), labels.repartition(3)), Q.fit(more.repartition(5), labels)
    assert pickle.dumps(sorted(first[0][0].items())) == pickle.dumps(sorted(again[0][0].items())) and first[0][1] == again[0][1]
    assert all(np.array_equal(getattr(first[1], f), getattr(again[1], f)) for f in ("vectors", "w1", "b1", "w2", "b2", "temperature", "centre", "scale"))


def test_folding_and_exceptions():
    lexicon = T.Lexicon({f" {T.fold('idiot').strip()} ": 3.0, f" {T.fold('tras').strip()}": 2.0})
    assert len(lexicon.hits(T.fold("You 1d10t, іdіоt and IDIOT!"))) == 3  # digits, Cyrillic letters, capitals
    assert len(lexicon.hits(T.fold("you !diot or i​di­ot"))) == 1
    assert len(lexicon.hits(T.fold("the trash can is full of trash"))) == 1
    assert lexicon.hits(T.fold("idiotic")) == {} and lexicon.hits(T.fold("")) == {}


def test_hits_against_brute_force():
    weights = {" ab": 1.0, " abc ": 2.0, " cd ": 0.5}
    for text in ("ab abc abcd cd cde", "", "xab", "abc abc"):
        want = {}
        folded = T.fold(text)
        for term, w in weights.items():
            at = folded.find(term)
            while at >= 0:
                want[at] = max(want.get(at, 0.0), w)
                at = folded.find(term, at + 1)
        assert T.Lexicon(weights, ()).hits(folded) == want


def test_word_vectors_against_loops():
    index = Q.index_vectors()
    assert np.abs(index).max() <= Q.NONZERO and (index != 0).sum(axis=1).max() <= Q.NONZERO
    texts = ["a b a", "c", "", "b   c"]
    buckets, counts = Q.tokens_of(texts)
    assert counts.tolist() == [3, 1, 0, 2]
    rows = np.split(buckets, np.cumsum(counts)[:-1])
    pooled = Q.pooled(texts, index)
    for r, p in zip(rows, pooled, strict=True):
        want = index[r].sum(axis=(0, 1)) / max(len(r), 1)
        assert p[:-1] == pytest.approx(want, abs=1e-4)
    sums, seen = Q.context_sums(texts, index)
    want = np.zeros_like(sums)
    for r in rows:
        for i in range(len(r)):
            near = sum(index[r[j, 0]] for j in (i - 1, i + 1) if 0 <= j < len(r))
            for c in range(3):
                want[r[i, c]] += near
    assert sums == pytest.approx(want) and seen.sum() == 3 * counts.sum()


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (6, None, None), (None, 1, 1), (7, 1, 0), (99, 5, 5)], "doc_id long, quality int, toxic int")
    for rows in (labels, labels.limit(0)):
        toxic = T.score_toxicity(odd, T.fit(odd, rows)).collect()
        good = Q.score_quality(odd, Q.fit(odd, rows)).collect()
        assert len(toxic) == len(good) == odd.count()
        assert all(0 <= r["toxicity"] <= 1 for r in toxic) and all(0 <= r["quality"] <= 1 for r in good)
    assert T.score_toxicity(none, T.fit(none, labels)).count() == 0
    assert Q.score_quality(none, Q.fit(none, labels)).count() == 0


def test_context_sums_by_parts(monkeypatch):
    """The same sums whatever is looked at together."""
    texts = ["a bb ccc dddd bb a", "", "one", "a bb a bb a bb a", "x y"]
    index = Q.index_vectors()
    whole = Q.context_sums(texts, index)
    monkeypatch.setattr(Q, "WORDS_AT_ONCE", 2)
    monkeypatch.setattr(Q, "TEXT_AT_ONCE", 5)
    parts = Q.context_sums(texts, index)
    assert np.allclose(whole[0], parts[0]) and (whole[1] == parts[1]).all() and whole[1].sum() == 3 * 16


def test_labels_that_disagree(spark):
    """An id with both labels counts as 1; other labels, null ids and the held-out fold are left out; of equal texts the smallest id counts."""
    docs = spark.createDataFrame([(k, f"text {min(k, 8)}") for k in range(12)] + [(None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0), (3, 7), (4, None), (None, 1), (8, 0), (9, 1), (5, 1)], "doc_id long, toxic int")
    held = {r["doc_id"] for r in docs.filter(fold_of(docs["doc_id"], 5) == 0).collect()}
    got = {r["doc_id"]: r["label"] for r in labelled_sample(docs, labels, "toxic", 5, 0, 1000).collect()}
    first = min({8, 9} - held, default=None)
    assert got == {k: v for k, v in {1: 1, 2: 0, 5: 1, first: {8: 0, 9: 1}.get(first)}.items() if k is not None and k not in held}
