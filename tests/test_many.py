"""Searches for tables of queries against plain loops: thresholds, exclusions, collections, blocks, ties, odd vectors."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.functions import models
from marlstone.operators.many import _winners, fused_many, search_many, word_split_many


def half_up(x):
    return math.copysign(math.floor(abs(x) * 1e6 + 0.5) / 1e6, x)


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return None if n == 0 else sum(x * y for x, y in zip(a, b, strict=True)) / n


@pytest.mark.parametrize("block", [(3, 7), (8192, 16384)])
def test_against_loops(spark, block):
    rng = random.Random(block[0])
    vec = lambda: rng.choice([[float(rng.randint(-2, 2)) for _ in range(3)], [0.0] * 3, None, [1.0, 2.0], []])
    rows = [(k, vec(), rng.choice(["hot", "hot", "hot", "a", None])) for k in range(120)] + [(5, [1.0, 1.0, 1.0], "hot"), (None, [1.0, 1.0, 1.0], "hot")]
    queries = [(k, vec(), rng.choice(["hot", "a", None, "absent"]), rng.choice([None, 1.2]), rng.choice([None, [], [1, 2, 3, 50]])) for k in range(40)]
    q = spark.createDataFrame(queries, "query_id long, embedding array<double>, c string, threshold double, excluded array<long>").withColumn("score", F.lit("x"))
    r = spark.createDataFrame(rows, "vec_id long, embedding array<double>, c string").withColumn("rank", F.lit("x"))
    want = []
    for qid, v, c, least, gone in queries:
        if not v or c is None:
            continue
        scored = [(half_up(s + 1), key) for key, x, d in rows if key is not None and d == c and x and len(x) == len(v) and key not in (gone or []) and (s := cosine(v, x)) is not None]
        best = sorted((s for s in scored if s[0] >= (0.9 if least is None else least)), key=lambda s: (-s[0], s[1]))[:4]
        want += [(qid, key, s, n) for n, (s, key) in enumerate(best, 1)]
    got = [tuple(x) for x in search_many(q, r, 4, threshold=0.9, collection="c", block=block).collect()]
    assert sorted(got) == sorted(want)
    assert len(want) > 20
    for a, b in ((q.limit(0), r), (q, r.limit(0))):
        assert search_many(a, b, 4, collection="c").count() == 0


def test_text_keys_and_large_ids(spark):
    big = 2**60
    q = spark.createDataFrame([(big + 1, [1.0, 0.0], [f"k{2}"])], "query_id long, embedding array<float>, excluded array<string>")
    r = spark.createDataFrame([(f"k{n}", [1.0, float(n)]) for n in range(6)], "vec_id string, embedding array<float>")
    assert [(x["query_id"], x["vec_id"]) for x in search_many(q, r, 3).orderBy("rank").collect()] == [(big + 1, "k0"), (big + 1, "k1"), (big + 1, "k3")]


def test_fusion_by_query(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "query_id int, vec_id int, score double, rank int")
    text = rows((1, 10, 1.9, 1), (1, 11, 1.5, 2), (2, 10, 1.4, 1))
    image = rows((1, 11, 0.9, 1), (1, 12, 0.8, 2), (3, 12, 0.7, 1))
    got = [tuple(r) for r in fused_many(text, image).orderBy("query_id", "rank").collect()]
    assert [(q, v) for q, v, _, _ in got] == [(1, 11), (1, 10), (1, 12), (2, 10), (3, 12)]
    assert got[3][2] == 1.4 and got[0][2] == round(1 / 62 + 1 / 61, 9)


def test_word_split(spark):
    """A query's own rows and its fragments' share the places; without fragments it keeps its own; without rows it has none."""
    store = models.embedded(spark.createDataFrame([(k, t) for k, t in enumerate(["red apple pie", "red apple", "green pear", "blue plum jam", "red apple pie"])], "vec_id long, question string"), "question", "embedding", models.HashingEmbedder())
    queries = spark.createDataFrame([(1, "red apple green pear"), (2, ""), (3, None), (4, "red")], "query_id long, query string")
    got = word_split_many(queries, store, models.HashingEmbedder(), 3, threshold=1.2).orderBy("query_id", "rank").collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(by) == {1, 4} and by[1][0] == 1 and len(set(by[1])) == len(by[1]) <= 3
    assert len(by[4]) == 2 and by[4][0] == 1


def test_copies_of_a_vector_in_a_block():
    """Copies are scored once and come by key, also where some are left out or a key is repeated; a block's results are not a frame for each query."""
    rows = pd.DataFrame({"key": [9, 3, 3, 7, 1, 5, 8], "v": [[1.0, 1.0]] * 6 + [[1.0, 0.5]]})
    queries = pd.DataFrame({"query_id": [1, 2, 3], "v": [[1.0, 1.0], [1.0, 1.0], [0.0, 0.0]], "threshold": [float("-inf")] * 3, "excluded": [None, np.array([3, 1, 4]), None]})
    found = list(_winners(queries, rows, 4, 1.0))
    assert len(found) == 1
    assert [tuple(r) for r in found[0][["query_id", "key"]].itertuples(index=False)] == [(1, 1), (1, 3), (1, 3), (1, 5), (2, 5), (2, 7), (2, 9), (2, 8)]
