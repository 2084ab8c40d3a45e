from __future__ import annotations

import numpy as np
from compare import SF, rows_of_duck, rows_of_spark
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.llm import topk as K


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 60), st.integers(1, 5), st.integers(1, 12), st.integers(0, 10**6))
def test_aggregation_is_exact(n, dims, k, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-3, 4, (n, dims)).astype(float)  # small whole numbers: many ties
    ids = rng.permutation(n)
    got = K.aggregate(ids[:3], x[:3], ids, x, k, tiers=4)
    for i, q in zip(ids[:3], x[:3], strict=True):
        own = ids != i
        s = x[own] @ q
        order = np.lexsort((ids[own], -s))[:k]
        mine = got[got["query_id"] == i]
        assert list(mine["vec_id"]) == list(ids[own][order]) and list(mine["score"]) == list(s[order])


def test_reading_stops_early():
    """Where few components carry the scores, few tiers are read; the candidates' scores are exact."""
    rng = np.random.default_rng(3)
    x = np.floor(rng.pareto(1.2, (3000, 4)) * 10)
    got = K.aggregate(np.array([-1, -2]), np.array([[3.0, 1.0, 0.0, 0.0], [-1.0, 0.0, 2.0, 5.0]]), np.arange(3000), x, 5)
    assert got["tiers"].max() < K.TIERS
    for i, q in ((-1, [3.0, 1.0, 0.0, 0.0]), (-2, [-1.0, 0.0, 2.0, 5.0])):
        s = x @ np.array(q)
        assert list(got[got["query_id"] == i]["vec_id"]) == list(np.lexsort((np.arange(3000), -s))[:5])


def test_lengths_repeats_and_names(spark):
    """Vectors of other lengths take no part for a query; repeated rows and query ids are defined; other columns are not read."""
    rows = [(1, [1, 1]), (2, [2, 2, 2]), (3, [3, 3]), (3, [3, 3]), (1, [9, 9]), (4, [1, 1, 1]), *[(5, [7, 0])] * 50]
    df = spark.createDataFrame(rows, "vec_id long, v array<bigint>").selectExpr("vec_id", "v", "'x' as score", "'y' as asks", "1 as length")
    got = [tuple(r) for r in K.top_k(df.filter("vec_id in (1, 2)"), df, 4).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 5, 7), (1, 2, 5, 7), (1, 3, 5, 7), (1, 4, 5, 7), (2, 1, 4, 6)]
    got = [tuple(r) for r in K.top_k(df.filter("vec_id = 5"), df, 3).orderBy("rank").collect()]
    assert got == [(5, 1, 1, 63), (5, 2, 3, 21), (5, 3, 3, 21)]


def test_against_sql(spark, duck):
    assert rows_of_spark(K.op4_exact_top_k(spark, SF)) == rows_of_duck(duck, K.ORACLE_SQL["op4_exact_top_k"])


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (5, [1.0, 2.0]), (6, [1.0, 2.0]), (None, [9.0, 9.0]), (7, []), (0, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").filter(K.usable(F.col("embedding"))).select("vec_id", K.whole(F.col("embedding")).alias("v"))
    assert {r["vec_id"] for r in df.collect()} == {0, 5, 6, None}
    got = [(r["rank"], r["vec_id"]) for r in K.top_k(df.filter("vec_id = 5"), df, 10).orderBy("rank").collect()]
    assert got == [(1, 0), (2, 0), (3, 6)]
    assert K.top_k(df.limit(0), df, 3).count() == 0 and K.top_k(df, df.limit(0), 3).count() == 0
