from __future__ import annotations

import random
from collections import defaultdict
from fractions import Fraction

import pytest
from compare import SF, rows_of_duck, rows_of_spark

from marlstone.llm import mixing as M


def leveled(sizes):
    """Targets by repeated resharing, in fractions. sizes: by source, in order."""
    weight = {s: M.WEIGHTS[k % 3] for k, s in enumerate(sizes)}
    open_, left, out = set(sizes), Fraction(sum(sizes.values())), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > M.MOST * sizes[s]}
        if not above:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: Fraction(M.MOST * sizes[s]) for s in above}
        left -= sum(M.MOST * sizes[s] for s in above)
        open_ -= above
    return out


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_copies(spark, seed):
    rng = random.Random(seed)
    names = ["hot"] * 30 + ["b", "é", "z", "ℵ", "𝒳", None, "none"] + ["rare"] * 2
    rows = [(k, n := rng.choice(names), None if n == "none" else " ".join(["w"] * rng.choice([0, 1, 2, 30, 200]))) for k in range(1500)]
    rows += [rows[3]] * 5 + [(None, "hot", "a b c"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as size", "'x' as target", "2 as copies")
    got = M.mix_plan(df.repartition(5)).collect()
    assert len(got) == len(rows)
    sizes, longest = defaultdict(int), defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
        longest[s] = max(longest[s], len((t or "").split()))
    ordered = {s: sizes[s] for s in sorted(sizes, key=lambda s: (s is None, (s or "").encode()))}
    want, taken = leveled(ordered), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - float(want[r["source"]])) < 1e-6 and 0 <= r["copies"] <= M.MOST
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - want[s]) <= longest[s] + 1 for s in sizes)
    again = M.mix_plan(df.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_emission(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice("aab"), "w " * rng.randint(0, 9), k) for k in range(300)] + [(7, "a", "same text", 7)] * 4 + [(None, "b", "x y", 0)] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, copy int")
    plan = M.mix_plan(df).collect()
    got = M.mixed(df).collect()
    assert len(got) == sum(r["copies"] for r in plan)
    count = lambda rows, n: {k: sum(n(r) for r in rows if (r["doc_id"], r["source"]) == k) for k in {(r["doc_id"], r["source"]) for r in rows if n(r)}}
    assert count(got, lambda r: 1) == count(plan, lambda r: r["copies"])
    assert set(got[0].asDict()) == {"doc_id", "source", "text", "copy"} and min(r["copy"] for r in got) == 0


def test_edges(spark):
    schema = "doc_id long, source string, text string"
    assert M.mix_plan(spark.createDataFrame([], schema)).count() == 0 and M.mixed(spark.createDataFrame([], schema)).count() == 0
    none = M.mix_plan(spark.createDataFrame([(1, None, None), (2, "a", "")], schema)).collect()
    assert [(r["size"], r["target"], r["copies"]) for r in none] == [(0, 0.0, 0)] * 2
    one = M.mix_plan(spark.createDataFrame([(1, "a", "x y z")], schema)).collect()
    assert [(r["size"], r["target"], r["copies"]) for r in one] == [(3, 3.0, 1)]


def test_against_sql(spark, duck):
    assert rows_of_spark(M.op11_source_mixing(spark, SF)) == rows_of_duck(duck, M.ORACLE_SQL["op11_source_mixing"])
