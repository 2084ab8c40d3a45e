"""Running totals against a fold, with a group in many parts, ties, nulls and empty tables."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from marlstone.operators import budget
from marlstone.operators.prefix import dealt, numbered, running


def test_hot_group_against_fold(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), k, rng.choice([0, 1, 7, None])) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long, v int").repartition(7)
    found = running(df, ["g"], [F.desc("k")], parts=7, total=F.col("v"), n=F.lit(1))
    want, seen = {}, defaultdict(lambda: [0, 0])
    for g, k, v in sorted(rows, key=lambda r: -r[1]):
        seen[g][0] += v or 0
        seen[g][1] += 1
        want[k] = tuple(seen[g])
    got = found.collect()
    assert {r["k"]: (r["total"], r["n"]) for r in got} == want and len(got) == len(rows)
    placed = dealt(df, ["g"], [F.desc("k")], parts=7).filter("g = 'hot'").groupBy("_part").agg(F.min("k").alias("least"), F.max("k").alias("most")).orderBy("_part").collect()
    assert len(placed) > 3 and all(a["least"] > b["most"] for a, b in zip(placed, placed[1:]))


def test_ties_repeats_and_empty(spark):
    df = spark.createDataFrame([("x", 1)] * 500 + [("x", 0), (None, None)], "g string, k int").selectExpr("g", "k", "'z' as _part2")
    got = running(df, ["g"], [F.asc("k")], parts=6, n=F.lit(1)).collect()
    assert sorted(r["n"] for r in got if r["g"] == "x") == list(range(1, 502))
    assert [r["n"] for r in got if r["k"] == 0] == [1] and [r["n"] for r in got if r["g"] is None] == [1]
    assert numbered(df.limit(0), ["g"], [F.asc("k")], "n").count() == 0
    assert sorted(r["n"] for r in numbered(df, [], [F.asc("k")], "n").collect()) == list(range(1, 503))


def test_packing_of_large_and_bounded_groups_agree(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(rng.randint(0, 3), k, rng.choice([None, 0, 3, 50])) for k in range(400)], "c int, k int, n int")
    large = budget.pack_context(df, ["c"], [F.asc("k")], "n", 900)
    small = budget.pack_hits(df, ["c"], [F.asc("k")], "n", 900)
    assert sorted(map(tuple, large.collect())) == sorted(map(tuple, small.collect()))
