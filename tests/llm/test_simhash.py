from __future__ import annotations

import re

from compare import SF
import numpy as np
import pytest
import xxhash

from marlstone.llm import components, simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps, ids, radius):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    f = np.array(fps, dtype=np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1 :]) <= radius) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    low = {}
    for i in range(len(f)):
        if ids[i] is not None:
            low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low.get(find(i)) for i in range(len(f))]


@pytest.mark.parametrize("radius", [0, 2, 4, 8])
def test_documents_against_brute_force(spark, radius):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fps, ids = [plain(r["text"]) for r in rows], [r["doc_id"] for r in rows]
    want = dict(zip(ids, zip(fps, brute(fps, ids, radius), strict=True), strict=True))
    got = simhash.near_duplicates(spark.createDataFrame(rows), radius).collect()
    assert {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in got} == want


def test_crowds(spark):
    """Many fingerprints a few bits around some centres: crowded values, blocks and forests."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-(2**63), 2**63 - 1, 3)
    fps = sorted({int(c ^ np.int64(sum(1 << int(b) if b < 63 else 0 for b in rng.integers(0, 63, rng.integers(0, 5))))) for c in centres for _ in range(300)})
    links = simhash.link_fingerprints(spark.createDataFrame([(x,) for x in fps], "fp long"), 4)
    rows = links.collect()
    assert len(rows) < 40 * len(fps)
    roots = {r["node"]: r["root"] for r in components.components(links, "a", "b").collect()}
    want = brute([x & (2**64 - 1) for x in fps], fps, 4)
    assert [roots.get(x, x) for x in fps] == want


def test_shares_cover_the_radius():
    costs = [np.abs(np.random.default_rng(i).normal(size=(6, 40))) for i in range(4)]
    for c in costs:
        c[0] = 0
    shares = simhash.allocate(costs, 4)
    assert (shares.sum(axis=1) == 5).all() and (shares >= 0).all()
    import itertools

    for k in range(40):
        least = min(sum(costs[i][s[i], k] for i in range(4)) for s in itertools.product(range(6), repeat=4) if sum(s) == 5)
        assert sum(costs[i][shares[k, i], k] for i in range(4)) == pytest.approx(least)


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_odd_rows(odd, none):
    got = simhash.near_duplicates(odd)
    rows = got.collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["fp"] == 0 and by[3]["component_id"] == by[4]["component_id"] == by[5]["component_id"] == 3
    assert by[2]["component_id"] == 1
    assert simhash.near_duplicates(none).count() == 0
