from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
from compare import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import runs as R


def brute(words):
    """All runs by the definition: each period's maximal stretches, without those of a smaller period."""
    n, found = len(words), {}
    for q in range(1, n):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and (i, length) not in found:
                found[i, length] = q
            i = j + 1
    return sorted((a, length, q) for (a, length), q in found.items())


def found_in(*texts):
    return [[tuple(r) for r in x.tolist()] for x in R._by_text([[w.encode() for w in t] for t in texts])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40) | st.lists(st.sampled_from("abc"), max_size=60), min_size=1, max_size=4))
def test_against_definition(texts):
    assert found_in(*texts) == [brute(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcd"), min_size=1, max_size=5), st.integers(1, 9)), min_size=1, max_size=5), st.lists(st.sampled_from("abx"), max_size=4))
def test_planted_runs(parts, tail):
    text = [w for unit, times in parts for w in unit * times] + tail
    assert found_in(text, text[::-1], text) == [brute(text), brute(text[::-1]), brute(text)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=60))
def test_suffix_array_and_prefixes(s):
    s = np.array(s)
    order, ranks = R.suffix_array(s)
    t = s.tolist()
    assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
    shared = lambda a, b: next((k for k in range(len(t)) if max(a, b) + k >= len(t) or t[a + k] != t[b + k]), 0)
    assert R.common_prefixes(order, ranks)[1:-1].tolist() == [shared(a, b) for a, b in zip(order, order[1:])]


def test_long_runs():
    """One word a hundred thousand times, a long period, and nested ones, without quadratic work."""
    n = 100_000
    block = [f"w{k % 97 if k % 5 else k}" for k in range(3_000)]
    nested = (["a"] * 9 + ["b"]) * 50 + ["c"]
    got = found_in(["x"] * n, block * 5, nested * 4)
    assert got[0] == [(0, n, 1)]
    assert (0, 15_000, 3_000) in got[1]
    assert got[2] == brute(nested * 4)


def test_looping_rule():
    words = [b"%d" % k for k in range(50)]
    for doc_id in (None, *range(200)):
        h = R.zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)
        want = words
        if h % 10 == 0:
            g = h // 10
            a = g % 50
            p = 1 + (50 - a) // (3 + g % 8)
            want = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert R.looped(words, doc_id) == want
    assert R.looped([], None) == []


def _want(doc_id, text):
    words = R.looped((text or "").encode().split(), doc_id)
    listed = brute(words)
    best = max(listed, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    dropped = {k for a, n, q in listed for k in range(a + q, a + n)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(listed), *four, sha("".join(f"{a},{n},{q}\n" for a, n, q in listed).encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in dropped)))


def test_query_against_definition(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = [d for d in docs if len(d["text"].split()) <= 1500]
    got = {r["doc_id"]: tuple(r) for r in R.op13_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs) and len(short) > 100
    for d in short:
        assert got[d["doc_id"]] == _want(d["doc_id"], d["text"])
    assert sum(r[1] > 0 for r in got.values()) > 10


def test_odd_rows(spark, odd, none, tmp_path):
    got = R.periodic_runs(odd)
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, brute((r["text"] or "").encode().split()[:3000])) for r in odd.collect() if r["doc_id"] != 8)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, [tuple(x) for x in r["runs"]]) for r in got.collect() if r["doc_id"] != 8) == want
    assert [tuple(x) for x in got.filter("doc_id = 8").first()["runs"]] == [(0, 9000, 1)]
    assert R.periodic_runs(none).count() == 0
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    rows = R.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r["doc_id"] is None:
            assert r["n_runs"] >= 0 and r["runs_sha256"] and r["collapsed_sha256"]
