from __future__ import annotations

import zlib
from collections import Counter

from compare import SF
import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import suffix_lm as S


def test_base_and_score(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for r in rows if not held(r["doc_id"]) for w in [*S.words_of(r["text"]), S.END])
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in S.op3_suffix_tree_lm(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        words, x = [*S.words_of(r["text"]), S.END], got[r["doc_id"]]
        assert x["held_out"] == held(r["doc_id"]) and x["n_tokens"] == len(words) and x["train_tokens"] == n
        assert x["n_known"] == sum(c[w] > 0 for w in words)
        assert x["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in words))
        assert x["score"] < 0


def grams(texts, depth):
    return [s[i - depth : i + 1] for t in texts for s in [S.END * depth + S.spelt(S.words_of(t))] for i in range(depth, len(s))]


def brute(texts, depth, least, gain):
    """The probability of a gram's last symbol, worked out context by context from plain counts."""
    counts = [Counter(g[depth - d :] for g in grams(texts, depth)) for d in range(depth + 1)]
    after = [Counter() for _ in range(depth + 1)]
    for d in range(depth + 1):
        for g, n in counts[d].items():
            after[d][g[:-1]] += n

    def diverges(context):
        d, own = len(context), {g: n for g, n in counts[len(context)].items() if g[:-1] == context}
        gained = sum(n * np.log(n / after[d][context] / (counts[d - 1][g[1:]] / after[d - 1][context[1:]])) for g, n in own.items())
        return after[d][context] >= least and gained > gain * len(own)

    kept = {c for d in range(2, depth + 1) for c in after[d] if diverges(c)}
    kept |= {c[k:] for c in kept for k in range(len(c) - 1)} | set(after[1])

    def p(gram):
        if len(gram) == 1:
            return (counts[0][gram] + 1) / (sum(counts[0].values()) + 256)
        d, context = len(gram) - 1, gram[:-1]
        if context not in kept:
            return p(gram[1:])
        kinds = sum(g[:-1] == context for g in counts[d])
        return (counts[d][gram] + kinds * p(gram[1:])) / (after[d][context] + kinds)

    return p, kept


@pytest.mark.parametrize(("least", "gain"), [(1, -1e9), (2, 0.0), (3, 0.5), (1, 1e9)])
def test_longest_suffix_against_brute_force(spark, least, gain):
    taught, others = ["the cat sat", "the dog sat", "a cat ran"] * 3 + ["abra cadabra"], ["the cat ran", "a dog", "", "zebra", "\u2603 abracadabra"]
    p, kept = brute(taught, 3, least, gain)
    assert (max(map(len, kept)) > 1) == (gain < 1e9)
    docs = spark.createDataFrame([(k, t, k >= len(taught)) for k, t in enumerate(taught + others)], "doc_id long, text string, apart boolean").repartition(3)
    got = {r["doc_id"]: r["score"] for r in S.score_texts(docs, docs["apart"], 3, least, gain).collect()}
    for k, t in enumerate(taught + others):
        assert got[k] == pytest.approx(sum(np.log10(p(g)) for g in grams([t], 3)), rel=1e-5)


def test_distributions_add_up():
    texts = ["abra cadabra", "abra abra abra", "cadabra"] * 9
    pairs = np.zeros((256, 256))
    for g in grams(texts, 4):
        pairs[g[-2], g[-1]] += 1
    seen = Counter(int.from_bytes(g, "big") for g in grams(texts, 4))
    for history in (b"\n\n\n\n", b"abra", b"dabr", b"zzzz", b"ra a"):
        asked = [(int.from_bytes(history, "big") << 8) | x for x in range(256)]
        every = sorted({*asked, *(k for k in seen if (k >> 8) & 0xFFFF == asked[0] >> 8 & 0xFFFF)})
        p = dict(zip(every, S.probabilities(np.array(every), np.array([float(seen[k]) for k in every]), pairs, 4, 1, 0.0), strict=True))
        assert sum(p[k] for k in asked) == pytest.approx(1)


def test_few_long_texts(spark):
    """Contexts from before a text occur once a text, however long the texts are."""
    texts = [" ".join(f"word{k % (7 + j)} and{k % 5}" for k in range(3000)) for j in range(2)]
    p, _ = brute(texts, S.DEPTH, S.LEAST_COUNT, S.GAIN)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in S.score_texts(docs, F.lit(False)).collect()}
    each = Counter(grams(texts[:1], S.DEPTH))
    assert got[0] == pytest.approx(sum(n * np.log10(p(g)) for g, n in each.items()), rel=1e-5)


def test_odd_rows(odd, none):
    got = S.score_texts(odd, F.lit(False)).collect()
    assert len(got) == odd.count()
    assert {r["n_tokens"] for r in got if r["doc_id"] in (3, 4, 5)} == {1}
    assert S.score_texts(none, F.lit(False)).count() == 0
    assert all(r["n_known"] == 0 for r in S.score_texts(odd, F.lit(True)).collect())


@pytest.mark.parametrize(("depth", "least", "gain"), [(2, 1, 0.0), (3, 2, 0.5), (6, 4, 2.0), (6, 1, 60.0), (5, 1, -1e9)])
def test_subtrees_apart_equal_the_whole(depth, least, gain):
    """Buckets of subtrees give what all grams together give."""
    rng = np.random.default_rng(depth)
    texts = [" ".join("".join(rng.choice(list("abcdefgh"), 4)) + "xy" for _ in range(40)) for _ in range(30)]
    texts += ["café naïve 雪的 word" * 3, "", "zz"]
    seen = Counter(int.from_bytes(g, "big") for g in grams(texts, depth))
    keys = np.array(sorted({*seen, *(int.from_bytes(g, "big") for g in grams(["unseen words here abxy"], depth))}))
    n = np.array([float(seen[k]) for k in keys.tolist()])
    triples = S.Triples(*S._triples(keys, n), least, gain)
    pairs = np.zeros((256, 256))
    np.add.at(pairs, ((keys >> 8) & 255, keys & 255), n)
    assert (triples.pairs == pairs).all()
    whole = S.probabilities(keys, n, pairs, depth, least, gain)
    bucket = triples.bucket(keys, 16)
    for b in np.unique(bucket):
        at = bucket == b
        assert S.probabilities(keys[at], n[at], pairs, depth, least, gain, triples) == pytest.approx(whole[at], rel=1e-12)


def test_a_hot_pair_lies_in_many_buckets():
    rng = np.random.default_rng(1)
    texts = [" ".join("".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(100)) + "x" for _ in range(60)]
    texts = [t.replace(" ", "e ") for t in texts]
    seen = Counter(int.from_bytes(g, "big") for g in grams(texts, 6))
    keys = np.array(sorted(seen))
    n = np.array([float(seen[k]) for k in keys.tolist()])
    triples = S.Triples(*S._triples(keys, n))
    hot = (keys >> 8) & 0xFFFF == int.from_bytes(b"e ", "big")
    sizes = np.bincount(triples.bucket(keys[hot], 64))
    assert sizes.max() < hot.sum() / 8
