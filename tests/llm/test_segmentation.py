from __future__ import annotations

import zlib

from compare import SF
import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.llm import segmentation as G

V = G.vocabulary(G.piece_model_path())


def brute(text):
    s = G.SPACE + text.replace(G.SPACE, G._LITERAL).replace(" ", G.SPACE) if text else ""
    out = []

    def go(i, score, ids):
        if i == len(s):
            out.append((score, tuple(ids)))
            return
        if s[i] not in V.pieces:
            raw = {G._LITERAL: G.SPACE, G.SPACE: " "}.get(s[i], s[i]).encode()
            go(i + 1, score + V.unknown * len(raw), ids + [V.byte_ids[b] for b in raw])
        for j in range(i + 1, min(len(s), i + 16) + 1):
            if found := V.pieces.get(s[i:j]):
                go(j, score + found[1], ids + [found[0]])

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="the cat▁☃é,\n", max_size=9))
def test_n_best_is_exact(text):
    want, got = brute(text), V.segment(text, 4)
    assert [round(s, 3) for s, _ in got] == [round(s, 3) for s, _ in want[:4]]
    every = set(want)
    for s, ids in got:
        assert any(abs(s - w) < 1e-3 and i == tuple(np.frombuffer(ids, "<u4")) for w, i in every)
        assert V.decode(ids) == text
    assert len({ids for _, ids in got}) == len(got)


@pytest.mark.parametrize("text", ["aaaa", "a a a a", "the the", "abab" * 30])
def test_ties_give_different_segmentations(text):
    got = V.segment(text, 6)
    assert len({ids for _, ids in got}) == len(got) and [s for s, _ in got] == sorted((s for s, _ in got), reverse=True)


def test_no_segmentation_twice():
    for text in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist():
        got = V.segment(text or "", 4)
        assert len({ids for _, ids in got}) == len(got)


def test_long_text_without_spaces():
    for word in ("ab" * 50_000, "x" * 100_000):
        got = V.segment(word, 4)
        assert len({ids for _, ids in got}) == 4 and all(V.decode(ids) == word for _, ids in got)


def test_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = G.op2_n_best_segmentation(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(texts) and all(r["round_trip"] for r in got)
    for r in got[:20]:
        s, ids = V.segment(texts[r["doc_id"]], 1)[0]
        assert r["score"] == pytest.approx(s) and r["ids_crc32"] == zlib.crc32(ids)
        assert sorted((float(x.split(":")[0]) for x in r["n_best"].split("\n")), reverse=True) == [float(x.split(":")[0]) for x in r["n_best"].split("\n")]


def test_odd_rows(odd, none):
    got = G.digest_n_best(odd, G.piece_model_path()).collect()
    assert len(got) == odd.count() and all(r["round_trip"] for r in got)
    assert {r["n_pieces"] for r in got if r["doc_id"] in (3, 4)} == {0}
    assert G.digest_n_best(none, G.piece_model_path()).count() == 0
    rows = G.encode_n_best(odd, G.piece_model_path())
    back = G.decode(rows.withColumn("ids", F.col("segmentations")[0]["ids"]), "ids", G.piece_model_path())
    assert back.filter("NOT (decoded <=> text)").count() == 0
