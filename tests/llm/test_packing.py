from __future__ import annotations

import zlib
from collections import Counter

from compare import SF
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.llm import packing as P


def direct(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.word_tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    got = P._tokenizer(P.word_tokenizer_path()).encode([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == direct(text)[:-1]


def placed(layout, counts, capacity):
    used = Counter()
    runs = sorted(layout.placed)
    for k, (length, rank, sequence, each, offset) in enumerate(runs):
        stop = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == length else counts[length]
        for r in range(rank, stop):
            at = (sequence + (r - rank) // each, offset + (r - rank) % each * length)
            for x in range(at[1], at[1] + length):
                used[at[0], x] += 1
    return used


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 9), min_size=1, max_size=12), st.integers(12, 48))
def test_layout_is_gapless_and_tight(counts, groups):
    layout = P.lay_out(counts, 32, groups)
    used = placed(layout, counts, 32)
    assert set(used.values()) == {1} and len(used) == sum(k * n for k, n in counts.items())
    sizes = Counter(s for s, _ in used)
    assert all(x < sizes[s] <= 32 for s, x in used)
    assert set(sizes) == set(range(layout.sequences))
    assert layout.sequences <= -(-sum(k * n for k, n in counts.items()) // 32) * 1.7 + 2


def check(rows, texts, capacity=P.CAPACITY):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    pieces = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    want = Counter()
    for doc_id, text in texts:
        ids = direct(text)
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[a : a + capacity], dtype="<u4")
            want[doc_id, k, a, len(part), zlib.crc32(part.tobytes())] += 1
    assert pieces == want
    return len(by), -(-sum(r["length"] for r in rows) // capacity)


def test_whole_table(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    n, least = check(P.op5_best_fit_packing(spark, SF).collect(), texts)
    assert n <= least * 1.03 + 1


def test_odd_rows(odd, none):
    check(P.pack_documents(odd, P.word_tokenizer_path()).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert P.pack_documents(none, P.word_tokenizer_path()).count() == 0
    with_ids = P.pack_documents(odd, P.word_tokenizer_path(), with_ids=True)
    assert with_ids.filter(F.crc32("ids") != F.col("ids_crc32")).count() == 0
