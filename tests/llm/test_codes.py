from __future__ import annotations

import numpy as np
import pytest
from compare import SF, rows_of_duck, rows_of_spark
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import codes as C


def brute(rows):
    """rows: (vec_id, vector, label), all usable and of one length. Codes, errors and codebooks by plain loops."""
    x = [[max(-C.LARGEST, min(C.LARGEST, int(np.floor(256 * float(v))))) for v in r[1]] for r in rows]
    at = C.cuts(len(x[0]))
    ids = sorted({r[0] for r in rows}, key=lambda i: (i is None, i))[: C.ENTRIES]
    starts = [min((tuple(r[1]), k) for k, r in enumerate(rows) if r[0] == i)[1] for i in ids]
    codes, errors, books = [[] for _ in rows], [0] * len(rows), []
    for a, b in zip(at, at[1:]):
        part = [v[a:b] for v in x]
        book = [part[k] for k in starts]
        near = lambda v: min((sum((p - q) ** 2 for p, q in zip(v, e)), j) for j, e in enumerate(book))  # noqa: B023, E731
        for _ in range(C.ROUNDS):
            of = [near(v)[1] for v in part]
            book = [[sum(v[d] for v, o in zip(part, of) if o == j) // of.count(j) for d in range(b - a)] if j in of else e for j, e in enumerate(book)]
        for k, v in enumerate(part):
            d, j = near(v)
            codes[k].append(j)
            errors[k] += d
        books.append(book)
    return ["".join(f"{j:02x}" for j in c) for c in codes], errors, books


def found(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' as code", "1 as rows", "label as error")
    got, books = C.vector_codes(df)
    return [tuple(r) for r in got.collect()], books


@pytest.mark.parametrize("dims", [16, 20, 64, 5])
def test_against_loops(spark, dims):
    rng = np.random.default_rng(dims)
    centers = rng.normal(size=(12, dims))
    rows = [(int(k // 2 if k < 20 else k), (centers[rng.integers(12)] + rng.normal(size=dims) * rng.choice([0, 0.02, 0.3])).tolist(), int(k % 3)) for k in range(300)]
    rows += rows[40:45] + [(None, rows[7][1], None), (None, rows[9][1], None)]
    codes, errors, books = brute(rows)
    got, made = found(spark, rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    assert sorted(got, key=key) == sorted([(r[0], r[2], c, e) for r, c, e in zip(rows, codes, errors)], key=key)
    assert [b.tolist() for b in made] == books


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 400), st.integers(1, 5), st.integers(1, 64), st.integers(0, 10**6))
def test_shortlists_are_exact(n, dims, k, seed):
    rng = np.random.default_rng(seed)
    x, book = rng.integers(-9, 9, (n, dims)), rng.integers(-9, 9, (k, dims))
    codes, errors = np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.int64)
    counts, sums = C.Chunk.of(x).coded(book, codes, errors)
    apart = ((x[:, None] - book[None]) ** 2).sum(2)
    assert codes.tolist() == apart.argmin(1).tolist() and errors.tolist() == apart.min(1).tolist()
    assert counts.tolist() == np.bincount(codes, minlength=k).tolist()
    assert all((sums[j] == x[codes == j].sum(0)).all() for j in range(k))


def test_hilbert_curve():
    """Every cell once, and neighbours along the curve are neighbours in space."""
    grid = np.stack(np.meshgrid(*[np.arange(16)] * 2, indexing="ij"), -1).reshape(-1, 2) * 17  # the box is 0 to 255
    order = np.argsort(C.hilbert_keys(grid), kind="stable")
    assert len(np.unique(C.hilbert_keys(grid))) == 256
    assert (np.abs(np.diff(grid[order] // 17, axis=0)).sum(1) == 1).all()


def test_odd_vectors(spark):
    long = [float(k) for k in range(16)]
    rows = [(1, long, 1), (2, None, 1), (3, [float("nan"), *long[1:]], 1), (4, [None, *long[1:]], 2), (5, [float("inf"), *long[1:]], 2), (6, [1.0, 2.0], 2), (7, [], 3), (8, [1e300] * 16, None), (0, [], 5)]
    got, books = found(spark, rows)
    by = {r[0]: r for r in got}
    assert set(by) == {0, 1, 6, 7, 8} and by[1][2:] == ("00" * 16, 0) and by[8][2:] == ("01" * 16, 0)
    assert all(by[i][2:] == (None, None) for i in (0, 6, 7))
    assert C.vector_codes(spark.createDataFrame([(1, [], 1)], "vec_id long, embedding array<double>, label int"))[1] == []
    assert found(spark, [])[0] == []


def test_decoding(spark):
    rows = [(k, [float(k % 7)] * 16, 0) for k in range(30)] + [(40, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got, books = C.vector_codes(df)
    assert {r["vec_id"]: r["approximation"] for r in C.decoded(got, books).collect()} == {**{k: [256 * (k % 7)] * 16 for k in range(30)}, 40: None}


def test_against_sql(spark, duck):
    assert rows_of_spark(C.op12_vector_codes(spark, SF)) == rows_of_duck(duck, C.ORACLE_SQL["op12_vector_codes"])
