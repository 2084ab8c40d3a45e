"""Exact vector search for tables of queries.

A collection's queries and rows are dealt into a grid of bounded blocks, so that a hot collection lies in many tasks; each block is one dense product
that gives every query its best few, and the blocks' winners are merged by rank. Nothing is broadcast, and no action runs before the plan is returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunking import fragments
from ..functions.models import Embedder, embedded
from .vector import DIGITS, first_by_key

#: Rows, and queries, of a block.
ROWS = 16_384
QUERIES = 8_192
#: Queries of a dense product.
AT_ONCE = 256
#: Rows that are scored in double precision at once.
CANDIDATES = 65_536


def rounded(x: np.ndarray) -> np.ndarray:
    """Half away from zero, as SQL rounds."""
    return np.copysign(np.floor(np.abs(x) * 10**DIGITS + 0.5) / 10**DIGITS, x)


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.vstack(vectors).astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _bars(score: np.ndarray, k: int) -> np.ndarray:
    """For each line a value that at least k of its scores reach: the k-th highest of the maxima of groups of 16, or of all where these are few."""
    n = score.shape[1]
    if n <= k:
        return np.full(len(score), -np.inf, dtype=np.float32)
    groups = n // 16
    of = score[:, : groups * 16].reshape(len(score), 16, groups).max(axis=1) if groups >= k else score
    return np.partition(of, of.shape[1] - k, axis=1)[:, of.shape[1] - k]


def _winners(queries: pd.DataFrame, rows: pd.DataFrame, k: int, shift: float) -> Iterator[pd.DataFrame]:
    """The best rows of each query. A product in single precision leaves every row that may be among them; those are scored in double precision and rounded."""
    q, x = _unit(queries["v"]), _unit(rows["v"])
    asked, usable = (np.flatnonzero(np.isfinite(v).all(axis=1)) for v in (q, x))  # zero vectors have no score
    if not len(usable):
        return
    order, names = pd.factorize(rows["key"].iloc[usable], sort=True)
    by_key = np.argsort(order, kind="stable")
    rows, x, order = rows.iloc[usable[by_key]], x[usable[by_key]], order[by_key]
    # Copies of a vector are scored once: its rows stand in a row, by key.
    copy = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    together = np.argsort(copy, kind="stable")
    rows, order, begins = rows.iloc[together], order[together], np.flatnonzero(np.diff(copy[together], prepend=-1))
    x, many = x[together[begins]], np.diff(begins, append=len(together))
    often = int(np.bincount(order).max())  # rows of a key
    keys, ids, small = rows["key"].to_numpy(), queries["query_id"].to_numpy(), x.astype(np.float32).T
    least, gone = queries["threshold"].to_numpy(np.float64), queries["excluded"].to_numpy()
    # By how much a score may differ from its single-precision one at most, and what rounding adds.
    off = (x.shape[1] + 8) * 2.0**-23 + 2 * 10.0**-DIGITS
    for at in range(0, len(asked), AT_ONCE):
        part = asked[at : at + AT_ONCE]
        out = [(i, g) for i, g in enumerate(gone[part]) if g is not None and len(g)]
        score = q[part].astype(np.float32) @ small
        wanted = k + often * max((len(g) for _, g in out), default=0)
        bar = np.maximum(_bars(score, wanted) - 2 * off, least[part] - shift - off).astype(np.float32)
        line, column = np.nonzero(score >= bar[:, None])
        exact = np.concatenate([np.einsum("ij,ij->i", q[part[line[i : i + CANDIDATES]]], x[column[i : i + CANDIDATES]]) for i in range(0, len(line), CANDIDATES)] or [np.empty(0)])
        exact, each = rounded(exact + shift), np.minimum(many[column], wanted)
        column = np.repeat(begins[column], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        line, exact = np.repeat(line, each), np.repeat(exact, each)
        fit = exact >= least[part][line]
        if out:
            lines = np.repeat([i for i, _ in out], [len(g) for _, g in out])
            codes = names.get_indexer(pd.Index(np.concatenate([np.asarray(g) for _, g in out])))
            fit &= ~np.isin(line * len(names) + order[column], (lines * len(names) + codes)[codes >= 0])
        line, column, exact = line[fit], column[fit], exact[fit]
        best = np.lexsort((order[column], -exact, line))
        line, column, exact = line[best], column[best], exact[best]
        first = np.arange(len(line)) - np.searchsorted(line, line) < k
        if len(line):
            yield pd.DataFrame({"query_id": ids[part[line[first]]], "key": keys[column[first]], "score": exact[first]})


def search_many(
    queries: DataFrame, rows: DataFrame, k: int, threshold: float = float("-inf"), collection: str | None = None, shift: float = 1.0,
    vec: str = "embedding", key: str = "vec_id", query_id: str = "query_id", block: tuple[int, int] = (QUERIES, ROWS),
) -> DataFrame:
    """query_id, key, score and rank: for every query the k best rows by cosine plus ``shift``, rounded, ties to the smaller key.

    queries: query_id, the vector, and if wanted ``threshold`` (a query's own least score; null is the common one), ``excluded`` (keys that it leaves out) and
    the collection's column, in which it searches; a null collection finds nothing. rows: key, the vector, the collection. Other columns are not read.
    Null, empty and zero vectors, null keys and vectors of another length than the query's take no part. Ids are unique on either side; of repeated query ids the
    results are mixed, repeated rows count each. An empty side gives no rows.
    """
    own = lambda df, name, kind, other: (F.col(name) if name in df.columns else other).cast(kind)
    vector = lambda df: F.col(vec).cast("array<float>" if dict(df.dtypes)[vec] == "array<float>" else "array<double>")
    kind = dict(rows.dtypes)[key]
    ids = dict(queries.dtypes)[query_id]
    scope = F.col(collection).cast("string") if collection else F.lit("")
    usable = F.col(vec).isNotNull() & (F.size(vec) > 0) & scope.isNotNull()
    asked = queries.filter(usable & F.col(query_id).isNotNull()).select(
        scope.alias("scope"), F.size(vec).alias("length"), F.col(query_id).alias("query_id"), vector(queries).alias("v"),
        F.coalesce(own(queries, "threshold", "double", F.lit(None)), F.lit(threshold)).alias("threshold"), own(queries, "excluded", f"array<{kind}>", F.lit(None)).alias("excluded"),
    )
    held = rows.filter(usable & F.col(key).isNotNull()).select(scope.alias("scope"), F.size(vec).alias("length"), F.col(key).alias("key"), vector(rows).alias("v"))
    grid = ["scope", "length"]
    many = asked.groupBy(*grid).agg(F.ceil(F.count("*") / block[0]).cast("int").alias("columns")).join(held.groupBy(*grid).agg(F.ceil(F.count("*") / block[1]).cast("int").alias("lines")), grid)
    place = lambda name, n: F.pmod(F.xxhash64(name), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(many, grid).select(*grid, place("query_id", F.col("columns")).alias("c"), every("lines").alias("r"), "query_id", "v", "threshold", "excluded")
    right = held.join(many, grid).select(*grid, every("columns").alias("c"), place("key", F.col("lines")).alias("r"), "key", "v")

    def best(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = list(_winners(asked, held, k, shift)) if len(asked) and len(held) else []
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "key": [], "score": []})

    blocks = left.groupBy(*grid, "r", "c").cogroup(right.groupBy(*grid, "r", "c"))
    found = blocks.applyInPandas(best, f"query_id {ids}, key {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select(F.col("query_id").alias(query_id), F.col("key").alias(key), "score", "rank")


def fused_many(text: DataFrame, image: DataFrame, query_id: str = "query_id", key: str = "vec_id", constant: int = 60) -> DataFrame:
    """query_id, key, score and rank of two result lists a query, as ``search_many`` gives: fused by reciprocal ranks for a query with rows in both
    (a row in both counts as the text list's in ties), else the one list by its own score."""
    both = text.withColumn("_list", F.lit(0)).unionByName(image.withColumn("_list", F.lit(1)))
    lists = Window.partitionBy(query_id)
    both = both.withColumn("_two", F.min("_list").over(lists) != F.max("_list").over(lists))
    part = F.when(F.col("_two"), 1.0 / (constant + F.col("rank"))).otherwise(F.col("score"))
    fused = both.groupBy(query_id, key).agg(F.round(F.sum(part), 9).alias("score"), F.min(F.struct("_list", "rank")).alias("_first"))
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), "_first", key)
    return fused.select(query_id, key, "score", F.row_number().over(order).alias("rank"))


def word_split_many(queries: DataFrame, store: DataFrame, embedder: Embedder, n: int, text: str = "query", field: str = "question", words: int = 2, key: str = "vec_id", **search) -> DataFrame:
    """query_id, key, score and rank: for every query ceil(n/2) of the rows nearest to it and floor(n/2) of those nearest to its fragments.

    queries: query_id and ``text``, cut into fragments of at most ``words`` words. store: key, ``field`` and embedding. Equal fragments are asked once. Of fragments' rows with one input
    field the last fragment's best counts; those whose field the query's own ``n`` rows have are left out. A query whose fragments find nothing keeps its own ``n`` rows,
    one without rows has none. search: further arguments of ``search_many``, which hold for fragments too."""
    search = {"key": key, "k": n, **search}
    named = store.select(key, field)
    carried = [c for c in ("threshold", "excluded", search.get("collection")) if c and c in queries.columns]
    asked = embedded(queries.select("query_id", text, *carried), text, "embedding", embedder)
    main = search_many(asked, store, **search).join(named, key)
    cut = fragments(queries.select("query_id", text, *carried), text, words).select("query_id", *carried, F.col("nth").alias("fragment"), F.col("fragment").alias("_text"))
    # One search for each text and scope, whoever asks it.
    cut = cut.withColumn("_asked", F.to_json(F.struct("_text", *carried)))
    texts = cut.groupBy("_asked").agg(*[F.first(c).alias(c) for c in ("_text", *carried)])
    found = search_many(embedded(texts, "_text", "embedding", embedder), store, **search, query_id="_asked").drop("rank")
    parts = cut.select("query_id", "fragment", "_asked").join(found, "_asked").drop("_asked").join(named, key)
    once = first_by_key(parts, ["query_id", field], [F.desc("fragment"), F.desc("score"), F.asc(key)])
    other = once.join(main.select("query_id", field), ["query_id", field], "left_anti")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    other = other.join(main.select("query_id").distinct(), "query_id", "left_semi").withColumn("_nth", F.row_number().over(best)).filter(F.col("_nth") <= n // 2)
    split = parts.select("query_id").distinct().withColumn("_split", F.lit(True))
    head = main.withColumnRenamed("rank", "_nth").join(split, "query_id", "left").filter(F.col("_split").isNull() | (F.col("_nth") <= n - n // 2))
    columns = ["query_id", key, field, "score"]
    return head.select(*columns).unionByName(other.select(*columns)).withColumn("rank", F.row_number().over(best))
