"""Exact top-k inner products by no-random-access aggregation.

Each dimension is a list of the vectors sorted by their component, read from the top for a positive query weight and
from the bottom for a negative one. Lists are read sequentially, a tier of ranks at a time, and what a tier brings is added to
running lower bounds. An unread component lies between the last one read and the list's end, which gives the upper bounds. Reading
stops for a query once few vectors can reach its k-th best lower bound, and their final scores are then resolved; vectors that
are no candidates of any open query are left out of the further bounds. Vectors and queries are dealt into a grid of bounded
blocks, each aggregated in one task; the blocks' winners are merged by rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table

#: Vectors and queries of a block.
VECTORS = 8192
QUERIES_AT_ONCE = 1024
TIERS = 12


def aggregate(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, tiers: int = TIERS) -> pd.DataFrame:
    """The k best vectors of one block for each query, itself excluded: query_id, vec_id, score, and the tiers read for the query;
    ties to the smaller id.

    Whole numbers held as doubles stay exact as long as scores are below 2^53."""
    n, dims = x.shape
    order = np.argsort(-x, axis=0, kind="stable")
    ranked = np.take_along_axis(x, order, axis=0)
    size, least, most = -(-n // tiers), ranked[-1], ranked[0]
    out, open_, alive = [], np.arange(len(q)), np.arange(n)
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    lower = np.repeat((plus @ least + minus @ most)[:, None], n, axis=1)
    unread_down, unread_up = np.ones((n, dims), dtype=bool), np.ones((n, dims), dtype=bool)
    for tier in range(tiers):
        first, end = size * tier, min(size * (tier + 1), n)
        column = np.full(n, -1)
        column[alive] = np.arange(len(alive))
        qp, qm = plus[open_], minus[open_]
        # The next run of each list from the top, and from the bottom: what it adds to the bounds, by candidate.
        for runs, weights, worst, unread in ((order[first:end], qp, least, unread_down), (order[n - end : n - first], qm, most, unread_up)):
            np.put_along_axis(unread, runs, False, axis=0)
            brought = np.zeros((len(alive) + 1, dims))  # what is read of other vectors goes to the last row
            np.put_along_axis(brought, column[runs], np.take_along_axis(x, runs, axis=0) - worst, axis=0)
            lower += weights @ brought[:-1].T
        last = end == n
        own = query_ids[open_][:, None] == ids[alive][None, :]
        known = np.where(own, -np.inf, lower) if own.any() else lower
        many = min(k, len(alive))
        bar = np.partition(known, len(alive) - many, axis=1)[:, len(alive) - many]
        if last:
            upper = known
        else:
            slack = (qp * (ranked[end - 1] - least)) @ unread_down[alive].T + (qm * (ranked[n - end] - most)) @ unread_up[alive].T
            upper = known + slack
        inside = (upper >= bar[:, None]) & ~own
        done = (inside.sum(axis=1) <= max(4 * k, 64)) | last
        for i in np.flatnonzero(done):
            at = alive[inside[i]]
            final = x[at] @ q[open_[i]]
            best = np.lexsort((ids[at], -final))[:k]
            out.append((np.full(len(best), query_ids[open_[i]]), ids[at[best]], final[best], np.full(len(best), tier + 1)))
        wanted = inside[~done].any(axis=0)
        open_, alive, lower = open_[~done], alive[wanted], lower[np.ix_(~done, wanted)]
        if not len(open_) or last:
            break
    columns = ("query_id", "vec_id", "score", "tiers")
    if not out:
        return pd.DataFrame({c: [] for c in columns}).astype("int64")
    return pd.DataFrame({name: np.concatenate(c).astype(np.int64) for name, c in zip(columns, zip(*out, strict=True), strict=True)})


def top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products over all vectors but its own id,
    ties to the smaller vec_id.

    Both inputs: vec_id (long) and v (array of whole numbers, bigint); other columns are not read. A query is held against the
    vectors of its length. Of several queries of one id, the one whose vector sorts first is asked. Repeated vectors count
    one by one, and only what can be among the k best of each leaves its place; rows with a null id take no part. An empty
    side gives no rows.
    """
    queries = queries.filter("vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v"), F.lit(1).alias("copies"))
    vectors = vectors.filter("vec_id is not null")
    columns = -(-max(queries.count(), 1) // QUERIES_AT_ONCE)
    rows = -(-max(vectors.count(), 1) // VECTORS)
    vectors = vectors.groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    length = F.size("v").alias("length")
    left = queries.select(length, deal(columns).alias("c"), every(rows).alias("r"), F.lit(True).alias("asks"), "vec_id", "v", "copies")
    right = vectors.select(length, every(columns).alias("c"), deal(rows).alias("r"), F.lit(False).alias("asks"), "vec_id", "v", "copies")

    def block(part: pd.DataFrame) -> pd.DataFrame:
        asks = part["asks"].to_numpy(bool)
        if not asks.any() or asks.all():
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        v, ids, copies = np.vstack(part["v"]).astype(np.float64), part["vec_id"].to_numpy(np.int64), part["copies"].to_numpy()
        each = np.repeat(np.flatnonzero(~asks), copies[~asks])
        return aggregate(ids[asks], v[asks], ids[each], v[each], k).drop(columns="tiers")

    found = left.unionByName(right).groupBy("length", "r", "c").applyInPandas(block, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def whole(embedding: Column, scale: int = 1024) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))


def usable(embedding: Column) -> Column:
    """Whether no component is null, NaN or infinite; false for a null or empty vector."""
    return (F.size(embedding) > 0) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all ``embeddings`` for every hundredth; see top_k."""
    table = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(usable(F.col("embedding")))
    vectors = table.select("vec_id", whole(F.col("embedding")).alias("v"))
    return top_k(vectors.filter("vec_id % 100 = 0"), vectors, 10)


QUERIES = {"op4_exact_top_k": op4_exact_top_k}
ORACLE_SQL = {
    "op4_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10"""
}
