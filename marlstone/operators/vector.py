"""Filtered exact vector search, hybrid scoring, what-if search and rank fusion.

Every ranking rounds its score before it is compared and breaks ties by id, so results do not depend on
partitioning. A single query vector is a literal of the plan; tables of query vectors are joined by blocks of candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 6


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, strict: bool = False) -> Column:
    """Cosine similarity in doubles; null for a null vector. A zero vector gives null too or, if ``strict``, fails the query."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    zero = F.raise_error(F.lit("cosine of a zero vector")).cast("double") if strict else F.lit(None).cast("double")
    return F.when(norm == 0, zero).otherwise(dot(a, b) / norm)


def _scored(rows: DataFrame, query: Sequence[float], vec: str, shift: float) -> DataFrame:
    norm = sum(float(x) ** 2 for x in query) ** 0.5
    own = dot(F.col(vec), vector(query)) / F.nullif(F.sqrt(dot(F.col(vec), F.col(vec))) * F.lit(norm), F.lit(0.0))
    return rows.withColumn("score", F.round(own + shift, DIGITS))


def filtered_top_k(rows: DataFrame, query: Sequence[float] | None, keep: Column, k: int, threshold: float, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Rows that meet ``keep`` and have a vector, with score = cosine + 1 at ``threshold`` or more, the k best.
    Without a query there are no rows."""
    if query is None:
        return rows.withColumn("score", F.lit(None).cast("double")).limit(0)
    found = _scored(rows.filter(keep & F.col(vec).isNotNull()), query, vec, 1.0)
    return found.filter(F.col("score") >= threshold).orderBy(F.desc("score"), key).limit(k)


def hybrid_top_k(rows: DataFrame, query: Sequence[float], required: Sequence[str], excluded: Sequence[int], n: int, clauses: int, vec: str = "embedding", key: str = "vec_id", knn: int = 100) -> DataFrame:
    """1000 for each clause that all rows with the required fields meet, and 100 times the kNN score (1 + cosine) / 2 for
    the ``knn`` nearest; excluded ids take part in neither."""
    has = rows.filter(~F.col(key).isin(list(excluded)))
    for field in [*required, vec]:
        has = has.filter(F.col(field).isNotNull())
    near = _scored(has, query, vec, 0.0).orderBy(F.desc("score"), key).limit(knn)
    base = F.lit(1000.0 * clauses)
    found = near.withColumn("score", F.round(base + 50.0 * (1.0 + F.col("score")), DIGITS))
    if n > knn:  # what meets the clauses but is not among the nearest has their score alone
        rest = has.join(near.select(key), key, "left_anti").orderBy(key).limit(n - knn)
        found = found.unionByName(rest.withColumn("score", base))
    return found.orderBy(F.desc("score"), key).limit(n)


def first_by_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def preview(indexed: DataFrame, added: DataFrame, removed: DataFrame, query: Sequence[float], identity: Sequence[str], n: int, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """A search as if ``removed`` keys were gone and ``added`` rows were there; of equal identities an added row wins."""
    left = indexed.join(removed.select(key), key, "left_anti")
    both = added.withColumn("source", F.lit(0)).unionByName(left.withColumn("source", F.lit(1)))
    found = first_by_key(_scored(both, query, vec, 0.0), identity, [F.asc("source"), F.asc(key)])
    return found.orderBy(F.desc("score"), "source", key).limit(n)


def ranked(rows: DataFrame, score: str = "score", key: str = "vec_id") -> DataFrame:
    """``rank`` from 1 by score; for result lists of a set size."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))


def reciprocal_rank_fusion(text: DataFrame, image: DataFrame, key: str = "vec_id", constant: int = 60) -> DataFrame:
    """Sum over both lists of 1 / (constant + rank); a row in both is the text list's. ``text`` and ``image`` have ``rank``."""
    both = text.withColumn("list", F.lit(0)).unionByName(image.withColumn("list", F.lit(1)))
    fused = both.groupBy(key).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("fused"), F.min(F.struct("list", "rank")).alias("_first"))
    return fused.select(key, "fused", F.col("_first.list").alias("from_list"), F.col("_first.rank").alias("first_rank")).orderBy(F.desc("fused"), "from_list", "first_rank")


def combined(text: DataFrame, image: DataFrame, key: str = "vec_id", constant: int = 60) -> DataFrame:
    """key and score of two result lists of a set size (key, score): fused by reciprocal ranks if both have rows, else the one that has, by its own score. The plan itself finds out
    which, by the lists among its rows."""
    one = lambda rows, k: ranked(rows, key=key).select(key, "score", "rank", F.lit(k).alias("list"))
    everything = Window.partitionBy(F.lit(0))  # two lists of a set size
    both = one(text, 0).unionByName(one(image, 1)).withColumn("_two", F.min("list").over(everything) != F.max("list").over(everything))
    score = F.round(F.sum(F.when(F.col("_two"), 1.0 / (constant + F.col("rank"))).otherwise(F.col("score"))), 9)
    fused = both.groupBy(key).agg(score.alias("score"), F.min(F.struct("list", "rank")).alias("_first"))
    return fused.orderBy(F.desc("score"), "_first", key).select(key, "score")


def searched(stores: dict[str | None, DataFrame], environment: str | None, search: Callable[[DataFrame], DataFrame], space: str | None = None) -> DataFrame:
    """A search in the store that the environment names. A store alone, under the name None, takes no environment but may be narrowed to a
    space; stores with environments are live and staging, and take no space."""
    if None in stores:
        rows = stores[None]
        return search(rows if space is None else rows.filter(F.col("space_id") == space))
    if environment not in ("live", "staging") or environment not in stores:
        raise ValueError(f"no such environment: {environment}")
    if space is not None:
        raise ValueError("a store with environments has no spaces")
    return search(stores[environment])


def word_split(main: DataFrame, fragments: DataFrame, n: int, key: str = "vec_id", field: str = "text") -> DataFrame:
    """ceil(n/2) of the whole-query list and floor(n/2) of the fragments' lists, without fill-in. Fragment rows of one input
    field count once (the last fragment's); those that the main list has are left out."""
    once = first_by_key(fragments, [field], [F.desc("fragment"), F.desc("score"), F.asc(key)])
    other = once.join(main.select(field), field, "left_anti").orderBy(F.desc("score"), key).limit(n // 2)
    head = main.orderBy(F.desc("score"), key).limit(n - n // 2)
    return head.select(key, field, "score").unionByName(other.select(key, field, "score")).orderBy(F.desc("score"), key)


def modality(text: Column, image: Column) -> Column:
    """Which query vector a mixed query uses: the image's if there is one, else the text's, else none."""
    return F.when(image.isNotNull(), "image").when(text.isNotNull() & (F.trim(text) != ""), "text").otherwise("none")
