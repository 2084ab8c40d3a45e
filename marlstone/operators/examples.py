"""Few-shot example stores as snapshots: reads by keyset pages, validated writes, blue/green publishing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.models import Embedder, embedded

#: Fields that the store itself writes.
RESERVED = ("_id", "last_updated_time")


def by_ids(store: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows in the order of the request (column ``pos``); a missing id keeps its place with nulls."""
    return wanted.join(store, key, "left").orderBy("pos")


def page(store: DataFrame, ts: str, key: str, size: int, after: tuple[Column, Column] | None = None) -> DataFrame:
    """The next page by time, newest first, ties by id; vectors are left out."""
    rows = store.drop(*[c for c in store.columns if c.endswith("_embeddings")])
    if after is not None:
        t, k = after
        rows = rows.filter((F.col(ts) < t) | ((F.col(ts) == t) & (F.col(key) > k)))
    return rows.orderBy(F.desc(ts), key).limit(size)


def validated(rows: DataFrame, required: Sequence[str]) -> DataFrame:
    """``state``: missing where a required field is, reserved where a store's own field is set, else valid."""
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    reserved = F.lit(False)
    for c in RESERVED:
        if c in rows.columns:
            reserved = reserved | F.col(c).isNotNull()
    return rows.withColumn("state", F.when(missing, "missing").when(reserved, "reserved").otherwise("valid"))


def merged(store: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """The next snapshot after partial updates: a field that is not null overwrites."""
    new = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in updates.columns if c != key])
    fields = [F.coalesce(f"_new_{c}", c).alias(c) if c in updates.columns and c != key else F.col(c) for c in store.columns]
    return store.join(new, key, "left").select(*fields)


def created(rows: DataFrame, required: Sequence[str], inputs: Sequence[str], model: Embedder, now: str, key: str = "_id") -> DataFrame:
    """The store's rows of new examples: those that are valid, every given field as text, a vector for each input field, the time, and an id
    made from the fields. Rows that lack a field or set a reserved one are skipped."""
    fields = [c for c in rows.columns if c not in RESERVED]
    valid = validated(rows, required).filter("state = 'valid'").select(*[F.col(c).cast("string").alias(c) for c in fields])
    for c in inputs:
        valid = embedded(valid, c, f"{c}_embeddings", model)
    identity = F.sha2(F.to_json(F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in fields])), 256)
    return valid.withColumn("last_updated_time", F.lit(now).cast("timestamp")).withColumn(key, identity)


def updated(store: DataFrame, ids: Sequence, examples: Sequence[dict], key: str, strict: bool = True) -> DataFrame:
    """The next snapshot after updates given as ids and examples in the same order. If ``strict`` there must be as many of either, else the longer is cut."""
    if strict and len(ids) != len(examples):
        raise ValueError(f"{len(ids)} ids for {len(examples)} examples")
    pairs = list(zip(ids, examples, strict=False))
    fields = [f for f in store.schema.fields if f.name == key or any(f.name in e for _, e in pairs)]
    made = [tuple(i if f.name == key else e.get(f.name) for f in fields) for i, e in pairs]
    return merged(store, store.sparkSession.createDataFrame(made, StructType(fields)), key)


def published(pointers: DataFrame) -> DataFrame:
    """The pointer table after a publish: live is what was inactive, inactive the old live, staging as it was; live
    takes the staging model. pointers: role, index, model, with one row a role; of several staging rows the smallest model counts."""
    role = F.when(F.col("role") == "live", "inactive").when(F.col("role") == "inactive", "live").otherwise(F.col("role"))
    staging = pointers.filter("role = 'staging'").agg(F.min("model").alias("_model")).withColumn("role", F.lit("live"))
    turned = pointers.withColumn("role", role).join(F.broadcast(staging), "role", "left")  # a row
    return turned.select("role", "index", F.coalesce("_model", "model").alias("model"))


def copied(pages: DataFrame, pointers: DataFrame) -> DataFrame:
    """Every index's rows after a publish has copied staging's: the inactive index holds them and nothing else, the others are as they were.

    pages: index and an example's columns. pointers: role, index."""
    at = lambda role: F.broadcast(pointers.filter(F.col("role") == role).select("index"))  # noqa: E731  a row
    staging = pages.join(at("staging"), "index", "left_semi").drop("index")
    into = pointers.filter("role = 'inactive'").agg(F.min("index").alias("index")).withColumn("_on", F.lit(1))
    copy = staging.withColumn("_on", F.lit(1)).join(F.broadcast(into), "_on").drop("_on")
    return pages.join(at("inactive"), "index", "left_anti").unionByName(copy)


def zipped(left: DataFrame, right: DataFrame, index: str = "index") -> DataFrame:
    """Rows of either side with the same place; a place that only one side has is left out."""
    return left.join(right, index)


def bulk_outcome(items: DataFrame, batch: str, status: str = "status") -> DataFrame:
    """Of each bulk call its items, how many failed (a status of 300 or over), the first error, and whether the call raises."""
    bad = F.col(status) >= 300
    return items.groupBy(batch).agg(
        F.count("*").alias("items"), F.count_if(bad).alias("failed"),
        F.min_by(F.when(bad, F.col("error")), F.when(bad, F.col("item"))).alias("first_error"), F.coalesce(F.bool_or(bad), F.lit(False)).alias("raises"),
    )


#: Statuses of the store and the model by kind of error; others are internal.
ERRORS = {400: "invalid argument", 401: "authentication", 403: "authorization", 404: "not found", 409: "conflict", 429: "rate limit"}


def error_kind(status: Column) -> Column:
    """The kind of error that a status stands for; null for a success."""
    named = F.create_map(*[x for k, v in ERRORS.items() for x in (F.lit(k), F.lit(v))])
    return F.when(status >= 300, F.coalesce(F.try_element_at(named, status.cast("int")), F.lit("internal")))
