"""Reconciling a source listing with stored states, and content-diff upserts of chunks and images.

Stores are immutable snapshots: an operator returns the actions to take or the next snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import reader, rebase

MAX_RETRY = 3
LINK_REFRESH_MS = 12 * 3600 * 1000


def modified(state_ms: Column, source_ms: Column) -> Column:
    """A missing time counts as modified."""
    return F.coalesce(state_ms != source_ms, F.lit(True))


def link_expired(upserted_ms: Column, as_of_ms: int, refresh_ms: int = LINK_REFRESH_MS) -> Column:
    return F.coalesce(F.lit(as_of_ms) - upserted_ms > refresh_ms, F.lit(True))


def needs_upsert(kind: Column, known: Column, state_ms: Column, source_ms: Column, upserted_ms: Column, state_url: Column, url: Column, status: Column, retry: Column, as_of_ms: int, max_retry: int = MAX_RETRY) -> Column:
    """Whether a listed file is to be upserted: it has no state or time; a link changed or is due; an image's address changed; else it changed, or did not succeed and may be tried again."""
    changed = modified(state_ms, source_ms)
    again = (F.coalesce(status, F.lit("successful")) != "successful") & (F.coalesce(retry, F.lit(0)) < max_retry)
    return (
        F.when(known.isNull() | state_ms.isNull(), True)
        .when(kind == "link", changed | link_expired(upserted_ms, as_of_ms))
        .when((kind == "image") & (state_url != url), True)
        .otherwise(changed | again)
    )


def plan(listing: DataFrame, states: DataFrame, as_of_ms: int, max_retry: int = MAX_RETRY) -> DataFrame:
    """One row for each file of either side with its action: upsert, none, unsupported or remove.

    listing: id, name, web_url, modified_ms. states: id, web_url, modified_ms, upserted_ms, status, retry."""
    s = states.select("id", F.lit(True).alias("known"), F.col("web_url").alias("s_url"), F.col("modified_ms").alias("s_ms"), "upserted_ms", F.coalesce("status", F.lit("successful")).alias("status"), F.coalesce("retry", F.lit(0)).alias("retry"))
    both = listing.join(s, "id", "full_outer").withColumn("kind", reader(F.col("name")))
    upsert = needs_upsert(F.col("kind"), F.col("known"), F.col("s_ms"), F.col("modified_ms"), F.col("upserted_ms"), F.col("s_url"), F.col("web_url"), F.col("status"), F.col("retry"), as_of_ms, max_retry)
    action = F.when(F.col("name").isNull(), "remove").when(F.col("kind").isNull(), "unsupported").when(upsert, "upsert").otherwise("none")
    return both.select("id", "kind", action.alias("action"))


def failure_retry(known: Column, changed: Column, retry: Column) -> Column:
    """The retry count after a failure: from 0 for new or modified files, else one more."""
    return F.when(known.isNull() | changed, 0).otherwise(F.coalesce(retry, F.lit(0)) + 1)


def folder_status(folders: DataFrame, states: DataFrame) -> DataFrame:
    """failed if any file of the folder is, else successful; an empty folder is successful."""
    failed = states.groupBy("parent_id").agg(F.bool_or(F.coalesce("status", F.lit("successful")) == "failed").alias("failed"))
    return folders.join(failed, "parent_id", "left").select("parent_id", F.when(F.coalesce("failed", F.lit(False)), "failed").otherwise("successful").alias("status"))


def chunk_diff(new: DataFrame, indexed: DataFrame) -> DataFrame:
    """Actions on chunks by (doc_id, content): insert, delete, update (same content, other place) or keep. Repeats of a
    content in a document are told apart by their number. Both sides: doc_id, content, collection, title."""
    def numbered(rows: DataFrame, side: str) -> DataFrame:
        w = Window.partitionBy("doc_id", "content_key").orderBy("collection", "title")
        keyed = rows.withColumn("content_key", F.sha2("content", 256)).withColumn("nth", F.row_number().over(w))
        return keyed.select("doc_id", "content_key", "nth", *[F.col(c).alias(f"{side}_{c}") for c in ("collection", "title")], F.lit(True).alias(f"{side}_here"))

    both = numbered(new, "new").join(numbered(indexed, "old"), ["doc_id", "content_key", "nth"], "full_outer")
    same = F.col("new_collection").eqNullSafe(F.col("old_collection")) & F.col("new_title").eqNullSafe(F.col("old_title"))
    action = F.when(F.col("old_here").isNull(), "insert").when(F.col("new_here").isNull(), "delete").when(same, "keep").otherwise("update")
    return both.select("doc_id", "content_key", "nth", action.alias("action"))


def image_diff(new: DataFrame, indexed: DataFrame) -> DataFrame:
    """Actions on page images by (doc_id, page): insert, delete, update where the address changed, or keep."""
    both = new.select("doc_id", "page", F.col("web_url").alias("n")).join(indexed.select("doc_id", "page", F.col("web_url").alias("o")), ["doc_id", "page"], "full_outer")
    action = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "delete").when(F.col("n") != F.col("o"), "update").otherwise("keep")
    return both.select("doc_id", "page", action.alias("action"))


def without(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The next snapshot when the rows of ``keys`` are deleted."""
    return rows.join(keys.select(on).distinct(), on, "left_anti")


def without_folder(states: DataFrame, folder: str) -> DataFrame:
    """The next snapshot when a folder's own state is deleted: the row of that id that has no parent. A file's state of the same id stays."""
    return states.filter(~F.coalesce((F.col("id") == folder) & F.col("parent_id").isNull(), F.lit(False)))


def renamed(rows: DataFrame, collection: str, to: str, folder_url: str) -> DataFrame:
    """The next snapshot when a collection and its folder are renamed."""
    own = F.col("collection") == collection
    return rows.withColumn("web_url", F.when(own, rebase(F.col("web_url"), F.lit(folder_url))).otherwise(F.col("web_url"))).withColumn("collection", F.when(own, to).otherwise(F.col("collection")))


def latest(states: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """The next snapshot when ``updates`` overwrite rows of the same key."""
    return states.join(updates, key, "left_anti").unionByName(updates)
