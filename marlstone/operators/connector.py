"""A source's synchronisation as one transaction: from its listing, what was read and the stored tables to all next tables and the result list, turned over at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.models import Embedder, embedded
from ..functions.text import reader, rebase
from .sync import MAX_RETRY, chunk_diff, failure_retry, modified, needs_upsert

STATE = ["id", "parent_id", "collection", "name", "web_url", "upserted_ms", "modified_ms", "status", "retry"]
CHUNK = ["doc_id", "parent_id", "collection", "title", "web_url", "content", "embedding"]


@dataclass
class Snapshot:
    """The next tables, and ``results``: action (no change, upserted, removed), id, collection, name."""

    chunks: DataFrame
    states: DataFrame
    folders: DataFrame
    results: DataFrame


def decided(folders: DataFrame, listing: DataFrame, states: DataFrame, as_of_ms: int, max_retry: int = MAX_RETRY) -> DataFrame:
    """A row for each file that a live folder lists or has a state of, with ``action``: remove, unsupported, unsupported unchanged, upsert or none; and the state's own columns
    as ``s_<column>``. A file that moved to another folder is removed there and new here."""
    live = folders.select(F.col("id").alias("parent_id"), F.col("name").alias("folder"))
    files = listing.join(live, "parent_id").withColumn("kind", reader(F.col("name")))
    held = states.join(live.select("parent_id"), "parent_id", "left_semi").select("id", "parent_id", F.lit(True).alias("known"), *[F.col(c).alias(f"s_{c}") for c in STATE if c not in ("id", "parent_id")])
    both = files.join(held, ["id", "parent_id"], "full_outer")
    changed = modified(F.col("s_modified_ms"), F.col("modified_ms"))
    upsert = needs_upsert(F.col("kind"), F.col("known"), F.col("s_modified_ms"), F.col("modified_ms"), F.col("s_upserted_ms"), F.col("s_web_url"), F.col("web_url"), F.col("s_status"), F.col("s_retry"), as_of_ms, max_retry)
    action = F.when(F.col("folder").isNull(), "remove").when(F.col("kind").isNull() & (F.col("known").isNull() | changed), "unsupported").when(F.col("kind").isNull(), "unsupported unchanged").when(upsert, "upsert").otherwise("none")
    return both.withColumn("changed", changed).withColumn("action", action)


def synced(folders: DataFrame, listing: DataFrame, read: DataFrame, folder_states: DataFrame, states: DataFrame, chunks: DataFrame, embedder: Embedder, as_of_ms: int, max_retry: int = MAX_RETRY) -> Snapshot:
    """The next snapshot and the results of a run.

    folders: id, name, web_url of the source's folders. listing: id, parent_id, name, web_url, modified_ms of its files, ids not null and unique in a folder. read: id, contents (an array of chunk
    texts; null where reading failed; a file to be upserted that has no row failed too). folder_states: id, name, web_url, status. states: ``STATE``. chunks: ``CHUNK``.

    A folder that is gone takes its chunks and states along; one whose name changed renames them. In live folders, files that are not listed any more lose state and chunks. Files to be upserted
    get their new chunks, of which only those with new contents are embedded; failed ones keep what they had and count a retry. Unsupported files are failed for good, and in no result. A
    folder has failed if one of its files has. A file listed without its folder is left out."""
    gone = folder_states.join(folders.select("id"), "id", "left_anti").select(F.col("id").alias("parent_id"), F.col("name").alias("gone"))
    all_files = decided(folders, listing, states, as_of_ms, max_retry)
    # Renamed folders: what is kept of them gets their name and address.
    renames = folders.join(folder_states.select("id", F.col("name").alias("old")), "id").filter("name IS NOT NULL AND name <> old").select(F.col("id").alias("parent_id"), F.col("name").alias("to"), F.col("web_url").alias("under"))

    def moved(rows: DataFrame) -> DataFrame:
        told = rows.join(F.broadcast(renames), "parent_id", "left")
        return told.withColumn("web_url", F.when(F.col("to").isNotNull(), rebase(F.col("web_url"), F.coalesce("under", F.lit("")))).otherwise(F.col("web_url"))).withColumn("collection", F.coalesce("to", "collection")).drop("to", "under")

    tried = all_files.filter("action = 'upsert'").join(read.select("id", "contents"), "id", "left")
    known_retry = F.coalesce("s_retry", F.lit(0))
    own = ["id", "parent_id", F.col("folder").alias("collection"), "name", "web_url", F.lit(as_of_ms).cast("long").alias("upserted_ms"), "modified_ms"]
    good = tried.filter("contents IS NOT NULL")
    put = (
        good.select(*own, F.lit("successful").alias("status"), F.lit(0).alias("retry"))
        .unionByName(tried.filter("contents IS NULL").select(*own, F.lit("failed").alias("status"), failure_retry(F.col("known"), F.col("changed"), known_retry).cast("int").alias("retry")))
        .unionByName(all_files.filter("action = 'unsupported'").select(*own, F.lit("failed").alias("status"), F.lit(max_retry).alias("retry")))
    )
    stays = all_files.filter("action IN ('none', 'unsupported unchanged')").select("id", "parent_id", *[F.col(f"s_{c}").alias(c) for c in STATE if c not in ("id", "parent_id")])
    next_states = put.unionByName(moved(stays).select(*STATE))

    removed = all_files.filter("action = 'remove'").select("id", F.col("s_collection").alias("collection"), F.col("s_name").alias("name"))
    lost = states.join(F.broadcast(gone), "parent_id").select("id", F.col("gone").alias("collection"), "name")
    listed = lambda what, name: all_files.filter(F.col("action") == what).select(F.lit(name).alias("action"), "id", F.col("folder").alias("collection"), "name")
    results = listed("none", "no change").unionByName(listed("upsert", "upserted")).unionByName(removed.unionByName(lost).select(F.lit("removed").alias("action"), "id", "collection", "name"))

    # Chunks: those of gone folders, of removed files and of upserted ones make place; the upserted files' new ones come in, with the vectors of equal contents.
    left = moved(chunks.join(gone.select("parent_id"), "parent_id", "left_anti").join(removed.select(F.col("id").alias("doc_id")), "doc_id", "left_anti"))
    fresh = good.select(F.col("id").alias("doc_id"), "parent_id", F.col("folder").alias("collection"), F.col("name").alias("title"), "web_url", F.explode("contents").alias("content"))
    kept = left.join(good.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")
    before = left.join(good.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    place = ["doc_id", "content_key", "nth"]
    keyed = lambda rows: rows.withColumn("content_key", F.sha2("content", 256)).withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "content_key").orderBy("collection", "title")))
    diff = chunk_diff(fresh.select("doc_id", "content", "collection", "title"), before.select("doc_id", "content", "collection", "title"))
    acted = keyed(fresh).join(diff, place)
    same = acted.filter("action <> 'insert'").join(keyed(before).select(*place, "embedding"), place)
    new = embedded(acted.filter("action = 'insert'"), "content", "embedding", embedder)
    next_chunks = kept.select(*CHUNK).unionByName(same.select(*CHUNK)).unionByName(new.select(*CHUNK))

    failed = next_states.groupBy(F.col("parent_id").alias("id")).agg(F.bool_or(F.col("status") == "failed").alias("_failed"))
    next_folders = folders.join(failed, "id", "left").select("id", "name", "web_url", F.when(F.coalesce("_failed", F.lit(False)), "failed").otherwise("successful").alias("status"))
    return Snapshot(next_chunks, next_states, next_folders, results)


def committed(snapshot: Snapshot, folder: str, version: int) -> None:
    """Writes a snapshot's tables as a version of the folder, then turns the pointer to it by one appended row. A run that is lost before that leaves the earlier version in
    place, and is done again under the same number."""
    spark = snapshot.states.sparkSession
    for name in ("chunks", "states", "folders", "results"):
        getattr(snapshot, name).write.mode("overwrite").parquet(f"{folder}/v{version}/{name}")
    spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").parquet(f"{folder}/pointer")


def current(spark: SparkSession, folder: str) -> Snapshot:
    """The tables of the version that the pointer names: the highest that was turned to."""
    version = spark.read.schema("version int").parquet(f"{folder}/pointer").agg(F.max("version").alias("v")).first()["v"]
    return Snapshot(*[spark.read.parquet(f"{folder}/v{version}/{name}") for name in ("chunks", "states", "folders", "results")])
