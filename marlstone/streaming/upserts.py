"""Content-diff upserts of a stream of documents, each micro-batch an idempotent set of changes.

The chunk table is a log of changes, a folder for each batch; the current chunks are the latest change of each place that is no deletion. A batch looks at earlier batches only and
overwrites its own folder, so a batch that comes again, or was lost half written, leaves the same changes.
"""

from __future__ import annotations

import re
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.models import Embedder, embedded
from ..operators.sync import chunk_diff

PLACE = ["doc_id", "content_key", "nth"]
CHANGES = "doc_id long, content_key string, nth int, action string, collection string, title string, content string, embedding array<float>, batch long"
FOUND = "array<struct<entity:string,text:string>>"
CALLBACKS = f"doc_id long, content_key string, nth int, items {FOUND}, error string, batch long"


class Detector(Protocol):
    def detect(self, text: str) -> list[tuple[str, str]]: ...


class PatternDetector:
    """Stand-in for a detector: what patterns match, in order of their names."""

    def __init__(self, patterns: dict[str, str]):
        self.patterns = patterns

    def detect(self, text: str) -> list[tuple[str, str]]:
        return [(name, m.group()) for name, p in sorted(self.patterns.items()) for m in re.finditer(p, text)]


def _log(spark: SparkSession, folder: str, name: str, schema: str, batches: int) -> DataFrame:
    """The rows of all batches before that number."""
    path = f"{folder}/{name}"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    # By the folders' numbers, so that a folder which is written anew is not read.
    return spark.read.schema(f"{schema}, part long").parquet(path).filter(F.col("part") < batches).drop("part")


def changes(spark: SparkSession, folder: str, batches: int = 2**62) -> DataFrame:
    return _log(spark, folder, "changes", CHANGES, batches)


def callbacks(spark: SparkSession, folder: str, batches: int = 2**62) -> DataFrame:
    """What was detected in inserted chunks: items, or the error that the detector ended in."""
    return _log(spark, folder, "callbacks", CALLBACKS, batches)


def current(log: DataFrame) -> DataFrame:
    """The chunks after all changes of a log."""
    last = Window.partitionBy(*PLACE).orderBy(F.desc("batch"))
    return log.withColumn("_nth", F.row_number().over(last)).filter("_nth = 1 AND action <> 'delete'").drop("_nth", "action")


def detections(inserted: DataFrame, detector: Detector) -> DataFrame:
    """A row for each inserted chunk in which something was found or at which the detector failed; a failure is a row, not an error of the batch."""

    @F.pandas_udf(f"items {FOUND}, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                out.append(([{"entity": e, "text": x} for e, x in detector.detect(t or "")], None))
            except Exception as e:  # whatever a detector raises
                out.append(([], f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["items", "error"])

    told = inserted.withColumn("_found", run("content")).select(*PLACE, "_found.items", "_found.error")
    return told.filter((F.size("items") > 0) | F.col("error").isNotNull())


def upsert_batch(documents: DataFrame, batch: int, folder: str, embedder: Embedder, detector: Detector) -> None:
    """Writes the changes of one batch of documents (doc_id, version, collection, title, contents: its chunks' texts) and its callbacks.

    Of several versions of a document in a batch the highest counts, of equal ones the last in order of the other columns. Null ids are left out, null contents are none, which
    deletes the document's chunks. Only inserts are embedded; a chunk whose content stays but not its collection or title is updated with the vector it has. A document without changes writes no row."""
    spark = documents.sparkSession
    order = Window.partitionBy("doc_id").orderBy(F.desc("version"), F.desc("collection"), F.desc("title"), F.desc("contents"))
    latest = documents.filter("doc_id IS NOT NULL").withColumn("_nth", F.row_number().over(order)).filter("_nth = 1")
    new = latest.select("doc_id", "collection", "title", F.explode("contents").alias("content")).filter("content IS NOT NULL")
    old = current(changes(spark, folder, batch)).join(latest.select("doc_id"), "doc_id", "left_semi")
    diff = chunk_diff(new, old.select("doc_id", "content", "collection", "title")).filter("action <> 'keep'")
    numbered = Window.partitionBy("doc_id", "content_key").orderBy("collection", "title")
    keyed = new.withColumn("content_key", F.sha2("content", 256)).withColumn("nth", F.row_number().over(numbered))
    acted = diff.filter("action <> 'delete'").join(keyed, PLACE)
    columns = [*PLACE, "action", "collection", "title", "content", "embedding"]
    inserted = embedded(acted.filter("action = 'insert'"), "content", "embedding", embedder).select(*columns)
    stays = acted.filter("action = 'update'").join(old.select(*PLACE, "embedding"), PLACE).select(*columns)
    gone = diff.filter("action = 'delete'").join(old.select(*PLACE, "collection", "title", "content", "embedding"), PLACE).select(*columns)
    number = F.lit(batch).cast("long").alias("batch")
    inserted.unionByName(stays).unionByName(gone).select("*", number).write.mode("overwrite").parquet(f"{folder}/changes/part={batch}")
    written = spark.read.schema(CHANGES).parquet(f"{folder}/changes/part={batch}").filter("action = 'insert'")
    detections(written, detector).select("*", number).write.mode("overwrite").parquet(f"{folder}/callbacks/part={batch}")


def upserts(documents: DataFrame, folder: str, checkpoint: str, embedder: Embedder, detector: Detector) -> DataStreamWriter:
    """The writer of a stream of documents; see upsert_batch."""
    return documents.writeStream.foreachBatch(lambda rows, batch: upsert_batch(rows, batch, folder, embedder, detector)).option("checkpointLocation", checkpoint)
