"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, shared_folder

__all__ = ["configured", "cut", "fold_of", "labelled_sample", "read_table", "shared_folder", "text_of"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column, folds: int) -> Column:
    """The row's fold: crc32 of the id's decimal text, modulo ``folds`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


#: Bytes of a batch of rows on its way to a Python worker.
BATCH_BYTES = 4 << 20


def text_of(df: DataFrame) -> Column:
    return F.coalesce(df["text"], F.lit(""))


def configured(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A registered query or a stage of the pipeline. Its session hands rows to Python workers ``BATCH_BYTES`` at a time, so that long texts don't
    add up, unless it has a size of its own. Operators leave the session as it is."""

    @wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        key = "spark.sql.execution.arrow.maxBytesPerBatch"
        spark.conf.set(key, spark.conf.get(key, str(BATCH_BYTES)))
        return query(spark, *args)

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out_fold: int, max_rows: int) -> DataFrame:
    """At most about ``max_rows`` labelled texts outside the held-out fold: doc_id, text, label (0 or 1); of equal texts, the one with the
    smallest id.

    Rows are kept by a hash of the id against a threshold set from the number of labelled rows, so
    the choice does not depend on partitioning. The kept labels are bounded and go to the executors
    as a broadcast side; of the other documents no text is shuffled. Labels other than 0 and 1 are left out; an id with
    both counts as 1.
    """
    usable = (
        labels.select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("label_id").isNotNull() & (fold_of(F.col("label_id"), folds) != held_out_fold))
        .groupBy("label_id").agg(F.max("label").alias("label"))
    )
    share = max_rows / max(1, usable.count())
    if share < 1:
        usable = usable.filter(F.pmod(F.xxhash64(F.lit("sample"), "label_id"), F.lit(1_000_003)) < int(share * 1_000_003))
    texts = docs.select(F.col("doc_id").alias("label_id"), text_of(docs).alias("text")).join(F.broadcast(usable), "label_id")
    return texts.groupBy("text").agg(F.min(F.struct("label_id", "label")).alias("first")).select(F.col("first.label_id").alias("doc_id"), "text", F.col("first.label").alias("label"))
