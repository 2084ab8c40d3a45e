"""Collections: what there is, and who may read it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def every_collection(chunks: DataFrame) -> DataFrame:
    """All groups of chunks with one collection name each."""
    return chunks.groupBy("parent_id").agg(F.count("*").alias("n_chunks"), F.min("collection").alias("collection"))


def collections(chunks: DataFrame, most: int = 1000) -> DataFrame:
    """The largest groups of chunks with one collection name each, ties to the smaller id: a page for listing."""
    return every_collection(chunks).orderBy(F.desc("n_chunks"), "parent_id").limit(most)


def granted(listed: DataFrame, grants: DataFrame) -> DataFrame:
    """Collections with the address that each of a user's grants gives."""
    return listed.join(grants, "parent_id").select("user_id", "parent_id", "collection", "web_url")


def accessible(listed: DataFrame, grants: DataFrame) -> DataFrame:
    """Collections that anyone may read."""
    return listed.join(grants, "parent_id", "left_semi")


def checked(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """Whether each requested (user, collection) is granted; refusals are answers too."""
    known = grants.select("user_id", "parent_id").distinct().withColumn("granted", F.lit(True))
    return requests.join(known, ["user_id", "parent_id"], "left").withColumn("granted", F.coalesce("granted", F.lit(False)))
