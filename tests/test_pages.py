"""A listing in pages: each item once, as a table and as a stream; lost pages are asked again."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marlstone.sources import pages as P


def items(spark, n, folders=3):
    return spark.range(n).select(F.concat(F.lit("f"), F.col("id") % folders).alias("folder"), F.lpad(F.col("id").cast("string"), 5, "0").alias("id"), F.lit("n").alias("name"), F.lit("u").alias("web_url"), F.col("id").alias("modified_ms"), F.when(F.col("id") % 5 == 0, 1).cast("int").alias("child_count"))


def test_every_item_once(spark, tmp_path):
    wanted = items(spark, 100)
    P.write_pages(wanted, f"{tmp_path}/p", 7)
    found = P.listed(spark, f"file://{tmp_path}/p")
    assert found.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    assert P.folders_of(found).count() == 20 and P.files_of(found).count() == 80
    assert P.listed(spark, f"{tmp_path}/p").count() == 100


def test_lost_pages():
    class Lossy:
        def __init__(self, lost):
            self.lost, self.asked = dict(lost), []

        def page(self, folder, token):
            self.asked.append(token)
            if self.lost.get(token, 0):
                self.lost[token] -= 1
                raise OSError("lost")
            return [{"id": token}], {"": "b", "b": "c"}.get(token)

    client = Lossy({"b": 2})
    assert [i[0]["id"] for i, _ in P.pages_of(client, "f", "", 3, 0)] == ["", "b", "c"] and client.asked == ["", "b", "b", "b", "c"]
    with pytest.raises(OSError):
        list(P.pages_of(Lossy({"b": 3}), "f", "", 3, 0))


def test_stream_takes_what_is_new(spark, tmp_path):
    """Pages that come later are in the next run, a whole one being full; nothing comes twice."""
    def run():
        P.listed(spark, f"file://{tmp_path}/p", stream=True).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    ids = lambda df: sorted(r["id"] for r in df.collect())
    first = items(spark, 28, folders=2).filter("folder = 'f0'")
    P.write_pages(first, f"{tmp_path}/p", 7)
    assert run() == ids(first)
    second = items(spark, 40, folders=2)  # a folder more
    P.write_pages(second.filter("folder = 'f1'"), f"{tmp_path}/p", 7, mode="append")
    assert run() == ids(first.unionByName(second.filter("folder = 'f1'"))) == run()
