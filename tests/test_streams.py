"""Streams over tables that end, against plain batch results."""

from __future__ import annotations

import time

import pytest
from compare import SF, rows_of_spark
from pyspark.sql import functions as F

from marlstone.plans import extras
from marlstone.streaming import operators as streams


def test_daily_counts_have_the_last_day(spark):
    want = spark.read.parquet(f"{SF}/events.parquet").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert rows_of_spark(extras.ext_daily_counts(spark, SF)) == rows_of_spark(want)


@pytest.mark.parametrize("tail", ["1 <", "a <think", "<think>so </thin"])
def test_a_message_that_ends_like_a_tag(spark, tmp_path, tail):
    schema = "message_id long, nth long, delta string, last_chunk boolean"
    parts = [tail[i : i + 3] for i in range(0, len(tail), 3)]
    spark.createDataFrame([(1, k, d, k == len(parts) - 1) for k, d in enumerate(parts)], schema).write.parquet(str(tmp_path / "in"))
    made = streams.split_thoughts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = [r["text"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("nth").collect()]
    assert "".join(got) == tail.removeprefix("<think>")


def test_thoughts_of_whole_messages(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    want = rows.agg(F.sum(F.length("text"))).first()[0]
    assert extras.stream_think(spark, SF).filter("kind = 'answer'").agg(F.sum("n_chars")).first()[0] == want


def test_pages_of_whole_texts(spark):
    """Every chunk of every text has its pages, up to the last."""
    lengths = {r["doc_id"]: len(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if r["text"]}
    last = {}
    for r in extras.page_range(spark, SF).collect():
        assert r["start_page"] <= r["end_page"]
        last[r["doc_id"]] = max(last.get(r["doc_id"], 0), r["end_page"])
    for i, n in lengths.items():
        assert last[i] == -(-n // extras.PAGE)


def test_chunks_of_a_long_message(spark, tmp_path):
    """Cutting a message takes time by its length, not by the square of it."""
    spark.sql(f"SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, repeat('abcd é😀 ', {5_000}) AS text").write.parquet(f"{tmp_path}/conversations.parquet")
    began = time.monotonic()
    rows = extras._deltas(spark, str(tmp_path), F.col("text")).orderBy("nth").collect()
    assert time.monotonic() - began < 60
    assert "".join(r["delta"] for r in rows) == "<think>why user</think>" + "abcd é😀 " * 5_000
    assert [r["nth"] for r in rows if r["last_chunk"]] == [len(rows) - 1] and {len(r["delta"]) for r in rows[:-1]} == {5}


def test_messages_of_one_bucket(spark, tmp_path):
    """Messages that share a state are kept apart over micro-batches, one of a null id too."""
    schema = "message_id long, nth long, delta string, last_chunk boolean"
    for rows in ([(1, 0, "a<th", False), (2, 0, "<think>x", None), (None, 0, "n<", False)], [(1, 1, "ink>b", False), (2, 1, "y</think>z", True), (None, 1, "m", True)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        made = streams.split_thoughts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), buckets=1)
        made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["message_id"] or 0, r["nth"], r["kind"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(0, 0, "answer", "n"), (0, 1, "answer", "<m"), (1, 0, "answer", "a"), (1, 1, "thought", "b"), (2, 0, "thought", "x"), (2, 1, "answer", "z"), (2, 1, "thought", "y")]
