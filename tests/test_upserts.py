"""Batches of document versions: goldens of chunk counts, replays, lost writes, failing detectors, odd rows."""

from __future__ import annotations

from marlstone.functions import chunking, models
from marlstone.streaming import upserts as U
from test_operators import LOREM

SCHEMA = "doc_id long, version int, collection string, title string, contents array<string>"


def put(spark, folder, batch, *rows):
    class Fragile:
        def detect(self, text):
            if "boom" in text:
                raise ValueError("no luck")
            return [("word", "dummy")] if "dummy" in text else []

    U.upsert_batch(spark.createDataFrame(list(rows), SCHEMA), batch, str(folder), models.HashingEmbedder(4), Fragile())
    made = U.changes(spark, str(folder)).filter(f"batch = {batch}").groupBy("action").count().collect()
    return {r["action"]: r["count"] for r in made}


def texts(spark, folder):
    return sorted((r["doc_id"], r["content"], r["collection"]) for r in U.current(U.changes(spark, str(folder))).collect())


def test_counts_of_versions(spark, tmp_path):
    long, short = chunking.split_text(LOREM[:244], 100, 20), chunking.split_text(LOREM[:151], 100, 20)
    assert put(spark, tmp_path, 0, (1, 1, "c", "t", ["dummy-content"])) == {"insert": 1}
    assert put(spark, tmp_path, 1, (2, 1, "c", "t", long)) == {"insert": 3}
    assert put(spark, tmp_path, 2, (2, 2, "c", "t", long)) == {}
    assert put(spark, tmp_path, 3, (2, 3, "c", "t", short)) == {"insert": 1, "delete": 2}
    assert put(spark, tmp_path, 4, (2, 4, "c", "t", long)) == {"insert": 2, "delete": 1}
    assert put(spark, tmp_path, 5, (2, 5, "d", "t", long)) == {"update": 3}
    assert texts(spark, tmp_path) == sorted([(1, "dummy-content", "c"), *((2, x, "d") for x in long)])
    vectors = {r["content"]: r["embedding"] for r in U.current(U.changes(spark, str(tmp_path))).collect()}
    assert vectors[long[0]] == models.HashingEmbedder(4).embed([long[0]])[0].tolist()


def test_replays(spark, tmp_path):
    """A batch that comes again, also over a half-written one, changes nothing, and later ones do not count for it."""
    a, b = (1, 1, "c", "t", ["x", "x", "y"]), (1, 2, "c", "t", ["x", "z"])
    first, second = put(spark, tmp_path, 0, a), put(spark, tmp_path, 1, b)
    assert (first, second) == ({"insert": 3}, {"insert": 1, "delete": 2})
    before = texts(spark, tmp_path), U.callbacks(spark, str(tmp_path)).count()
    assert put(spark, tmp_path, 1, b) == second and put(spark, tmp_path, 0, a) == first
    assert before == (texts(spark, tmp_path), U.callbacks(spark, str(tmp_path)).count())


def test_detections_never_fail_a_batch(spark, tmp_path):
    put(spark, tmp_path, 0, (1, 1, "c", "t", ["dummy", "boom", "plain"]))
    put(spark, tmp_path, 1, (1, 2, "c", "u", ["dummy", "boom", "plain", "dummy two"]))
    got = sorted((r["batch"], r["error"] or "", len(r["items"])) for r in U.callbacks(spark, str(tmp_path)).collect())
    assert got == [(0, "", 1), (0, "ValueError: no luck", 0), (1, "", 1)]  # only what was inserted


def test_odd_documents(spark, tmp_path):
    assert put(spark, tmp_path, 0) == {}
    assert put(spark, tmp_path, 1, (None, 1, "c", "t", ["x"]), (1, 1, None, None, ["a", None, ""]), (1, 1, None, None, ["a"]), (2, 1, "c", "t", ["old"]), (2, 3, "c", "t", ["new"]), (2, 2, "c", "t", ["mid"])) == {"insert": 3}
    assert put(spark, tmp_path, 2, (1, 2, None, None, None), (3, 1, "c", "t", [])) == {"delete": 2}
    assert texts(spark, tmp_path) == [(2, "new", "c")]
