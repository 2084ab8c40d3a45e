"""A synchronisation by scenario, and its versions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marlstone.functions import models
from marlstone.operators import connector as C

NOW = 100 * 3_600_000
FOLDERS, LISTING, READ = "id string, name string, web_url string", "id string, parent_id string, name string, web_url string, modified_ms long", "id string, contents array<string>"
STATES = "id string, parent_id string, collection string, name string, web_url string, upserted_ms long, modified_ms long, status string, retry int"
CHUNKS = "doc_id string, parent_id string, collection string, title string, web_url string, content string, embedding array<float>"


def run(spark, folders=(("F", "docs", "u/docs"),), files=(), read=(), folder_states=(("F", "docs", "u/docs", "successful"),), states=(), chunks=()):
    df = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return C.synced(df(folders, FOLDERS), df(files, LISTING), df(read, READ), df(folder_states, FOLDERS + ", status string"), df(states, STATES), df(chunks, CHUNKS), models.HashingEmbedder(2), NOW)


def results(s):
    return sorted((r["action"], r["id"]) for r in s.results.collect())


STATE = ("f", "F", "docs", "a.md", "u/docs/a.md", NOW - 1000, 5, "successful", 0)
FILE = ("f", "F", "a.md", "u/docs/a.md", 5)
CHUNK = ("f", "F", "docs", "a.md", "u/docs/a.md", "one", [0.5, 0.5])


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ({"folders": (), "folder_states": ()}, []),
        ({"files": [FILE], "read": [("f", ["one"])]}, [("upserted", "f")]),
        ({"files": [FILE], "states": [STATE]}, [("no change", "f")]),
        ({"files": [(*FILE[:4], 1005)], "states": [STATE], "read": [("f", ["one"])]}, [("upserted", "f")]),
        ({"states": [STATE], "chunks": [CHUNK]}, [("removed", "f")]),
        ({"folders": (), "states": [STATE], "chunks": [CHUNK]}, [("removed", "f")]),
        ({"files": [("f", "F", "a.url", "u", 5)], "states": [(*STATE[:3], "a.url", "u", NOW - 11 * 3_600_000, 5, "successful", 0)]}, [("no change", "f")]),
        ({"files": [("f", "F", "a.url", "u", 5)], "states": [(*STATE[:3], "a.url", "u", NOW - 13 * 3_600_000, 5, "successful", 0)]}, [("upserted", "f")]),
        ({"files": [("f", "F", "b.md", "u/docs/b.md", 1005)], "states": [STATE], "read": [("f", ["one"])]}, [("upserted", "f")]),
        ({"files": [("x", "F", "x.zip", "u/docs/x.zip", 5)]}, []),
        ({"files": [FILE], "states": [("f", "G", *STATE[2:])], "folders": (("F", "docs", "u/docs"), ("G", "other", "u/other")), "read": [("f", ["one"])]}, [("removed", "f"), ("upserted", "f")]),
    ],
)
def test_scenarios(spark, given, want):
    assert results(run(spark, **given)) == want


def test_renamed_folder(spark):
    s = run(spark, folders=[("F", "new", "v/new")], files=[("f", "F", "a.md", "v/new/a.md", 5)], states=[STATE], chunks=[CHUNK])
    assert results(s) == [("no change", "f")]
    assert [(r["collection"], r["web_url"]) for r in s.states.collect()] == [("new", "v/new/a.md")] == [(r["collection"], r["web_url"]) for r in s.chunks.collect()]
    assert [tuple(r) for r in s.folders.collect()] == [("F", "new", "v/new", "successful")]


def test_failures_keep_what_was_there(spark):
    changed, same = (*FILE[:4], 1005), ("g", "F", "b.md", "u/docs/b.md", 5)
    s = run(spark, files=[changed, same, ("x", "F", "x.zip", "u", 5)], states=[(*STATE[:8], 2), ("g", *STATE[1:7], "failed", 1)], chunks=[CHUNK], read=[("f", None)])
    assert results(s) == [("upserted", "f"), ("upserted", "g")]
    assert sorted((r["id"], r["status"], r["retry"]) for r in s.states.collect()) == [("f", "failed", 0), ("g", "failed", 2), ("x", "failed", 3)]
    assert [r["content"] for r in s.chunks.collect()] == ["one"] and s.folders.first()["status"] == "failed"


def test_only_new_contents_are_embedded(spark):
    s = run(spark, files=[(*FILE[:4], 1005)], states=[STATE], chunks=[CHUNK, (*CHUNK[:5], "two", [0.5, 0.5]), (*CHUNK[:5], "two", [0.25, 0.25])], read=[("f", ["one", "one", "two", "three"])])
    assert sorted((r["content"], r["embedding"][0] in (0.5, 0.25)) for r in s.chunks.collect()) == [("one", False), ("one", True), ("three", False), ("two", True)]


def test_versions(spark, tmp_path):
    """A version that is not turned to, half written or whole, is not there; doing it again is safe."""
    folder = str(tmp_path)
    first = run(spark, files=[FILE], read=[("f", ["one"])])
    C.committed(first, folder, 1)
    before = C.current(spark, folder)
    second = C.synced(*[spark.createDataFrame([], x) for x in (FOLDERS, LISTING, READ)], before.folders, before.states, before.chunks, models.HashingEmbedder(2), NOW)
    second.chunks.write.parquet(f"{folder}/v2/chunks")  # a run that was lost
    assert [r["id"] for r in C.current(spark, folder).states.collect()] == ["f"]
    C.committed(second, folder, 2)
    C.committed(second, folder, 2)
    after = C.current(spark, folder)
    assert after.states.count() == after.chunks.count() == after.folders.count() == 0 and after.results.select("action").first()[0] == "removed"
    assert before.chunks.agg(F.count("*")).first()[0] == 1
