"""Quotas and a cache as keyed state: one run and a restart against folds, expiry, late charges, eviction."""

from __future__ import annotations

import random

import pandas as pd
import pytest

from marlstone.streaming import quotas

ASKS = "user_id long, event_id long, ms long, kind string, message_id long, tokens double, last_chunk boolean"
LOOKS = "key string, event_id long, ms long, item string, value string, forgets boolean"


@pytest.fixture
def stream(spark, tmp_path):
    """Runs a stream over batches of rows, each a run of its own from the same checkpoint, with the last one offered twice."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", quotas.STORE)

    def run(batches, schema, made):
        for k, rows in enumerate([*batches, None]):
            if rows is not None:
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            source = made(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
            source.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out").collect()

    yield run
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_quota_with_a_restart(stream):
    rng, rows, n = random.Random(2), [], 0
    for ms in sorted(rng.randrange(0, 9000) for _ in range(150)):
        user, n = rng.randrange(3), n + 3
        rows += [(user, n, ms, "ask", n, None, None), (user, n + 1, ms, "chunk", n, None, False), (user, n + 2, ms + rng.choice([0, 0, 700]), "chunk", n, rng.choice([None, 0.5, 2.0, 4.0]), True)]
    rows.sort(key=lambda r: (r[2], r[1]))
    rows += [r for r in rows if r[6]][5:8]  # chunks that come again
    want, records = {}, {}
    half = len(rows) // 2
    for part in (rows[:half], rows[half:]):
        for user, event_id, ms, kind, message, tokens, last in sorted(part, key=lambda r: (r[2], r[1])):
            until, left, settled = records.get(user, (-1, 7.0, set()))
            if kind == "ask":
                if ms > until:
                    until, left, settled = (ms // 1000 + 1) * 1000, 7.0, set()
                    want[event_id] = (True, left)
                else:
                    want[event_id] = (left >= 1, left)
                    settled = settled | ({message} if left < 1 else set())
            elif last and ms <= until and message not in settled:
                left, settled = left - (tokens or 0.0), settled | {message}
            records[user] = (until, left, settled)
    got = stream([rows[:half], rows[half:]], ASKS, lambda s: quotas.charged_requests(s, 7.0, 1000, late="1 hour"))
    asks = [r for r in got if r["kind"] == "ask"]
    assert len(asks) == len(want) and {r["event_id"]: (r["admitted"], r["balance"]) for r in asks} == want
    assert any(not a for a, _ in want.values()) and all(r["admitted"] is None for r in got if r["kind"] == "chunk")


def test_records_end_with_the_watermark(stream):
    """What is far past gets a fresh record, its old one gone by the timer."""
    rows = lambda *x: [(1, i, ms, "ask", i, None, None) for i, ms in x] + [(1, i + 1, ms, "chunk", i, 9.0, True) for i, ms in x]
    got = stream([rows((10, 100)), rows((20, 500_000)), rows((30, 900_000)), [(None, 1, 1, "ask", 1, None, None), (2, 3, None, "ask", 1, None, None)]], ASKS, lambda s: quotas.charged_requests(s, 7.0, 1000, late="1 second"))
    assert sorted((r["event_id"], r["admitted"], r["balance"]) for r in got if r["kind"] == "ask") == [(10, True, 7.0), (20, True, 7.0), (30, True, 7.0)]
    assert sorted(r["balance"] for r in got if r["kind"] == "chunk") == [-2.0] * 3


def test_cache(stream):
    first = [("u", 1, 0, "a", "1", None), ("u", 2, 10, "a", "2", None), ("u", 3, 100, "a", "3", False), ("u", 4, 101, "b", None, None), ("u", 5, 102, "b", "5", None), ("v", 6, 10, "a", "6", None), (None, 7, 1, "a", "7", None)]
    second = [("u", 8, 103, "b", "8", True), ("u", 9, 104, "b", "9", None), ("u", 10, 105, "c", "10", None), ("u", 11, 106, "d", "11", None), ("u", 12, 107, "a", "12", None)]
    first, second = ([(k, i, ms + 1000, *rest) for k, i, ms, *rest in part] for part in (first, second))  # the epoch itself counts as late
    got = stream([first, second], LOOKS, lambda s: quotas.cached(s, ttl_ms=100, most=3, late="1 hour"))
    want = {1: ("1", False), 2: ("1", True), 3: ("3", False), 4: (None, False), 5: (None, True), 6: ("6", False), 9: ("9", False), 10: ("10", False), 11: ("11", False), 12: ("12", False)}  # d drives a out
    assert {r["event_id"]: (r["value"], r["hit"]) for r in got} == want and len(got) == len(want)


class _Counted:
    """A state or handle that holds nothing and notes what is asked of it."""

    def __init__(self, calls: list[str]):
        self.calls = calls

    def __getattr__(self, name):
        if name.startswith("get") and name.endswith("State"):
            return lambda *a: _Counted(self.calls)
        return lambda *a: self.calls.append(name)


@pytest.mark.parametrize("made", [quotas.Quota(1e9), quotas.Cache(100, 10)])
def test_state_is_not_asked_for_each_row(made):
    calls = []
    made.init(_Counted(calls))
    n = range(200)
    rows = {"event_id": n, "ms": n, "kind": "chunk", "asks": False, "message_id": n, "tokens": 1.0, "next_ms": 1000, "item": "a", "value": "v", "forgets": [i % 2 == 0 for i in n]}
    rows = pd.DataFrame(rows)
    rows.loc[0, ["kind", "asks"]] = ["ask", True]
    assert sum(map(len, made.handleInputRows((1,), iter([rows]), None))) in (100, 200)
    assert len(calls) < 10
