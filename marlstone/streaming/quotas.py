"""Quotas and a cache as keyed state that expires: requests are admitted by a user's record, and the last chunk of an answer charges it."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.quota import ticked

OUT = "user_id long, event_id long, ms long, kind string, admitted boolean, balance double"


class Quota(StatefulProcessor):
    """A user's record (until, balance), and which answers were charged to it or belong to rejected requests. Both go at the record's end, by a timer of event time.

    State is read once and written once for all rows of a user in a micro-batch, as each access goes from the worker to the executor and back."""

    def __init__(self, limit: float):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._record = handle.getValueState("record", "until long, balance double")
        self._settled = handle.getListState("settled", "message_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """The outcome of each request or last chunk. A request past the record's end gets a new record, whatever it holds; else it needs a balance of 1. A charge is taken from the record
        that is there, once for each answer and not for those to rejected requests; after the record's end there is none to take it from."""
        part = pd.concat(list(rows)).sort_values(["ms", "event_id"])
        had = self._record.get()  # None where there is none
        until, left = (had[0], had[1]) if had else (None, self.limit)
        settled, added = {x[0] for x in self._settled.get()} if had else set(), []
        started, admits, balances = False, [], []
        for ms, ask, message, tokens, next_ms in zip(*(part[c].tolist() for c in ("ms", "asks", "message_id", "tokens", "next_ms")), strict=True):
            past = until is None or ms > until
            if ask:
                if past:
                    until, left, started, settled, added = next_ms, self.limit, True, set(), []
                admitted = past or round(left, 6) >= 1
                if not admitted and message not in settled:
                    settled.add(message)
                    added.append((message,))
                admits.append(admitted)
                balances.append(left)
            else:
                if not past and message not in settled:
                    left -= tokens
                    settled.add(message)
                    added.append((message,))
                admits.append(None)
                balances.append(left)
        self._keep(had, until, left, started, added)
        yield pd.DataFrame({"user_id": key[0], "event_id": part["event_id"].to_numpy(), "ms": part["ms"].to_numpy(), "kind": part["kind"].to_numpy(), "admitted": pd.array(admits, dtype="boolean"), "balance": balances})

    def _keep(self, had: tuple | None, until: int | None, left: float, started: bool, added: list[tuple[int]]) -> None:
        if started:
            if had:
                for at in list(self._handle.listTimers()):
                    self._handle.deleteTimer(at)
            self._handle.registerTimer(until + 1)  # the end itself still belongs to the record
        if until is not None and (started or (had[0], had[1]) != (until, left)):
            self._record.update((until, left))
        if started and (added or had):
            self._settled.put(added) if added else self._settled.clear()
        elif added:
            self._settled.appendList(added)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        had = self._record.get()
        if had and had[0] < expiredTimerInfo.getExpiryTimeInMs():
            self._record.clear()
            self._settled.clear()
        return iter(())


def charged_requests(events: DataFrame, limit: float, window: str | int, late: str = "1 minute") -> DataFrame:
    """A row for each request and each last chunk of a stream of user_id, event_id, ms, kind ('ask' or 'chunk'), message_id, tokens and last_chunk: whether a request is admitted (null for a
    charge), and the balance, before a request and after a charge.

    window: as of ``quota.ticked``. Chunks other than an answer's last, and rows without a user, time or kind, are left out; null tokens cost nothing. Records end with the
    watermark, ``late`` behind the latest event, so that state is held only for users whose window is open. Rows of a user are taken in order of time within a micro-batch, whose size the
    source's options bound. The session's state store must be ``STORE``."""
    wanted = events.filter("user_id IS NOT NULL AND ms IS NOT NULL AND (kind = 'ask' OR kind = 'chunk' AND last_chunk)")
    timed = ticked(wanted, "ms", window).filter("next_ms IS NOT NULL").withColumn("at", F.timestamp_millis("ms")).withWatermark("at", late)
    rows = timed.select("user_id", "event_id", "ms", "at", "kind", (F.col("kind") == "ask").alias("asks"), F.coalesce("message_id", F.lit(-1)).alias("message_id"), F.coalesce(F.col("tokens").cast("double"), F.lit(0.0)).alias("tokens"), "next_ms")
    return rows.groupBy("user_id").transformWithStateInPandas(Quota(limit), OUT, "append", "eventTime")


class Cache(StatefulProcessor):
    """The last answer of each item of a key; it lives ``ttl_ms`` from when it was looked up, and the oldest goes when there are more than ``most``.

    A key's items, ``most`` of them at most, are read once and what has changed is written once for all its rows in a micro-batch. The key's one timer is that of its oldest item."""

    def __init__(self, ttl_ms: int, most: int):
        self.ttl_ms, self.most = ttl_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._held = handle.getMapState("held", "item string", "value string, made long")
        self._timer = handle.getValueState("timer", "at long")
        self._handle = handle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values(["ms", "event_id"])
        before = self._all() if self._timer.get() else {}
        held, ages = dict(before), [(made, item) for item, (_, made) in before.items()]
        heapify(ages)
        out = []
        for event_id, ms, item, value, forgets in zip(*(part[c].tolist() for c in ("event_id", "ms", "item", "value", "forgets")), strict=True):
            has = held.get(item)
            if forgets:
                held.pop(item, None)
                continue
            hit = has is not None and ms < has[1] + self.ttl_ms
            if not hit:
                held[item] = (value, ms)
                heappush(ages, (ms, item))
                while len(held) > self.most:
                    made, oldest = heappop(ages)
                    if oldest in held and held[oldest][1] == made:  # else it went, or was looked up anew
                        del held[oldest]
            out.append((event_id, item, has[0] if hit else value, hit))
        self._write(before, held)
        yield pd.DataFrame({"key": pd.Series([key[0]] * len(out), dtype=object), **{c: pd.Series([r[k] for r in out], dtype=kind) for k, (c, kind) in enumerate((("event_id", "int64"), ("item", object), ("value", object), ("hit", bool)))}})

    def _all(self) -> dict[str, tuple[str | None, int]]:
        return {k[0]: (v[0], v[1]) for k, v in self._held.iterator()}

    def _write(self, before: dict[str, tuple], after: dict[str, tuple]) -> None:
        for item in before.keys() - after.keys():
            self._held.removeKey((item,))
        for item, x in after.items():
            if before.get(item) != x:
                self._held.updateValue((item,), x)
        at, had = min((made for _, made in after.values()), default=None), self._timer.get()
        if at is None:
            self._timer.clear()
        elif had is None or had[0] != at + self.ttl_ms:
            self._timer.update((at + self.ttl_ms,))
        if had and (at is None or had[0] != at + self.ttl_ms):
            self._handle.deleteTimer(had[0])
        if at is not None and (had is None or had[0] != at + self.ttl_ms):
            self._handle.registerTimer(at + self.ttl_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        before = self._all()
        self._write(before, {item: x for item, x in before.items() if x[1] + self.ttl_ms > at})
        return iter(())


def cached(lookups: DataFrame, ttl_ms: int = 600_000, most: int = 2_000, late: str = "1 minute") -> DataFrame:
    """key, event_id, item, value and ``hit`` for a stream of look-ups (key, event_id, ms, item, value: what the source says now; forgets): what a cache of the key
    answers, from an earlier look-up of the item that is younger than ``ttl_ms`` if there is one, else the source's value, which it keeps. A row that forgets takes its item out of
    the cache and has no answer. No key holds over ``most`` items. Rows without a key, item or time are left out; the session's state store must be ``STORE``."""
    timed = lookups.filter("key IS NOT NULL AND item IS NOT NULL AND ms IS NOT NULL").withColumn("at", F.timestamp_millis("ms")).withWatermark("at", late)
    return timed.select("key", "event_id", "ms", "at", "item", "value", F.coalesce("forgets", F.lit(False)).alias("forgets")).groupBy("key").transformWithStateInPandas(
        Cache(ttl_ms, most), "key string, event_id long, item string, value string, hit boolean", "append", "eventTime"
    )


#: The state store that such state needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
