"""Structured Streaming forms: quotas and think-tag splitting with keyed state, assembly of token streams, log sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_limited(requests: DataFrame, limit: float, window_ms: int) -> DataFrame:
    """event_id, user_id, ms and admitted for a stream of event_id, user_id, ms, cost: a record lives to the first tick after it was made, that tick
    included; a new one starts with a full balance, a balance under 1 rejects, and each admitted cost is taken off. Rows of a user are
    taken in order of time within a batch."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        made, left = state.get if state.exists else (None, limit)
        rows = pd.concat(list(parts)).sort_values(["ms", "event_id"])
        out = []
        for event_id, ms, cost in zip(rows["event_id"], rows["ms"], rows["cost"], strict=True):
            if made is None or int(ms) > (made // window_ms + 1) * window_ms:
                made, left, admitted = int(ms), limit, True
            else:
                admitted = round(left, 6) >= 1
            if admitted:
                left -= float(cost)
            out.append((event_id, key[0], ms, admitted))
        state.update((made, left))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "ms", "admitted"])

    return requests.groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, ms long, admitted boolean", "made long, balance double", "append", GroupStateTimeout.NoTimeout)


#: Groups into which messages are dealt by hash, so that a micro-batch has a call and a state for each of these rather than for each message.
BUCKETS = 1_024


def _thoughts(held: str, inside: bool, delta: str) -> tuple[str, bool, list[tuple[bool, str]]]:
    """What waits, whether a tag is open, and the pieces of text (thought or not) after one more chunk."""
    if not held and "<" not in delta:
        return held, inside, [(inside, delta)] if delta else []
    out, held = [], held + delta
    while held:
        tag = "</think>" if inside else "<think>"
        at = held.find(tag)
        if at >= 0:
            text, held, turn = held[:at], held[at + len(tag) :], True
        else:
            keep = next((k for k in range(min(len(tag) - 1, len(held)), 0, -1) if tag.startswith(held[-k:])), 0)
            text, held, turn = held[: len(held) - keep], held[len(held) - keep :], False
        if text:
            out.append((inside, text))
        if not turn:
            break
        inside = not inside
    return held, inside, out


def split_thoughts(chunks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """message_id, nth, kind (thought or answer) and text for a stream of message_id, nth, delta. Text between think tags is
    thought, also where a tag is cut by a chunk's end: what may be the start of a tag waits for the next chunk, or until the
    message ends with a chunk whose last_chunk, if there is such a column, is true. A bucket's state has only the messages of which
    something waits or a tag is open."""
    ends = F.coalesce("last_chunk", F.lit(False)) if "last_chunk" in chunks.columns else F.lit(False)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else "[]"
        open_ = {m: (held, inside) for m, held, inside in json.loads(before)}
        rows = pd.concat(list(parts)).sort_values(["lost", "message_id", "nth", "delta", "ends"])
        ids, nths, kinds, texts = [], [], [], []
        for lost, message, nth, delta, last in zip(*(rows[c].tolist() for c in ("lost", "message_id", "nth", "delta", "ends")), strict=True):
            message = None if lost else message
            held, inside, found = _thoughts(*open_.pop(message, ("", False)), delta)
            if last and held:
                found, held = [*found, (inside, held)], ""
            if held or inside:
                open_[message] = (held, inside)
            for thought, text in found:
                ids.append(message)
                nths.append(nth)
                kinds.append("thought" if thought else "answer")
                texts.append(text)
        after = json.dumps([(m, *x) for m, x in open_.items()])
        if open_ and after != before:
            state.update((after,))
        elif not open_ and state.exists:
            state.remove()
        yield pd.DataFrame({"message_id": pd.Series(ids, dtype="Int64"), "nth": pd.Series(nths, dtype="int64"), "kind": pd.Series(kinds, dtype=object), "text": pd.Series(texts, dtype=object)})

    lost = F.col("message_id").isNull()
    rows = chunks.select(F.pmod(F.xxhash64("message_id"), F.lit(buckets)).alias("bucket"), lost.alias("lost"), F.coalesce("message_id", F.lit(0)).cast("long").alias("message_id"), F.col("nth").cast("long").alias("nth"), F.coalesce("delta", F.lit("")).alias("delta"), ends.alias("ends"))
    return rows.groupBy("bucket").applyInPandasWithState(step, "message_id long, nth long, kind string, text string", "waiting string", "append", GroupStateTimeout.NoTimeout)


def assembled(chunks: DataFrame) -> DataFrame:
    """Whole messages of streamed chunks (message_id, nth, delta, tokens; tokens only on the last), batch or complete mode."""
    parts = F.array_sort(F.collect_list(F.struct("nth", "delta")))
    return chunks.groupBy("message_id").agg(F.array_join(F.transform(parts, lambda x: x["delta"]), "").alias("text"), F.max("tokens").alias("tokens"))


def log_sink(logs: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Buffered log writing: a micro-batch a second."""
    return logs.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime="1 second").outputMode("append")


def windowed_counts(events: DataFrame, ts: str, key: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events a key and window, closed by a watermark. See closing for a table that ends."""
    timed = events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", window), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def closing(events: DataFrame, ts: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """The rows of a table that ends and one more, without other values, so late that windowed_counts closes all of their windows. Its own
    window stays open, so it counts nowhere."""
    beyond = F.max(ts) + F.expr(f"INTERVAL {window}") + F.expr(f"INTERVAL {window}") + F.expr(f"INTERVAL {late}")
    return events.unionByName(events.agg(beyond.cast(events.schema[ts].dataType).alias(ts)).filter(F.col(ts).isNotNull()), allowMissingColumns=True)
