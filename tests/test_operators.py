"""Golden cases, folds against closed forms, and null, empty and repeated input."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import chunking, models, text
from marlstone.operators import budget, chats, examples, quota, sync, vector
from marlstone.plans import store
from marlstone.sources import files
from marlstone.streaming import operators as streams

LOREM = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit. Sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, "
    "quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure."
)


def test_splitter_goldens():
    assert chunking.split_text("dummy-content", 100, 20) == ["dummy-content"]
    long, short = chunking.split_text(LOREM[:244], 100, 20), chunking.split_text(LOREM[:151], 100, 20)
    assert len(long) == 3 and len(short) == 2
    assert len(set(long) - set(short)) == 2 and len(set(short) - set(long)) == 1
    assert chunking.split_text("", 100, 20) == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .,\n", max_size=300), st.integers(5, 40))
def test_chunks_are_bounded(body, size):
    found = chunking.split_text(body, size, size // 4)
    assert all(0 < len(c) <= size for c in found)


def test_fragments():
    assert chunking.fragments_of("one two three. four") == ["one two", "three", "four"]
    assert chunking.fragments_of(" ") == []


def fold(rows, limit, window):
    """Requests one by one: a record lapses after the first tick past its making, a new one is not asked for its balance, and only admitted requests are charged."""
    records, out = {}, {}
    for event_id, user, ms, cost in sorted(rows, key=lambda r: (r[2], r[0])):
        made, tokens = records.get(user, (None, None))
        if made is None or ms > (made // window + 1) * window:
            made, tokens, allowed = ms, limit, True
        else:
            allowed = tokens >= 1
        out[event_id] = (allowed, tokens)
        records[user] = (made, tokens - cost if allowed else tokens)
    return out, records


def test_rate_limit_equals_the_fold(spark):
    random.seed(3)
    for step in (250, 500, 1000):  # the coarser, the more requests on ticks
        rows = [(i, random.randrange(6), random.randrange(0, 16) * step, float(random.randrange(0, 6))) for i in range(200)]
        df = spark.createDataFrame(rows, "event_id long, user_id long, ms long, cost double")
        want, records = fold(rows, 7.0, 1000)
        got = quota.admitted(df, ["user_id"], "ms", "event_id", "cost", 7.0, 1000).collect()
        assert {r["event_id"]: (r["admitted"], r["left"]) for r in got} == want
        held = {r["user_id"]: (r["balance"], r["reset_ms"]) for r in quota.balances(df, ["user_id"], "ms", "event_id", "cost", 7.0, 1000).collect()}
        assert held == {u: (tokens, (made // 1000 + 1) * 1000) for u, (made, tokens) in records.items()}


@pytest.mark.parametrize("expression", ["15,45 8-18/5 * * mon-fri", "* * * * *", "0 0 29 2 *", "30 12 1,15 * fri", "0 6 * * 7"])
def test_cron_windows_equal_the_fold(spark, expression):
    """Requests on and around irregular ticks, one by one: the tick after a record's making is a search over minutes."""
    rng = random.Random(7)
    start = datetime(2024, 2, 26)
    fields, parts = quota.cron_fields(expression), expression.split()

    def fits(t):
        in_month, in_week = t.day in fields["day"], t.isoweekday() % 7 in {d % 7 for d in fields["weekday"]}
        days = in_month or in_week if not (parts[2].startswith("*") or parts[4].startswith("*")) else in_month and in_week
        return t.minute in fields["minute"] and t.hour in fields["hour"] and t.month in fields["month"] and days

    minutes = [k for k in range(60 * 24 * 60) if fits(start + timedelta(minutes=k))]
    origin = (start - datetime(1970, 1, 1)) // timedelta(milliseconds=1)
    ticks = [origin + 60_000 * k for k in minutes]
    near = [t + rng.choice([0, 0, -1, 1, 30_000, 59_999]) for t in ticks if t < origin + 20 * 86_400_000]
    rows = [(i, rng.randrange(3), rng.choice(near) if near and rng.random() < 0.7 else origin + rng.randrange(20 * 86_400_000), float(rng.randrange(0, 6))) for i in range(250)]
    next_tick = lambda ms: next((t for t in ticks if t > ms), None)
    want, records = {}, {}
    for event_id, user, ms, cost in sorted(rows, key=lambda r: (r[2], r[0])):
        until, tokens = records.get(user, (None, None))
        lapsed = user not in records or (until is not None and ms > until)
        until, tokens, allowed = (next_tick(ms), 7.0, True) if lapsed else (until, tokens, tokens >= 1)
        want[event_id] = (allowed, tokens)
        records[user] = (until, tokens - cost if allowed else tokens)
    df = spark.createDataFrame(rows, "event_id long, user_id long, ms long, cost double").withColumn("_day", F.lit("x"))
    got = quota.admitted(df.drop("_day"), ["user_id"], "ms", "event_id", "cost", 7.0, expression).collect()
    assert {r["event_id"]: (r["admitted"], r["left"]) for r in got} == want
    if expression != "0 0 29 2 *":  # its next tick is years away
        held = {r["user_id"]: (r["balance"], r["reset_ms"]) for r in quota.balances(df.drop("_day"), ["user_id"], "ms", "event_id", "cost", 7.0, expression).collect()}
        assert held == {u: (tokens, until) for u, (until, tokens) in records.items()}


def test_ticks_at_the_edges(spark):
    df = spark.createDataFrame([(None,), (-5,), (0,), (4_102_444_800_001,)], "ms long")
    got = [tuple(r) for r in quota.ticked(df, "ms", "0 0 * * *").collect()]
    assert got[0] == (None, None, None, None) and got[1][1:] == (None, None, None) and got[2] == (0, 0, True, 86_400_000) and got[3][1:] == (None, None, None)


def test_rejected_requests_cost_nothing(spark):
    df = spark.createDataFrame([(1, 1, 100, 9.5), (2, 1, 200, 3.0), (3, 1, 300, 3.0)], "event_id long, user_id long, ms long, cost double")
    got = quota.admitted(df, ["user_id"], "ms", "event_id", "cost", 10.0, 1000).orderBy("event_id").collect()
    assert [(r["left"], r["admitted"]) for r in got] == [(10.0, True), (0.5, False), (0.5, False)]


@pytest.mark.parametrize("expression", ["*/5 * * * *", "15,45 8-18/5 * * mon-fri", "0 0 29 2 *", "30 12 1,15 * fri", "59 23 31 dec *", "0 6 * * 7", "7/20 3 * * *"])
def test_cron_against_minutes(spark, expression):
    fields, parts = quota.cron_fields(expression), expression.split()

    def fits(t):
        in_month, in_week = t.day in fields["day"], t.isoweekday() % 7 in {d % 7 for d in fields["weekday"]}
        days = in_month or in_week if not (parts[2].startswith("*") or parts[4].startswith("*")) else in_month and in_week
        return t.minute in fields["minute"] and t.hour in fields["hour"] and t.month in fields["month"] and days

    def after(t):
        t = t.replace(second=0) + timedelta(minutes=1)
        while not fits(t):
            t = t + timedelta(minutes=1) if t.minute % 60 or fits_day(t) else t + timedelta(hours=1)
        return t

    fits_day = lambda t: any(fits(t.replace(minute=m)) for m in range(60))
    times = [datetime(2023, 12, 31, 23, 59, 30), datetime(2024, 2, 29, 0, 0), datetime(2024, 3, 1, 8, 15), datetime(2025, 5, 9, 18, 45, 1), datetime(2024, 7, 6, 12, 30)]
    df = spark.createDataFrame([(k, t.strftime("%Y-%m-%d %H:%M:%S")) for k, t in enumerate(times)], "k int, t string")
    got = {r["k"]: r["n"] for r in df.select("k", F.date_format(quota.cron_next(F.col("t").cast("timestamp"), expression), "yyyy-MM-dd HH:mm:ss").alias("n")).collect()}
    assert got == {k: after(t).strftime("%Y-%m-%d %H:%M:%S") for k, t in enumerate(times)}


@pytest.mark.parametrize("expression", ["* * * *", "60 * * * *", "* 5-1 * * *", "*/0 * * * *", "x * * * *"])
def test_bad_cron(expression):
    with pytest.raises(ValueError):
        quota.cron_fields(expression)


def test_budgets_equal_the_loops(spark):
    random.seed(4)
    rows = [(c, t, random.randrange(0, 30)) for c in range(9) for t in range(random.randrange(1, 12))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, n long")
    packed = {(r["conv_id"], r["turn"]) for r in budget.pack_context(df, ["conv_id"], [F.asc("turn")], "n", 60).collect()}
    found = budget.truncate_history(df, "conv_id", "turn", "n", 150, 20).collect()
    for c in range(9):
        total = 0
        mine = sorted(r for r in rows if r[0] == c)
        for _, t, n in mine:
            total += n
            assert ((c, t) in packed) == (total < 60)
            if total >= 60:
                break
        cost = lambda messages: sum(n + 3 for *_, n in messages) + 3
        *history, question = mine
        room, kept = 150 - cost([question]), list(history)
        if cost(history) > room:
            while kept and cost(kept) > room - 20:
                kept.pop(0)
        assert {r["turn"] for r in found if r["conv_id"] == c} == {t for _, t, _ in kept}
        assert {r["summarised"] for r in found if r["conv_id"] == c} <= {cost(history) > room}


def test_search_dispatch(spark):
    df = spark.createDataFrame([(k, [1.0, float(k)], "s" if k % 2 else "t") for k in range(6)], "vec_id long, embedding array<double>, space_id string")
    top = lambda rows: vector.filtered_top_k(rows, [1.0, 0.0], F.lit(True), 9, 0.0)
    ids = lambda rows: [r["vec_id"] for r in rows.collect()]
    assert ids(vector.searched({None: df}, "live", top)) == [0, 1, 2, 3, 4, 5]
    assert ids(vector.searched({None: df}, None, top, "s")) == [1, 3, 5]
    assert ids(vector.searched({"live": df.filter("vec_id < 2"), "staging": df}, "live", top)) == [0, 1]
    for environment, space in ((None, None), ("other", None), ("live", "s")):
        with pytest.raises(ValueError):
            vector.searched({"live": df, "staging": df}, environment, top, space)
    text, image = top(df).select("vec_id", "score"), top(df).filter("vec_id > 3").select("vec_id", "score")
    assert ids(vector.combined(text, image))[:2] == [4, 5]
    assert ids(vector.combined(text, image.limit(0))) == [0, 1, 2, 3, 4, 5] and ids(vector.combined(text.limit(0), image)) == [4, 5]
    got = [(r["vec_id"], r["score"]) for r in vector.hybrid_top_k(df, [1.0, 0.0], ["space_id"], [0], 4, 1, knn=2).collect()]
    assert [i for i, _ in got] == [1, 2, 3, 4] and [s for _, s in got[2:]] == [1000.0, 1000.0]
    with pytest.raises(Exception, match="zero vector"):
        spark.sql("SELECT array(0.0D) AS a").select(vector.cosine(F.col("a"), F.col("a"), strict=True)).collect()


def test_chats(spark):
    chunks = spark.createDataFrame([(1, "the sky is blue", "sky", "u1", 3, 4), (2, "grass is green", "grass", "u2", 5, 3)], "vec_id long, content string, title string, url string, page int, n_token int")
    chunks = models.embedded(chunks, "content", "embedding", models.HashingEmbedder())
    talk = lambda *texts: spark.createDataFrame([(1, k, "user", t) for k, t in enumerate(texts)], "conv_id int, turn int, role string, text string")

    def ask(*texts, **more):
        told = talk(*texts)
        return chats.answered(told, chats.retrieval_queries(told, chats.JsonEcho(), models.HashingEmbedder()), chunks, chats.JsonEcho(), threshold=1.3, **more).collect()

    assert [(r["n_context"], r["answer"]) for r in ask("the sky is blue")] == [(1, "the sky is blue")]
    assert [(r["n_context"], r["answer"], r["prompt_tokens"]) for r in ask("zebra")] == [(0, chats.CANNOT_ANSWER, 0)]
    assert [r["answer"] for r in ask("zebra", cannot_answer="none")] == ["none"]
    assert ask("one two", "three four", "the sky is blue", history=30, summary=5)[0]["answer"] == "the sky is blue"
    assert ask() == []
    kept = ask("one two", "three four", "the sky is blue", history=21, summary=3)[0]
    assert kept["summarised"] and kept["history"] == "user: three four\nSummary: user: one two"  # the summary comes last
    shots = chunks.selectExpr("vec_id", "content AS question", "title AS answer", "embedding")
    query = spark.createDataFrame([(1, "the sky is blue")], "query_id int, query string")
    got = chats.few_shot(query, shots, "Say.", models.HashingEmbedder(), models.LastLine(), n=1).collect()
    assert [(r["answer"], r["examples"]) for r in got] == [("the sky is blue", [1])]
    got = chats.few_shot(query, shots, "Say.", models.HashingEmbedder(), models.LastLine(), n=1, removed=shots.filter("vec_id = 1").select("vec_id")).collect()
    assert [r["examples"] for r in got] == [[2]]


def test_examples_in_order(spark):
    store = spark.createDataFrame([("a", "q1", "x"), ("b", "q2", "y")], "_id string, question string, answer string")
    got = examples.updated(store, ["b", "a"], [{"question": "new"}, {"answer": "z"}], "_id").orderBy("_id").collect()
    assert [tuple(r) for r in got] == [("a", "q1", "z"), ("b", "new", "y")]
    with pytest.raises(ValueError):
        examples.updated(store, ["b"], [], "_id")
    assert examples.updated(store, ["b", "a"], [{"question": "n"}], "_id", strict=False).filter("question = 'n'").count() == 1


def test_vectors_by_hand(spark):
    """Vectors from the words' checksums."""
    import hashlib

    v = [0.0] * 8
    for w in ("hello", "world", "hello"):
        h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
        v[h % 2**31 % 8] += 1 if h >= 2**31 else -1
    got = models.embedded(spark.createDataFrame([("Hello world hello",)], "t string"), "t", "v", models.HashingEmbedder(8)).first()["v"]
    assert got == v


def test_messages(spark):
    rows = ['{"role": "user", "parts": [{"kind": "text", "text": "a"}]}', '{"role": "user", "parts": [{"kind": "video"}]}', "no json", '{"role": "robot", "parts": []}', '{"role": "user", "parts": []}', None]
    df = spark.createDataFrame([(r,) for r in rows], "m string").withColumn("n", text.normalised(F.col("m")))
    assert [r["t"] for r in df.select(text.first_part(F.col("n"), "text").alias("t")).collect()] == ["a", None, None, None, None, None]
    assert [r["ok"] for r in df.select(F.col("n").isNotNull().alias("ok")).collect()] == [True, False, False, False, True, False]
    data = '{"role": "user", "parts": [{"kind": "data", "data": "d"}]}'
    with pytest.raises(Exception, match="no content"):
        spark.createDataFrame([(data,)], "m string").select(text.content_parts(text.normalised(F.col("m")))).collect()
    schema = {"type": "object", "additionalProperties": False, "properties": {"n": {"type": ["integer", "null"]}, "xs": {"type": "array", "items": [{"type": ["string", "null"]}]}}}
    assert text.nullable_schema(schema) == {"type": "object", "properties": {"n": {"type": "integer", "nullable": True}, "xs": {"type": "array", "items": [{"type": "string", "nullable": True}]}}}


def test_item_starts(spark):
    cases = [("aa aaa", "a"), ("Ann  lee", "Ann lee"), ("", "x"), ("x", ""), ("a.b ab", "a.b"), ("aXaXa", "aXa")]
    for body, item in cases:
        got = spark.createDataFrame([(body,)], "b string").select(text.item_starts(F.col("b"), item)).first()[0]
        pattern = r"\s+".join(re.escape(w) for w in item.split())
        assert sorted(got) == ([m.start() for m in re.finditer(f"(?={pattern})", body)] if pattern else []), (body, item, got)


def test_chunk_diff_goldens(spark):
    schema = "doc_id long, content string, collection string, title string"
    made = lambda texts, col="c": spark.createDataFrame([(1, t, col, "t") for t in texts], schema)
    counts = lambda new, old: {r["action"]: r["count"] for r in sync.chunk_diff(new, old).groupBy("action").count().collect()}
    long, short = chunking.split_text(LOREM[:244], 100, 20), chunking.split_text(LOREM[:151], 100, 20)
    assert counts(made(long), made([])) == {"insert": 3}
    assert counts(made(long), made(long)) == {"keep": 3}
    assert counts(made(long), made(short)) == {"insert": 2, "delete": 1, "keep": 1}
    assert counts(made(short), made(long)) == {"insert": 1, "delete": 2, "keep": 1}
    assert counts(made(long, "moved"), made(long)) == {"update": 3}
    assert counts(made(["a", "a"]), made(["a"])) == {"insert": 1, "keep": 1}


def test_connector_scenarios(spark):
    now, hour = 1_700_000_000_000, 3_600_000
    listing = lambda *rows: spark.createDataFrame(list(rows), "id string, name string, web_url string, modified_ms long")
    states = lambda *rows: spark.createDataFrame(list(rows), "id string, web_url string, modified_ms long, upserted_ms long, status string, retry int")
    act = lambda a, b: [r["action"] for r in sync.plan(a, b, now).collect()]
    pdf, link = ("f", "d.pdf", "u/d.pdf", now), ("f", "d.url", "u/d.url", now)
    assert act(listing(), states()) == []
    assert act(listing(pdf), states()) == ["upsert"]
    assert act(listing(pdf), states(("f", "u/d.pdf", now, now, "successful", 0))) == ["none"]
    assert act(listing(pdf), states(("f", "u/d.pdf", now - 1000, now, "successful", 0))) == ["upsert"]
    assert act(listing(pdf), states(("f", "u/d.pdf", now, now, "failed", 1))) == ["upsert"]
    assert act(listing(pdf), states(("f", "u/d.pdf", now, now, "failed", 3))) == ["none"]
    assert act(listing(pdf), states(("f", "u/d.pdf", None, None, None, None))) == ["upsert"]
    assert act(listing(), states(("f", "u/d.pdf", now, now, "successful", 0))) == ["remove"]
    assert act(listing(link), states(("f", "u/d.url", now, now - hour, "successful", 0))) == ["none"]
    assert act(listing(link), states(("f", "u/d.url", now, now - 13 * hour, "successful", 0))) == ["upsert"]
    assert act(listing(("f", "d.zip", "u", now)), states()) == ["unsupported"]


def test_vectors_with_nulls_and_zeros(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0]), (5, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in vector.filtered_top_k(df, [1.0, 0.0], F.lit(True), 3, 1.0).collect()]
    assert got == [(1, 2.0), (5, 2.0), (4, 1.707107)]
    assert vector.filtered_top_k(df, None, F.lit(True), 3, 1.0).count() == 0


def test_validation_and_merge(spark):
    df = spark.createDataFrame([("a", "b", None), (None, "b", None), ("a", "b", "id")], "question string, answer string, _id string")
    assert [r["state"] for r in examples.validated(df, ["question", "answer"]).collect()] == ["valid", "missing", "reserved"]


def test_text_functions(spark):
    df = spark.createDataFrame([("Contact me at test@example.com or call 555-0123",), (None,), ("",)], "t string")
    rows = df.select(text.located(F.col("t"), "email", text.PII["email"]).alias("e"), text.located(F.col("t"), "phone", text.PII["phone"]).alias("p"), text.masked(F.col("t")).alias("m")).collect()
    assert [x["location"] for x in rows[0]["e"]] == [14] and [x["location"] for x in rows[0]["p"]] == [39]
    assert rows[0]["m"] == "Contact me at [EMAIL] or call [PHONE]"
    assert rows[2]["e"] == [] and rows[2]["m"] == ""


def test_page_range(spark):
    df = spark.createDataFrame([(["abc", "defg"], "bc\n\nde"), (["abc", "defg"], "abc"), ([], "x"), (["abc"], "zz")], "pages array<string>, chunk string")
    assert [tuple(r[0]) for r in df.select(chunking.page_range(F.col("pages"), F.col("chunk"))).collect()] == [(1, 2), (1, 1), (-1, -1), (-1, -1)]


def test_files_and_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# hi")
    (tmp_path / "in" / "b.html").write_text("<html><head><title>x</title></head><body>Hello <b>you</b></body></html>")
    (tmp_path / "in" / "c.url").write_text("[InternetShortcut]\nURL=https://x.example/p q")
    (tmp_path / "in" / "d.png").write_bytes(b"png")
    path = str(tmp_path / "in")
    assert {r["name"]: r["reader"] for r in files.listing(spark, path).collect()} == {"a.md": "text", "b.html": "text", "c.url": "link", "d.png": "image"}
    assert {r["name"]: r["content"] for r in files.texts(spark, path).collect()} == {"a.md": "# hi", "b.html": "Hello you"}
    assert [r["url"] for r in files.links(spark, path).collect()] == ["https://x.example/p"]
    assert files.images(spark, path).count() == 1
    rows = spark.createDataFrame([(1, "p"), (2, "q")], "id long, prompt string")
    files.write_batch(rows, "id", "prompt", str(tmp_path / "batch"))
    assert spark.read.text(str(tmp_path / "batch")).count() == 2
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "r.jsonl").write_text('{"custom_id": "2", "response": "yes"}\nnot json\n{"custom_id": "1", "response": "busy", "status": 429}\n')
    got = files.aligned(rows, files.read_batch(spark, str(tmp_path / "out")), "id")
    assert {r["id"]: r["response"] for r in got.collect()} == {1: "", 2: "yes"}


def test_token_counts(spark):
    path = __import__("public_tokenizers").path("word_bpe_49k.json")
    df = spark.createDataFrame([("Hello world, hello",), ("",), (None,)], "t string")
    got = [r["n"] for r in models.counted(df, "t", "n", models.VocabularyFile(str(path))).collect()]
    assert got[0] >= 4 and got[1:] == [0, 0]


def test_models(spark):
    df = spark.createDataFrame([("hello world",), (" ",), (None,)], "t string")
    rows = models.embedded(df, "t", "v", models.HashingEmbedder(8)).collect()
    assert len(rows[0]["v"]) == 8 and rows[1]["v"] is None and rows[2]["v"] is None
    assert [r["a"] for r in models.generated(df, "t", "a", models.LastLine()).collect()] == ["hello world", "", None]


def test_log_stream(spark, tmp_path):
    spark.range(50).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    query = streams.log_sink(stream, str(tmp_path / "out"), str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50


def test_thoughts_across_chunks(spark, tmp_path):
    body = "<think>because</think>the answer"
    rows = [(1, k, body[i : i + 3]) for k, i in enumerate(range(0, len(body), 3))]
    spark.createDataFrame(rows, "message_id long, nth long, delta string").write.parquet(str(tmp_path / "in"))
    made = streams.split_thoughts(spark.readStream.schema("message_id long, nth long, delta string").parquet(str(tmp_path / "in")))
    made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("nth", "kind", "text").collect())
    assert "".join(t for _, k, t in got if k == "thought") == "because"
    assert "".join(t for _, k, t in got if k == "answer") == "the answer"


def test_next_ticks_of_repeated_events(spark, tmp_path, duck):
    """A row for each event id, as in the SQL, where ids repeat or times are null."""
    spark.sql("SELECT * FROM VALUES (1L, TIMESTAMP_NTZ '2024-01-05 18:50:00'), (1L, TIMESTAMP_NTZ '2024-01-05 18:50:00'), (2L, TIMESTAMP_NTZ '2024-01-02 08:14:59.5'), (3L, NULL) AS t(event_id, ts)").write.parquet(f"{tmp_path}/events.parquet")
    sql = store.ORACLE_SQL["cron_next"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(tuple(r) for r in store.cron_next(spark, str(tmp_path)).collect()) == sorted(duck.sql(sql).fetchall())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab .\n", max_size=60), max_size=6), st.integers(5, 40))
def test_ranges_of_chunks(pages, size):
    """Ranges by running lengths against a walk over the pages."""
    joined, want = "\n\n".join(pages), []
    for chunk in chunking.split_text(joined, size, size // 4):
        at, first, last, start = 0, -1, -1, joined.find(chunk)
        for k, p in enumerate(pages, 1):
            first = k if first == -1 and at + len(p) + 2 > start else first
            last = k if last == -1 and start + len(chunk) - at <= len(p) else last
            at += len(p) + 2
        want.append((first, len(pages) if last == -1 else last) if start >= 0 else (-1, -1))
    assert chunking.ranges_of(pages, size, size // 4) == want


def test_no_text_goes_with_the_ranges_of_chunks(spark):
    df = spark.createDataFrame([(1, ["a b " * 300, "c d " * 300]), (2, []), (3, None)], "k int, pages array<string>")
    want = chunking.chunks(df.withColumn("body", F.array_join("pages", "\n\n")), "body").select("k", "nth", chunking.page_range(F.col("pages"), F.col("content")).alias("p")).select("k", "nth", "p.*").collect()
    found = chunking.chunk_pages(df, "pages")
    assert sorted(found.collect()) == sorted(want) and found.columns == ["k", "nth", "start_page", "end_page"]
    assert "array_join" not in found._jdf.queryExecution().optimizedPlan().toString()
