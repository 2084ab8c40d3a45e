"""Personal data by a model: the reference rules on places, costs and masks, and odd texts."""

from __future__ import annotations

import base64
import re
from itertools import product

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import pii
from marlstone.plans import composed

ITEM = "array<struct<entity:string,text:string>>"


def b64(text: str | bytes) -> str:
    return base64.b64encode(text if isinstance(text, bytes) else text.encode()).decode()


def test_places():
    assert pii.starts("a.b ann\n lee Ann lee ann lee", "ann lee") == [4, 21] and pii.starts("axb a.b", "a.b") == [4]
    assert pii.starts("anything", " ") == [] and pii.starts("", "x") == []
    assert pii.starts("aaaa", "aa") == [0, 2]  # no overlaps
    run = b64("my name is 李小龙, call me any time")
    text = f"see {run} and {b64('nothing of the kind in here')} and {run}"
    assert pii.base64_starts(text, "李小龙") == [4, text.rindex(run)] and pii.base64_starts(text, "MY NAME") == [4, text.rindex(run)]
    assert pii.base64_starts(b64(b"\xff\xfe broken \xff bytes about ann lee"), "ann lee") == [0]
    assert pii.base64_starts("A" * 21, "a") == [] and pii.base64_starts(text, " ") == []  # 21 do not decode


def test_located_rows(spark):
    rows = [
        (1, "ann lee and ann  lee", [("NAME", "ann lee"), ("NAME", "nobody")]),
        (2, f"x {b64('the mail of ann lee is private')}", [("NAME", "Ann Lee"), ("NAME", None)]),
        (3, None, [("NAME", "ann")]), (4, "ann", []), (5, "ann", None), (6, "", [("NAME", "ann")]),
    ]
    df = spark.createDataFrame(rows, f"entity_id int, body string, items {ITEM}").withColumn("item", F.lit("clash")).drop("item")
    got = sorted((r["entity_id"], r["item"], -1 if r["location"] is None else r["location"]) for r in pii.located(df, "body", "items").collect())
    assert got == [(1, "ann lee", 0), (1, "ann lee", 12), (1, "nobody", -1), (2, "Ann Lee", 2), (3, "ann", -1), (6, "ann", -1)]
    assert pii.located(df.limit(0), "body", "items").count() == 0


def test_two_passes(spark):
    class Broken(pii.PatternTable):
        def generate(self, prompts, schema=None):
            return ["no json"] * len(prompts) if schema else super().generate(prompts)

    df = spark.createDataFrame([(1, "ann lee at 555 0123"), (2, ""), (3, None)], "id int, body string")
    model = pii.PatternTable({"NAME": "ann lee", "PHONE": r"\d{3} \d{4}"})
    got = {r["id"]: r for r in pii.detected(df, "body", {"phone number": "how to call"}, model, context="a call").collect()}
    assert [tuple(x) for x in got[1]["items"]] == [("NAME", "ann lee"), ("PHONE", "555 0123")] and got[2]["items"] == [] and got[3]["items"] is None
    assert got[1]["prompt_tokens"] > got[2]["prompt_tokens"] > 0 == got[3]["prompt_tokens"] == got[3]["completion_tokens"]
    assert all(not r["items"] for r in pii.detected(df, "body", {}, Broken({"NAME": "ann"})).collect())


def test_masks(spark):
    rows = [(1, "ann lee, ann\nlee, ann", [("NAME", "ann lee"), ("FIRST", "ann")]), (2, "a.b axb", [("X", "a.b"), ("Y", " ")]), (3, None, [("X", "a")]), (4, "kept  as\nis", None)]
    got = {r["id"]: r["m"] for r in pii.masked(spark.createDataFrame(rows, f"id int, body string, items {ITEM}"), "body", "items", "m").collect()}
    assert got == {1: "[NAME], [NAME], [FIRST]", 2: "[X] axb", 3: None, 4: "kept  as\nis"}


def python_nodes(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


def echo():
    """A model that replies with the text's last line."""

    class Echo:
        def generate(self, prompts, schema=None):
            return [p.rpartition("\n")[2] for p in prompts]

    return Echo()


ODD = [
    ('{"pii": [{"entity": "A", "text": "x"}]}', [("A", "x")]),
    ('```json{"pii": [{"text": "x"}, null]}```', [(None, "x"), None]),
    ('{"pii": [{"entity": "A", "text": 5550123}, {"entity": true, "text": {"b": [1]}}]}', [("A", "5550123"), ("true", '{"b":[1]}')]),
    ("{'pii': [{'entity': 'it\\'s', 'text': 'say \"hi\"'}]} that's all", [("it's", 'say "hi"')]),
    ('{"pii": [{"entity": "A", "text": "\\ud800z"}]}', [("A", "?z")]),
    ('{"pii": {"entity": "A", "text": "x"}}', []), ('{"pii": [{"entity": "A"}, 7]}', []), ("[]", []), ("here: {}", []), ('{"pii": ' + "[" * 20_000, []), (None, None),
]


def test_odd_replies(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ODD)], "id int, body string")
    got = {r["id"]: r["items"] and [None if x is None else tuple(x) for x in r["items"]] for r in pii.detected(df, "body", {}, echo()).collect()}
    assert got == {i: found for i, (_, found) in enumerate(ODD)}


def test_places_in_one_pass(spark):
    note = b64("the mail of ann lee is private")
    texts = ["ann lee and ann\nlee at 555 0123", f"x {note}", "", None, '{"pii": [{"entity": "A", "text": "pii"}, {"entity": "A", "text": null}, null]}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    for model in (pii.PatternTable({"NAME": r"ann\s+lee", "PHONE": r"\d{3} \d{4}"}, {"ID": "none"}), echo()):
        found = pii.detected(df, "body", {"name": "a person"}, model)
        once = pii.detected_located(df, "body", {"name": "a person"}, model)
        apart = pii.located(found, "body", "items")
        assert once.schema == apart.schema and sorted(map(repr, once.collect())) == sorted(map(repr, apart.collect())) and once.count() > 0
        # one Python worker a task, and no filter asks the model again
        assert python_nodes(once) == python_nodes(found) == python_nodes(found.filter("completion_tokens > 1 AND size(items) > 0")) == 1


def test_detecting_holds_one_python_worker_a_task(spark):
    assert python_nodes(composed.pii_detect(spark, "/root/testdata/sf0.001")) == 1


def test_masks_in_one_pass(spark):
    texts = ["ann lee, ann\u00a0\nlee, bo ann", "", None, "none of them", '{"pii": [{"entity": "A", "text": "pii"}, {"entity": "B", "text": "A"}, {"entity": "C", "text": " "}, null]}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    for model in (pii.PatternTable({"NAME": r"ann\s+lee", "FIRST": "ann"}, {"ID": "none"}), echo()):
        found = pii.detected(df, "body", {"name": "a person"}, model)
        once = pii.detected_masked(df, "body", "m", {"name": "a person"}, model)
        apart = pii.masked(found, "body", "items", "m")
        assert once.schema == apart.schema and sorted(map(repr, once.collect())) == sorted(map(repr, apart.collect()))
        assert python_nodes(once) == 1
    got = {r["id"]: r["m"] for r in once.collect()}
    assert got == {0: texts[0], 1: "", 2: None, 3: texts[3], 4: '{"[A]": [{"entity": "[B]", "text": "[A]"}, {"entity": "B", "text": "[B]"}, {"entity": "C", "text": " "}, null]}'}


def test_masking_holds_one_python_worker_a_task(spark):
    assert python_nodes(composed.pii_detect_mask(spark, "/root/testdata/sf0.001")) == 1


def test_masks_are_what_one_pattern_gives():
    items = [{"entity": k, "text": x} for k, x in (("A", "a b"), ("B", "b"), ("C", "ab"), ("D", "a"), ("E", "b  a"))]
    for some in (items, items[:3], items[::2], items[3:]):
        names = {" ".join(x["text"].split()): x["entity"] for x in some}
        either = re.compile("|".join(T.item_pattern(x) for x in sorted(names, key=lambda x: (-len(x), x))))
        for t in map("".join, product("ab \n.", repeat=5)):
            assert pii._masked(t, some) == either.sub(lambda m: f"[{names[' '.join(m.group().split())]}]", t)
            assert all(pii.starts(t, x["text"]) == [m.start() for m in re.finditer(T.item_pattern(x["text"]), t)] for x in some)
