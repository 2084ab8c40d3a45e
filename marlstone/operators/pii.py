"""Personal data in a table of texts: found by a model in two passes, a table in words and then JSON, and placed in the text."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import models
from ..functions import text as T
from . import budget as B

#: What the second pass must give.
SCHEMA = {"type": "object", "required": ["pii"], "properties": {"pii": {"type": "array", "items": {"type": "object", "properties": {"entity": {"type": "string"}, "text": {"type": "string"}}}}}}
#: A quoted string of a reply, in either kind of quotes, and what in it is written otherwise in JSON.
_QUOTED, _ESCAPED = re.compile(r"""(["'])((?:(?!\1)[^\\]|\\.)*)\1""", re.DOTALL), re.compile(r'\\.|"', re.DOTALL)
#: Fixed value: what counts as a run of base64.
RUN = re.compile(r"[A-Za-z0-9+/]{20,}={0,2}")


def starts(text: str, item: str) -> list[int]:
    """Where an item starts in a text (code points from 0), whatever white space is between its words; matches do not overlap. An item without words is nowhere."""
    found, words, span = [], item.split(), (0, 0)
    while span := _next(text, words, span[1]):
        found.append(span[0])
    return found


def _next(text: str, words: list[str], at: int) -> tuple[int, int] | None:
    """The first place from ``at`` on where the words stand one after another with white space between: its start and end. What ``T.item_pattern`` matches, without
    a pattern compiled for every item."""
    start = text.find(words[0], at) if words else -1
    while start >= 0:
        end = start + len(words[0])
        for w in words[1:]:
            gap = end
            while end < len(text) and text[end].isspace():
                end += 1
            if end == gap or not text.startswith(w, end):
                break
            end += len(w)
        else:
            return start, end
        start = text.find(words[0], start + 1)
    return None


def base64_starts(text: str, item: str) -> list[int]:
    """The starts of the runs of base64 that hold an item, in any case, in the UTF-8 that they decode to; invalid bytes are ignored, runs that do not decode skipped."""
    found, wanted = [], item.lower()
    for m in RUN.finditer(text) if wanted.strip() else ():
        try:
            decoded = base64.b64decode(m.group(), validate=True)
        except ValueError:
            continue
        if wanted in decoded.decode("utf-8", errors="ignore").lower():
            found.append(m.start())
    return found


def starts_in_base64(text: Column, item: Column) -> Column:
    """``base64_starts`` of two columns; null where one is."""

    @F.pandas_udf("array<int>")
    def find(texts: pd.Series, items: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or i is None else base64_starts(t, i) for t, i in zip(texts, items, strict=True)], dtype=object)

    return find(text, item)


def _places(text: str, item: str) -> list[int | None]:
    return starts(text, item) or base64_starts(text, item) or [None]


_ITEM, _PLACED = "struct<entity:string,text:string>", "struct<entity:string,item:string,at:array<int>>"


def _located(text: str | None, items: list[dict | None]) -> list[dict]:
    """The items with a text, each with all its places."""
    return [{"entity": x["entity"], "item": x["text"], "at": [None] if text is None else _places(text, x["text"])} for x in items if x is not None and x["text"] is not None]


def _by_place(rows: DataFrame, others: list[str], placed: str) -> DataFrame:
    """A row for every place of the ``_PLACED`` items."""
    each = rows.select(*others, F.explode(placed).alias("_x"))
    return each.select(*others, F.col("_x.entity").alias("entity"), F.col("_x.item").alias("item"), F.explode("_x.at").alias("location"))


def located(rows: DataFrame, text: str, items: str) -> DataFrame:
    """A row for every place of every item of ``rows``: the row's columns but for ``items`` (an array of structs of entity and text), ``entity``, ``item`` and
    ``location``: each start in the text; where there is none, of each run of base64 that holds it; else null. Items without a text are left out, a row
    without items has no rows, in a null text every item has a null location."""

    @F.pandas_udf(f"array<{_PLACED}>")
    def find(texts: pd.Series, named: pd.Series) -> pd.Series:
        return pd.Series([_located(t, [] if xs is None else xs) for t, xs in zip(texts, named, strict=True)], dtype=object)

    return _by_place(rows.withColumn("_placed", find(F.col(text), F.col(items))), [c for c in rows.columns if c != items], "_placed")


def _parsed(reply: str) -> object:
    """The JSON that a reply begins with; strings may be in single quotes."""
    try:
        return json.JSONDecoder().raw_decode(reply)[0]
    except ValueError:
        inner = lambda m: {"\\'": "'", '"': '\\"'}.get(m[0], m[0])
        return json.JSONDecoder().raw_decode(_QUOTED.sub(lambda m: f'"{_ESCAPED.sub(inner, m[2])}"', reply))[0]


def _items(reply: str | None) -> list[dict | None]:
    """The items of the second pass's reply; none where it is no such JSON. What is no string is as JSON writes it."""
    # a JSON string may hold half a surrogate pair, which UTF-8 has not
    plain = lambda v: None if v is None else (v if isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False)).encode("utf-8", "replace").decode()
    try:
        made = _parsed(T.unfenced(reply or "").lstrip())["pii"]
        return [None if x is None else {"entity": plain(x.get("entity")), "text": plain(x.get("text"))} for x in made] if isinstance(made, list) else []
    except (ValueError, TypeError, LookupError, AttributeError, RecursionError):
        return []


_SECOND = "Turn all rows of the table into JSON.\nTable:\n"


def _asked(rows: DataFrame, text: str, config: dict[str, str], model: models.LanguageModel, context: str | None, finish: Callable, kind: str) -> DataFrame:
    """``rows`` with ``prompt_tokens``, ``completion_tokens`` and ``_made.done``: what ``finish`` makes, as ``kind``, of each text and the items that the model finds.

    Both passes and ``finish`` are one function: each of several would keep a Python worker of its own for every task. It counts as nondeterministic, so that no
    filter asks the model again."""
    named = "\n".join(f"{T.category_tag(name)}: {meaning}" for name, meaning in config.items())
    about = [f"About the text: {context}"] if context else []
    head = "\n".join(["List the personal and sensitive data in the text as a Markdown table with the columns entity and text.", named, *about, "Text:\n"])

    @F.pandas_udf(f"struct<table:string,json:string,done:{kind}>")
    def ask(texts: pd.Series) -> pd.DataFrame:
        tables = models.replies([None if t is None else head + t for t in texts], model)
        replies = models.replies([None if t is None else _SECOND + t for t in tables], model, SCHEMA)
        done = [None if t is None else finish(t, _items(r)) for t, r in zip(texts, replies, strict=True)]
        return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in (("table", tables), ("json", replies), ("done", done))})

    tokens = lambda *c: sum((B.word_tokens(x).cast("long") for x in c[1:]), B.word_tokens(c[0]).cast("long"))
    table, reply = F.col("_made.table"), F.col("_made.json")
    prompts = tokens(F.concat(F.lit(head), F.col(text)), F.concat(F.lit(_SECOND), table))
    return rows.withColumn("_made", ask.asNondeterministic()(F.col(text))).select(*rows.columns, "_made", prompts.alias("prompt_tokens"), tokens(table, reply).alias("completion_tokens"))


def detected(rows: DataFrame, text: str, config: dict[str, str], model: models.LanguageModel, context: str | None = None) -> DataFrame:
    """``rows`` with ``items`` (structs of entity and text, in the model's order), ``prompt_tokens`` and ``completion_tokens`` of both passes.

    config: the definition of each category by name. The first pass asks for a Markdown table of what is found, with the context of the texts if there is one; the second turns the table into
    JSON. Null texts are not asked and have null items; a reply that is no such JSON gives none."""
    asked = _asked(rows, text, config, model, context, lambda _, items: items, f"array<{_ITEM}>")
    return asked.select(*rows.columns, F.col("_made.done").alias("items"), "prompt_tokens", "completion_tokens")


def detected_located(rows: DataFrame, text: str, config: dict[str, str], model: models.LanguageModel, context: str | None = None) -> DataFrame:
    """``located`` of what ``detected`` finds, in one pass through Python."""
    asked = _asked(rows, text, config, model, context, _located, f"array<{_PLACED}>")
    return _by_place(asked, [*rows.columns, "prompt_tokens", "completion_tokens"], "_made.done")


def _masked(text: str | None, items: list[dict | None] | None) -> str | None:
    if text is None:
        return None
    names = {" ".join(x["text"].split()): x["entity"] for x in reversed([] if items is None else items) if x is not None and x["text"] and x["text"].split()}
    longest = [(x.split(), names[x]) for x in sorted(names, key=lambda x: (-len(x), x))]
    out, at = [], 0
    ahead = {k: span for k, (words, _) in enumerate(longest) if (span := _next(text, words, 0))}
    while ahead:
        first = min(ahead, key=lambda k: (ahead[k][0], k))
        start, end = ahead[first]
        out += [text[at:start], f"[{longest[first][1]}]"]
        at = end
        ahead = {k: span for k, was in ahead.items() if (span := was if was[0] >= at else _next(text, longest[k][0], at))}
    return "".join([*out, text[at:]])


def masked(rows: DataFrame, text: str, items: str, into: str) -> DataFrame:
    """``rows`` with the text in which every item, longest first, is replaced by its entity in brackets wherever its words stand; case counts."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series, named: pd.Series) -> pd.Series:
        return pd.Series([_masked(t, xs) for t, xs in zip(texts, named, strict=True)], dtype=object)

    return rows.withColumn(into, mask(F.col(text), F.col(items)))


def detected_masked(rows: DataFrame, text: str, into: str, config: dict[str, str], model: models.LanguageModel, context: str | None = None) -> DataFrame:
    """``masked`` with what ``detected`` finds, in one pass through Python."""
    asked = _asked(rows, text, config, model, context, lambda t, items: {"items": items, "masked": _masked(t, items)}, f"struct<items:array<{_ITEM}>,masked:string>")
    return asked.select(*rows.columns, F.col("_made.done.items").alias("items"), "prompt_tokens", "completion_tokens", F.col("_made.done.masked").alias(into))


class PatternTable:
    """Stand-in for a model that detects: what patterns find in the text, and in what its base64 decodes to, each once; and what it makes up."""

    def __init__(self, patterns: dict[str, str], made_up: dict[str, str] | None = None):
        self.patterns, self.made_up = patterns, made_up or {}

    def _table(self, prompt: str) -> str:
        text = prompt.partition("Text:\n")[2]
        runs = [base64.b64decode(m.group()).decode("utf-8", errors="ignore") for m in RUN.finditer(text) if len(m.group()) % 4 == 0]
        found = {(name, " ".join(m.group().split())): None for part in (text, *runs) for name, p in self.patterns.items() for m in re.finditer(p, part)}
        return "\n".join(["| entity | text |", "| --- | --- |", *(f"| {name} | {item} |" for name, item in [*found, *self.made_up.items()])])

    def generate(self, prompts: list[str], schema: dict | None = None) -> list[str]:
        if schema is None:
            return [self._table(p) for p in prompts]
        cells = lambda p: [[c.strip() for c in line.strip("| ").split(" | ")] for line in p.partition("Table:\n")[2].splitlines()[2:]]
        return [json.dumps({"pii": [{"entity": c[0], "text": c[1]} for c in cells(p) if len(c) == 2]}) for p in prompts]
