"""Recursive splitting of texts into chunks, and the pages that chunks span."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a text is cut, coarsest first (the last but one are zero-width, CJK and full-width marks).
SEPARATORS = ("\n\n", "\n", " ", ".", ",", "​", "，", "、", "．", "。", "")
#: Where a question is cut into fragments.
FRAGMENT_SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", ";", ",", " ")


def windows(lengths: Sequence[int], gap: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Stretches (first, end) of parts in a row, with gaps between them, that fit in ``size``: each as long as it can be, and beginning with the last parts of the one before that
    take at most ``overlap`` and leave room for the part that comes next. A part that is larger is a stretch by itself."""
    upto = [0, *accumulate(n + gap for n in lengths)]
    out, first = [], 0
    while first < len(lengths):
        # What a stretch takes is upto[end] - upto[first] - gap.
        end = max(first + 1, bisect_right(upto, size + gap + upto[first]) - 1)
        out.append((first, end))
        if end == len(lengths):
            break
        most = min(overlap, size - lengths[end] - gap)
        first = min(end, bisect_left(upto, upto[end] - gap - most, first)) if most >= 0 else end
    return out


def split_text(text: str, size: int, overlap: int, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters where the separators allow it, neighbours sharing up to ``overlap``: a text is cut at the coarsest separator that it has; short parts in a row are
    put together, others are cut again at finer ones."""
    level = next((k for k, s in enumerate(separators) if not s or s in text), len(separators))
    mark, finer = "".join(separators[level : level + 1]), separators[level + 1 :]
    parts = [p for p in text.split(mark) if p] if mark else list(text)
    out: list[str] = []
    for short, run in groupby(parts, key=lambda p: len(p) < size):
        row = list(run)
        if short:
            joined = (mark.join(row[a:b]).strip() for a, b in windows([len(p) for p in row], len(mark), size, overlap))
            out += [c for c in joined if c]
        else:
            out += [c for p in row for c in (split_text(p, size, overlap, finer) if finer else [p])]
    return out


def fragments_of(text: str, words: int = 2, separators: Sequence[str] = FRAGMENT_SEPARATORS) -> list[str]:
    """Pieces of at most ``words`` words, cut at the coarsest separators first."""
    plain = text.strip()
    if not plain:
        return []
    if len(plain.split()) <= words:
        return [plain]
    for k, s in enumerate(separators):
        if s in plain and s != " ":
            return [f for p in plain.split(s) for f in fragments_of(p, words, separators[k:])]
    tokens = plain.split()
    return [" ".join(tokens[i : i + words]) for i in range(0, len(tokens), words)]


def chunks(rows: DataFrame, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """A row for each chunk: the row's other columns, ``nth`` from 0 and ``content``."""

    @F.pandas_udf("array<string>")
    def cut_up(column: pd.Series) -> pd.Series:
        return pd.Series([split_text(t or "", size, overlap) for t in column], dtype=object)

    others = [c for c in rows.columns if c != text]
    return rows.select(*others, F.posexplode(cut_up(F.col(text))).alias("nth", "content"))


def fragments(rows: DataFrame, text: str, words: int = 2) -> DataFrame:
    @F.pandas_udf("array<string>")
    def cut_up(column: pd.Series) -> pd.Series:
        return pd.Series([fragments_of(t or "", words) for t in column], dtype=object)

    others = [c for c in rows.columns if c != text]
    return rows.select(*others, F.posexplode(cut_up(F.col(text))).alias("nth", "fragment"))


def page_range(pages: Column, chunk: Column) -> Column:
    """First and last page (from 1) that a chunk of the pages, joined by blank lines, spans; -1 without pages or place."""
    joined = F.array_join(pages, "\n\n")
    start = F.instr(joined, chunk) - 1
    end = start + F.length(chunk)
    state = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit(0).alias("page"))

    def step(s: Column, p: Column) -> Column:
        page, stop = s["page"] + 1, s["at"] + F.length(p) + 2
        first = F.when((s["first"] == -1) & (stop > start), page).otherwise(s["first"])
        last = F.when((s["last"] == -1) & (end - s["at"] <= F.length(p)), page).otherwise(s["last"])
        return F.struct(stop.alias("at"), first.alias("first"), last.alias("last"), page.alias("page"))

    found = F.aggregate(pages, state, step, lambda s: F.struct(s["first"].alias("start_page"), F.when(s["last"] == -1, s["page"]).otherwise(s["last"]).alias("end_page")))
    none = F.struct(F.lit(-1).alias("start_page"), F.lit(-1).alias("end_page"))
    return F.when((F.size(pages) > 0) & (start >= 0), found).otherwise(none)


def ranges_of(pages: Sequence[str], size: int = 1000, overlap: int = 200) -> list[tuple[int, int]]:
    """First and last page (from 1), as of ``page_range``, of each chunk of the pages joined by blank lines."""
    joined, at = "\n\n".join(pages), [0, *accumulate(len(p) + 2 for p in pages)]
    ends = [a + len(p) for a, p in zip(at, pages, strict=False)]
    out = []
    for chunk in split_text(joined, size, overlap):
        start = joined.find(chunk)
        found = (bisect_right(at, start), min(bisect_left(ends, start + len(chunk)) + 1, len(pages)))
        out.append(found if start >= 0 else (-1, -1))
    return out


def chunk_pages(rows: DataFrame, pages: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """A row for each chunk of the pages of a row, joined by blank lines: the row's other columns, ``nth`` from 0, ``start_page`` and ``end_page``. A row's pages are put together
    once, and no text goes with its chunks."""

    @F.pandas_udf("array<struct<start_page:int,end_page:int>>")
    def find(column: pd.Series) -> pd.Series:
        ranges = ([] if p is None else ranges_of(list(p), size, overlap) for p in column)
        return pd.Series([[{"start_page": a, "end_page": b} for a, b in r] for r in ranges], dtype=object)

    others = [c for c in rows.columns if c != pages]
    found = rows.select(*others, F.posexplode(find(F.col(pages))).alias("nth", "_p"))
    return found.select(*others, "nth", "_p.start_page", "_p.end_page")


def found_in_base64(text: Column, item: str) -> Column:
    """Whether an item stands, in any case, in what a run of base64 in the text decodes to; other bytes are ignored."""
    runs = F.regexp_extract_all(text, F.lit("[A-Za-z0-9+/]{20,}={0,2}"), F.lit(0))
    decoded = F.transform(runs, lambda r: F.regexp_replace(F.decode(F.try_to_binary(r, F.lit("base64")), "ISO-8859-1"), "[^\\x20-\\x7E]", ""))
    return F.exists(decoded, lambda d: F.coalesce(F.contains(F.lower(d), F.lit(item.lower())), F.lit(False)))
