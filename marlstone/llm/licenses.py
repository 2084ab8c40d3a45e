"""License scan: MinHash bands over overlapping windows find templates, exact shingle containment verifies them.

A template of n words is looked for in windows of n + s - 1 words or somewhat more, s = max(1, n // 4) apart from each text's start on, so some window holds all of any
copy of it. Where a share ``CONTAINED`` of the template's shingles is in the window, what both have is at least a share J of what either has, and the number of
bands (of one row each) is the least with 1 - (1 - J)^bands at or above ``SURE``. A retrieved template counts if a share
``CONTAINED`` of its shingles is in the window. Texts that are too short to hold that share are not looked at. Templates are statements, notices and whole licences.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib.resources import files
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_of
from .words import in_batches, mixed, words_of

SHINGLE = 5
CONTAINED = 0.8
SURE = 0.9999

#: What the licences ask to be quoted, and statements that name them.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-statement": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-statement": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def whole_licenses() -> dict[str, str]:
    """The texts of whole licences: the files of the package's folder of templates, by name."""
    return {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in sorted((files(__package__) / "templates").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}


def all_templates() -> dict[str, str]:
    return TEMPLATES | whole_licenses()


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k word hashes."""
    out = np.zeros(max(0, len(words) - k + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * np.uint64(0x100000001B3) + words[j : len(words) - k + 1 + j]
    return mixed(out)


def _permuted(h: np.ndarray, band: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(h + np.uint64(band) * np.uint64(0x9E3779B97F4A7C15)) if band else h


class Scanner:
    """Templates by number of words, with the windows and bands to find them."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, shingle: int = SHINGLE, contained: float = CONTAINED, sure: float = SURE):
        self.contained = contained
        self.classes: dict[int, list[tuple[str, np.ndarray]]] = {}
        #: By number of words: words of a shingle, the windows' distance and their size in such steps, and the bands.
        self.plan: dict[int, tuple[int, int, int, int]] = {}
        for name, text in templates.items():
            words = words_of([text]).hash
            if n := len(words):
                k = min(shingle, n)
                self.classes.setdefault(n, []).append((name, np.unique(shingle_hashes(words, k))))
        for n, own in self.classes.items():
            k, step = min(shingle, n), max(1, n // 4)
            steps = ceil((n - k + step) / step)
            few = min(len(s) for _, s in own)
            j = few * contained / (steps * step + few * (1 - contained))
            self.plan[n] = (k, step, steps, 1 if n == k else ceil(log(1 - sure) / log(1 - j)))
        self.lows = {name: [int(_permuted(s, b).min()) for b in range(self.plan[n][3])] for n, own in self.classes.items() for name, s in own}

    def scan(self, texts: list[str]) -> list[tuple[int, str, float, int, int]]:
        """Matches (text's number, template, containment, first word, words) of some texts; each text's are the same whatever others are scanned with it."""
        w = words_of(texts)
        first = np.cumsum(w.counts) - w.counts
        found: dict[tuple[int, str], tuple[float, int, int]] = {}
        hashed: dict[int, np.ndarray] = {}
        for n, templates in self.classes.items():
            k, step, steps, bands = self.plan[n]
            many = w.counts - k + 1
            long = np.flatnonzero(many >= max(1, min(len(own) for _, own in templates) * self.contained))
            if not len(long):
                continue
            if k not in hashed:
                hashed[k] = shingle_hashes(w.hash, k)
            # The shingles of the texts that are long enough, in blocks of a step from each text's start.
            size = many[long]
            begin = np.cumsum(size) - size
            shingles = hashed[k][np.repeat(first[long] - begin, size) + np.arange(size.sum())]
            blocks = -(-size // step)
            of = np.repeat(np.arange(len(long)), blocks)
            start = begin[of] + step * (np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
            near: dict[str, list[np.ndarray]] = {name: [] for name, _ in templates}
            for b in range(bands):
                low = np.minimum.reduceat(_permuted(shingles, b), start)
                least = low.copy()
                for j in range(1, min(steps, len(low))):
                    same = of[j:] == of[:-j]
                    least[:-j] = np.where(same, np.minimum(least[:-j], low[j:]), least[:-j])
                for name, _ in templates:
                    near[name].append(np.flatnonzero(least == np.uint64(self.lows[name][b])))
            for name, own in templates:
                for at in np.unique(np.concatenate(near[name])).tolist():
                    i = int(of[at])
                    hits = np.flatnonzero(np.isin(shingles[start[at] : min(start[at] + step * steps, begin[i] + size[i])], own)) + start[at]
                    share, t = len(np.unique(shingles[hits])) / len(own), int(long[i])
                    if share >= self.contained and share > found.get((t, name), (0.0,))[0]:
                        found[t, name] = share, int(hits[0] - begin[i]), int(hits[-1] - hits[0] + k)
        return [(t, name, *rest) for (t, name), rest in sorted(found.items())]


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, shingle: int = SHINGLE, contained: float = CONTAINED) -> DataFrame:
    """doc_id and licenses of every row: an array of template, containment, first_word and n_words, by template; of a
    template's windows in a text, the first with the largest share. Null and empty texts have none; rows with repeated
    or null ids are scanned one by one; other columns are not read. An empty table gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, shingle, contained)
        for b in batches:
            at = 0
            for some in in_batches(b["text"].tolist()):
                rows: list[list[dict]] = [[] for _ in some]
                for t, name, share, first, n in scanner.scan(some):
                    rows[t].append({"template": name, "containment": share, "first_word": first, "n_words": n})
                ids = b["doc_id"].iloc[at : at + len(some)].astype("Int64").reset_index(drop=True)
                at += len(some)
                yield pd.DataFrame({"doc_id": ids, "licenses": pd.Series(rows, dtype=object)})

    schema = "doc_id long, licenses array<struct<template:string,containment:double,first_word:long,n_words:long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInPandas(run, schema)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements, notices and whole texts of licences in all of ``documents``; see scan_licenses."""
    found = scan_licenses(read_table(spark, sf_dir, "documents"), all_templates())
    line = F.transform("licenses", lambda x: F.format_string("%s:%.4f:%d:%d", x["template"], x["containment"], x["first_word"], x["n_words"]))
    return found.select("doc_id", F.size("licenses").alias("n_licenses"), F.array_join(line, ",").alias("licenses"))


QUERIES = {"op7_license_scan": op7_license_scan}
ORACLE_SQL: dict[str, str] = {}
