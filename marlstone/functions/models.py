"""Pluggable models with deterministic offline stand-ins.

A model is a plain object that Spark sends to its tasks; columns of texts go through it in Arrow batches.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class LanguageModel(Protocol):
    def generate(self, prompts: list[str], schema: dict | None = None) -> list[str]:
        """A reply to each prompt; with a schema, JSON of that form."""
        ...


class Tokenizer(Protocol):
    def count(self, texts: list[str]) -> list[int]: ...


class VocabularyFile:
    """Token counts by a tokenizer's file, which every machine must have at that path; it is read once in each Python worker."""

    def __init__(self, path: str):
        self.path = path

    def count(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in _tokenizer(self.path).encode_batch(texts, add_special_tokens=False)]


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer as Vocabulary

    return Vocabulary.from_file(path)


def counted(rows: DataFrame, text: str, into: str, tokenizer: Tokenizer) -> DataFrame:
    """``rows`` with the number of tokens of a text; none for a null one."""

    @F.pandas_udf("int")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series(tokenizer.count([t or "" for t in column]), dtype="int32")

    return rows.withColumn(into, F.coalesce(run(F.col(text)), F.lit(0)))


class HashingEmbedder:
    """Signed word hashing: each lower-cased word adds 1 to, or takes 1 from, the component that its MD5 names. Components are whole numbers, so scores do
    not depend on the order of sums; searches by cosine don't need unit vectors."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().encode().split():
                h = int.from_bytes(hashlib.md5(w).digest()[:4], "big")
                out[i, (h & 0x7FFFFFFF) % self.dimension] += 1 if h >> 31 else -1
        return out


class LastLine:
    """Answers with the prompt's last line that has words."""

    def generate(self, prompts: list[str], schema: dict | None = None) -> list[str]:
        return [next((x.strip() for x in reversed(p.splitlines()) if x.strip()), "") for p in prompts]


def embedded(rows: DataFrame, text: str, into: str, model: Embedder) -> DataFrame:
    """``rows`` with a vector column; an empty or null text has none."""

    @F.pandas_udf("array<float>")
    def run(column: pd.Series) -> pd.Series:
        vectors = model.embed([t or "" for t in column])
        return pd.Series([v if t and t.strip() else None for t, v in zip(column, vectors, strict=True)], dtype=object)

    return rows.withColumn(into, run(F.col(text)))


class ImageBytes:
    """Stand-in for an image model: a unit vector of the counts of the encoded bytes."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.stack([np.bincount(np.frombuffer(t.encode(), dtype=np.uint8) % self.dimension, minlength=self.dimension) for t in texts] or [np.zeros(self.dimension)]).astype(np.float32)
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9))[: len(texts)]


def multimodal_embedded(rows: DataFrame, parts: str, into: str, text_model: Embedder, image_model: Embedder) -> DataFrame:
    """``rows`` with the vector of a list of parts (structs of type and value, as content_parts gives): that of the last image if there is one, else
    that of all texts in a row; null without either."""
    values = lambda kind: F.transform(F.filter(parts, lambda p: p["type"] == kind), lambda p: p["value"])
    both = rows.withColumn("_text", F.array_join(values("text"), " ")).withColumn("_image", F.try_element_at(values("image_url"), F.lit(-1)))
    made = embedded(embedded(both, "_text", "_text_vector", text_model), "_image", "_image_vector", image_model)
    return made.withColumn(into, F.coalesce("_image_vector", "_text_vector")).drop("_text", "_image", "_text_vector", "_image_vector")


def re_embedded(rows: DataFrame, model: Embedder) -> DataFrame:
    """Every ``<field>_embeddings`` column made anew from its field."""
    for c in [c for c in rows.columns if c.endswith("_embeddings")]:
        rows = embedded(rows, c.removesuffix("_embeddings"), c, model)
    return rows


def replies(prompts: list[str | None], model: LanguageModel, schema: dict | None = None) -> list[str | None]:
    """The model's reply to each prompt; a null one is not asked and has none."""
    asked, out = [i for i, p in enumerate(prompts) if p is not None], [None] * len(prompts)
    more = {} if schema is None else {"schema": schema}
    for i, reply in zip(asked, model.generate([prompts[i] for i in asked], **more) if asked else [], strict=True):
        out[i] = reply
    return out


def generated(rows: DataFrame, prompt: str, into: str, model: LanguageModel, schema: dict | None = None) -> DataFrame:
    """``rows`` with the model's replies; a null prompt is not asked and has none."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series(replies(column.tolist(), model, schema), index=column.index, dtype=object)

    return rows.withColumn(into, run(F.col(prompt)))


def endpoint(key: Column, n: int) -> Column:
    """Which of n model endpoints serves a row: by hash, so that a retry goes to the same one."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
