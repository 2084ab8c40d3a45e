"""Vector codes: each of ``PARTS`` consecutive parts of a vector is replaced by the nearest entry of its position's codebook.

Rows are gathered into chunks of bounded size. In a chunk, the parts of each position are sorted along a Hilbert curve and cut into flat
blocks that store a box (least and greatest components) and their sums. In a round, an entry that is farther from a block's box than another is at most
is off the block's shortlist; a block with one entry left goes to it whole by its stored sums, and the others are evaluated by exact
integer kernels against their shortlists. Chunks are written once to the shared folder and read each round; what leaves a task
are sums for each position and entry, so only codebooks (``PARTS`` x ``ENTRIES`` entries) reach the driver and go to the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read_table
from .topk import usable

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Whole components are held within this, so that sums of squares of 2,047 components stay exact in 64 bits. It is over a hundred thousand times a unit vector's.
LARGEST = 1 << 25
#: Components of a chunk, and rows of a block.
CHUNK = 1 << 20
BLOCK = 64

_STORED = "vec_ids binary, known binary, labels binary, labelled binary, rows int, x binary, places binary, low binary, high binary, sums binary"


def cuts(length: int) -> list[int]:
    """Where the parts of a vector begin and the last ends; of a length that ``PARTS`` does not divide the first parts have one component more."""
    width, more = divmod(length, PARTS)
    return [i * width + min(i, more) for i in range(PARTS + 1)]


def whole(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64)


def hilbert_keys(x: np.ndarray) -> np.ndarray:
    """The place of each row of whole numbers along a Hilbert curve through their box: up to 8 bits of each of the first 62 components."""
    x = x[:, :62]
    n, dims = x.shape
    if not n or not dims:
        return np.zeros(n, dtype=np.int64)
    bits = max(1, min(8, 62 // dims))
    low, span = x.min(axis=0), np.maximum(x.max(axis=0) - x.min(axis=0), 1)
    axes = ((x - low) * ((1 << bits) - 1) // span).T.copy()
    # Undo the rotations of the curve's cells, from the coarsest bit down, then read the axes as a Gray code.
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i in range(dims):
            high = (axes[i] & bit) != 0
            exchanged = np.where(high, 0, (axes[0] ^ axes[i]) & below)
            axes[0] ^= np.where(high, below, exchanged)
            axes[i] ^= exchanged
    for i in range(1, dims):
        axes[i] ^= axes[i - 1]
    turn = np.zeros(n, dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> level) & 1, (1 << level) - 1, 0)
    axes ^= turn
    key = np.zeros(n, dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | ((axis >> level) & 1)
    return key


class Chunk:
    """The parts of one position in a chunk: x sorted along the curve, the rows' places, and each block's box and sums."""

    def __init__(self, x: np.ndarray, places: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.x, self.places, self.low, self.high, self.sums = x, places, low, high, sums

    @classmethod
    def of(cls, x: np.ndarray) -> Chunk:
        places = np.argsort(hilbert_keys(x), kind="stable")
        x = x[places]
        first = np.arange(0, len(x), BLOCK)
        return cls(x, places, np.minimum.reduceat(x, first), np.maximum.reduceat(x, first), np.add.reduceat(x, first))

    def coded(self, book: np.ndarray, codes: np.ndarray | None = None, errors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Counts and sums of the parts nearest to each entry; codes and errors, where given, are filled and added to by row."""
        n, k = len(self.x), len(book)
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros_like(book)
        least, most = np.zeros((len(self.low), k), dtype=np.int64), np.zeros((len(self.low), k), dtype=np.int64)
        for d in range(book.shape[1]):
            under, over = self.low[:, d, None] - book[None, :, d], book[None, :, d] - self.high[:, d, None]
            least += np.maximum(np.maximum(under, over), 0) ** 2
            most += np.maximum(np.abs(under), np.abs(over)) ** 2
        short = least <= most.min(axis=1)[:, None]
        alone = short.sum(axis=1) == 1
        sizes = np.minimum(BLOCK, n - np.arange(len(self.low)) * BLOCK)
        only = short.argmax(axis=1)
        np.add.at(counts, only[alone], sizes[alone])
        np.add.at(sums, only[alone], self.sums[alone])
        nearest, far = np.repeat(only, sizes), np.zeros(n, dtype=np.int64)
        for b in np.flatnonzero(~alone):
            entries, at = np.flatnonzero(short[b]), slice(b * BLOCK, b * BLOCK + sizes[b])
            apart = np.zeros((sizes[b], len(entries)), dtype=np.int64)
            for d in range(book.shape[1]):
                apart += (self.x[at, d, None] - book[None, entries, d]) ** 2
            nearest[at] = entries[apart.argmin(axis=1)]
        open_ = ~np.repeat(alone, sizes)
        np.add.at(counts, nearest[open_], 1)
        np.add.at(sums, nearest[open_], self.x[open_])
        if codes is not None:
            far = ((self.x - book[nearest]) ** 2).sum(axis=1)
            codes[self.places] = nearest
            errors[self.places] += far
        return counts, sums


def _stored(vec_ids: list, labels: list, vectors: np.ndarray) -> dict:
    ids = np.array([0 if i is None else i for i in vec_ids], dtype=np.int64)
    named = np.array([0 if x is None else x for x in labels], dtype=np.int64)
    at, x = cuts(vectors.shape[1]), whole(vectors)
    parts = [Chunk.of(x[:, a:b]) for a, b in zip(at, at[1:], strict=False)]
    joined = lambda name, kind: b"".join(getattr(p, name).astype(kind).tobytes() for p in parts)
    return {
        "vec_ids": ids.tobytes(), "known": np.array([i is not None for i in vec_ids]).tobytes(), "labels": named.tobytes(), "labelled": np.array([x is not None for x in labels]).tobytes(),
        "rows": len(ids), "x": joined("x", np.int32), "places": joined("places", np.int32), "low": joined("low", np.int32), "high": joined("high", np.int32), "sums": joined("sums", np.int64),
    }


def _read(row, length: int) -> list[Chunk]:
    n, at = row["rows"], cuts(length)
    blocks = -(-n // BLOCK)
    take = lambda name, kind, many, p: np.frombuffer(row[name], dtype=kind)[many * at[p] : many * at[p + 1]].reshape(many, at[p + 1] - at[p]).astype(np.int64)
    places = np.frombuffer(row["places"], dtype=np.int32).reshape(PARTS, n)
    return [Chunk(take("x", np.int32, n, p), places[p], take("low", np.int32, blocks, p), take("high", np.int32, blocks, p), take("sums", np.int64, blocks, p)) for p in range(PARTS)]


def chunks(vectors: DataFrame, length: int) -> DataFrame:
    """The stored chunks of vectors (vec_id, label, embedding) of that length."""
    at_once = max(BLOCK, CHUNK // max(length, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, rows, held = [], [], [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_stored(ids, labels, np.concatenate(rows))], schema=_ARROW)

        for b in batches:
            flat = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
            for k in range(0, b.num_rows, at_once):
                some = flat[k : k + at_once]
                if held and held + len(some) > at_once:
                    yield made()
                    ids, labels, rows, held = [], [], [], 0
                ids += b.column(0)[k : k + at_once].to_pylist()
                labels += b.column(1)[k : k + at_once].to_pylist()
                rows.append(some)
                held += len(some)
        if held:
            yield made()

    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, _STORED)


_ARROW = pa.schema([(n, pa.int32() if k == "int" else pa.binary()) for n, k in (c.split() for c in _STORED.split(", "))])


def first_entries(kept: DataFrame) -> list[np.ndarray]:
    """Each position's first entries: the parts of the vectors with the smallest ids, a null id last. Of several vectors of an id the one
    that sorts first counts. ``ENTRIES`` vectors go to the driver."""
    ids = kept.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(ENTRIES).withColumnRenamed("vec_id", "_id")
    rows = kept.join(F.broadcast(ids), kept["vec_id"].eqNullSafe(F.col("_id")), "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("v")).orderBy(F.asc_nulls_last("vec_id")).collect()
    x = whole(np.array([r["v"] for r in rows], dtype=np.float64))
    at = cuts(x.shape[1])
    return [x[:, a:b].copy() for a, b in zip(at, at[1:], strict=False)]


def _next(stored: DataFrame, books: list[np.ndarray], length: int) -> list[np.ndarray]:
    """The codebooks after a round."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, sums = [np.zeros(len(b), dtype=np.int64) for b in books], [np.zeros_like(b) for b in books]
        for batch in batches:
            for row in batch.to_dict("records"):
                for p, part in enumerate(_read(row, length)):
                    c, s = part.coded(books[p])
                    counts[p] += c
                    sums[p] += s
        got = [(p, e, int(counts[p][e]), sums[p][e]) for p in range(PARTS) for e in np.flatnonzero(counts[p])]
        yield pd.DataFrame(got, columns=["part", "entry", "n", "s"])

    found = stored.select("rows", "x", "places", "low", "high", "sums").mapInPandas(run, "part int, entry int, n long, s array<long>")
    each = found.select("part", "entry", "n", F.posexplode("s").alias("d", "s")).groupBy("part", "entry", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = [b.copy() for b in books]
    for r in each.collect():  # at most PARTS x ENTRIES entries
        out[r["part"]][r["entry"], r["d"]] = r["s"] // r["n"]
    return out


def _assigned(stored: DataFrame, books: list[np.ndarray], length: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                n = row["rows"]
                codes, errors = np.zeros((PARTS, n), dtype=np.uint8), np.zeros(n, dtype=np.int64)
                for p, part in enumerate(_read(row, length)):
                    part.coded(books[p], codes[p], errors)
                digits = np.ascontiguousarray(codes.T).tobytes().hex()
                known, labelled = np.frombuffer(row["known"], dtype=bool), np.frombuffer(row["labelled"], dtype=bool)
                yield pd.DataFrame({
                    "vec_id": pd.array(np.frombuffer(row["vec_ids"], dtype=np.int64), dtype="Int64"), "label": pd.array(np.frombuffer(row["labels"], dtype=np.int64), dtype="Int64"),
                    "code": [digits[k : k + 2 * PARTS] for k in range(0, len(digits), 2 * PARTS)], "error": errors,
                }).assign(vec_id=lambda x, known=known: x["vec_id"].where(known), label=lambda x, labelled=labelled: x["label"].where(labelled))

    return stored.mapInPandas(run, "vec_id long, label long, code string, error long")


def vector_codes(vectors: DataFrame) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code and error of every usable row of ``vectors`` (vec_id, embedding, label; other columns are not read), and the
    final codebooks.

    Rows whose vector is null or holds null or non-finite components are left out, repeated rows count each, and a null vec_id or label is
    kept. The length is that of the vector with the smallest id that has components; vectors of other lengths, empty ones too, are kept
    with null code and error and take no part in the codebooks. Components beyond ``LARGEST`` count as that. With fewer
    than ``ENTRIES`` ids the codebooks have as many entries. An empty table gives no rows and no codebooks."""
    fine = F.col("embedding").isNotNull() & (usable(F.col("embedding")) | (F.size("embedding") == 0))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").filter(fine)
    first = kept.filter(F.size("embedding") > 0).orderBy(F.asc_nulls_last("vec_id"), "embedding").select(F.size("embedding").alias("n")).first()
    none = F.lit(None)
    if first is None:
        return kept.select("vec_id", "label", none.cast("string").alias("code"), none.cast("long").alias("error")), []
    length = first["n"]
    alike = kept.filter(F.size("embedding") == length)
    books = first_entries(alike)
    stored = cut(chunks(alike, length))
    for _ in range(ROUNDS):
        books = _next(stored, books, length)
    others = kept.filter(F.size("embedding") != length).select("vec_id", "label", none.cast("string").alias("code"), none.cast("long").alias("error"))
    return _assigned(stored, books, length).unionByName(others), books


def decoded(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``codes`` with ``approximation``: the vector that the code stands for, as whole numbers; null for a null code."""
    tables = [F.array(*[F.array(*[F.lit(int(x)) for x in entry]) for entry in b]) for b in books]
    entry = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + 1
    parts = [F.element_at(t, entry(p)) for p, t in enumerate(tables)]
    return codes.withColumn("approximation", F.when(F.col("code").isNotNull(), F.concat(*parts)) if parts else F.lit(None).cast("array<int>"))


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of all ``embeddings``; see vector_codes. label_error: the error summed over equal labels, null ones together."""
    found, books = vector_codes(read_table(spark, sf_dir, "embeddings"))
    coded = cut(found)
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    named = coded.join(sums, coded["label"].eqNullSafe(sums["_label"]))
    return named.select("vec_id", "label", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _sql() -> str:
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""
n{r} AS (SELECT id, part, min(d * {ENTRIES} + entry) AS best FROM (
  SELECT p.id, p.part, e.entry, list_sum(list_transform(list_zip(p.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN e{r} e USING (part)) GROUP BY id, part)""")
        if r < ROUNDS:
            steps.append(f"""
m{r} AS (SELECT part, entry, list(s ORDER BY j) AS v FROM (
  SELECT n.part, n.best % {ENTRIES} AS entry, j, floor(sum(p.v[j]) / count(*))::BIGINT AS s FROM n{r} n JOIN p USING (id, part), range(1, len(p.v) + 1) t(j) GROUP BY 1, 2, 3) GROUP BY part, entry),
e{r + 1} AS (SELECT e.part, e.entry, coalesce(m.v, e.v) AS v FROM e{r} e LEFT JOIN m{r} m USING (part, entry))""")
    return f"""
WITH k AS (SELECT row_number() OVER () AS id, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT id, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS v FROM k, range({PARTS}) t(part)),
f AS (SELECT id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < {ENTRIES}),
e0 AS (SELECT p.part, f.entry, p.v FROM p JOIN f USING (id)),{",".join(steps)},
c AS (SELECT id, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY part) AS code, sum(best // {ENTRIES})::BIGINT AS error FROM n{ROUNDS} GROUP BY id),
b AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM e{ROUNDS})
SELECT vec_id, label::BIGINT AS label, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN c USING (id), b"""


QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLE_SQL = {"op12_vector_codes": _sql()}
