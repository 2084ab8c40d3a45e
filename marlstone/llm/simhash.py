"""SimHash near-duplicates by the generalised pigeonhole principle.

Bits are grouped into parts so that correlated bits share one. A pair within ``radius`` bits is, for any
shares u_i >= 0 that add up to radius+1, within u_i - 1 bits in some part i (a share of 0 skips the part). Each
fingerprint gets the shares with the least estimated work, found by dynamic programming; it is probed
in each part with every value in reach and verified on all 64 bits. Equal fingerprints are one class
throughout, and what many classes share is compared in bounded blocks that return a spanning forest, so that a
group of near copies never becomes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read_table, text_of
from .components import components

RADIUS = 4
SHINGLE = 4
BITS = 64
#: Bits of a part that the counts behind the estimates look at.
SEEN_BITS = 12
#: Work of a probe row against that of comparing a candidate.
PROBE_COST = 20.0
#: Fingerprints with the same value in a part, on average.
MEMBERS = 48
#: Rows of either side in a block of a crowded value.
BLOCK = 8192
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a text."""
    words = text.encode().translate(_LOWER).split()
    return majority(shingle_hashes(words, shingle)) if words else 0


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """The hashes of the shingles of a text of one word or more."""
    import xxhash

    ends = list(accumulate(map(len, words), lambda end, n: end + 1 + n))
    starts, buffer = [0, *(e + 1 for e in ends)], b" ".join(words)
    digest, last = xxhash.xxh64_intdigest, min(shingle, len(words)) - 1
    return np.array([digest(buffer[a:b], 42) for a, b in zip(starts, ends[last:], strict=False)], dtype=np.uint64)


def majority(h: np.ndarray) -> int:
    """The signed number whose bits are those set in over half the hashes."""
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(h)).view(">i8")[0])


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (long) of every row of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64").to_numpy(), "fp": np.array([fingerprint(t, shingle) for t in b["text"]], dtype=np.int64)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInPandas(run, "doc_id long, fp long")


# ---------------------------------------------------------------- parts and shares


def _bits_of(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)


def _part_value(bits: np.ndarray, part: list[int]) -> np.ndarray:
    value = np.zeros(len(bits), dtype=np.int64)
    for k, bit in enumerate(part):
        value |= bits[:, bit].astype(np.int64) << k
    return value


def part_count(n: int, radius: int = RADIUS) -> int:
    """The most parts, up to one more than the radius, whose values have at most ``MEMBERS`` of n fingerprints on average."""
    return max([m for m in range(1, radius + 2) if n / 2 ** (BITS / m) <= MEMBERS], default=1)


def group_bits(n: int, pairs: np.ndarray, m: int) -> list[list[int]]:
    """m parts of about equal width, each grown from the most correlated bits left. pairs: how often two bits are both set."""
    p = np.diag(pairs) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs((pairs / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    left, parts = list(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        sub = tie[np.ix_(left, left)] - 2 * np.eye(len(left))
        part = [left[int(np.argmax(sub.max(axis=1)))]]
        while len(part) < width:
            rest = [b for b in left if b not in part]
            part.append(max(rest, key=lambda b: (tie[b, part].sum(), -b)))  # noqa: B023
        left = [b for b in left if b not in part]
        parts.append(sorted(part))
    return parts


def _reach(width: int, radius: int) -> np.ndarray:
    """All masks of up to ``radius`` bits, fewest bits first."""
    masks = [sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(width), k)]
    return np.array(masks, dtype=np.int64)


def estimates(counts: np.ndarray, width: int, radius: int) -> np.ndarray:
    """For each value of a part's first bits, the candidates expected within 0 to ``radius`` bits of the whole part."""
    seen = int(log2(counts.shape[0]))
    by_distance = np.zeros((radius + 1, counts.shape[0]))
    values = np.arange(counts.shape[0])
    for mask in _reach(seen, min(radius, 2)):  # beyond two bits the count is close to its mean
        by_distance[int(mask).bit_count()] += counts[values ^ mask]
    for k in range(3, radius + 1):
        by_distance[k] = comb(seen, k) * counts.sum() / counts.shape[0]
    rest = width - seen
    return np.array([sum(by_distance[a] * sum(comb(rest, b) for b in range(t - a + 1)) / 2**rest for a in range(t + 1)) for t in range(radius + 1)])


def allocate(costs: list[np.ndarray], radius: int) -> np.ndarray:
    """The shares of each fingerprint: (rows, parts), each row adding up to radius+1. costs: by part, (shares 0.., rows)."""
    rows = costs[0].shape[1]
    best, choice = np.full((radius + 2, rows), np.inf), []
    best[0] = 0
    for cost in costs:
        made, by = np.full_like(best, np.inf), np.zeros(best.shape, dtype=np.int8)
        for share in range(radius + 2):
            for s in range(radius + 2 - share):
                work = best[s] + cost[share]
                better = work < made[s + share]
                made[s + share][better] = work[better]
                by[s + share][better] = share
        best = made
        choice.append(by)
    shares, left, at = np.zeros((rows, len(costs)), dtype=np.int64), np.full(rows, radius + 1), np.arange(rows)
    for i in range(len(costs) - 1, -1, -1):
        shares[:, i] = choice[i][left, at]
        left = left - shares[:, i]
    return shares


# ---------------------------------------------------------------- links


def _forest(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (one of left, one of right) within the radius."""
    nodes, where = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = where[: len(left)], where[len(left) :]
    root = np.arange(len(nodes))
    out: list[tuple[int, int]] = []
    raw = nodes.view(np.uint64)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for at in range(0, len(a), 256):
        some = a[at : at + 256]
        i, j = np.nonzero(np.bitwise_count(raw[some][:, None] ^ raw[b][None, :]) <= radius)
        i, j = some[i], b[j]
        while len(i):
            keep = root[i] != root[j]
            i, j = i[keep], j[keep]
            done = min(len(i), 1024)
            for x, y in zip(i[:done].tolist(), j[:done].tolist(), strict=True):
                x_, y_ = find(x), find(y)
                if x_ != y_:
                    root[max(x_, y_)] = min(x_, y_)
                    out.append((int(nodes[x]), int(nodes[y])))
            i, j = i[done:], j[done:]
            while (up := root[root] != root).any():
                root[up] = root[root[up]]
    return out


def link_fingerprints(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints at ``radius`` or fewer bits, enough to connect all that are
    within reach of each other. ``fps``: distinct fingerprints in a column fp; other columns are not read."""
    spark, fps = fps.sparkSession, fps.select("fp")

    def pairs_set(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            bits = _bits_of(b["fp"].to_numpy(np.int64)).astype(np.float64)
            total, n = total + bits.T @ bits, n + len(bits)
        if n:
            yield pd.DataFrame({"at": np.arange(BITS * BITS + 1), "n": np.append(total.ravel(), n).astype(np.int64)})

    both = {r["at"]: r["n"] for r in fps.mapInPandas(pairs_set, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}  # 64 x 64 counts
    n = both.pop(BITS * BITS, 0)
    pairs = np.zeros(BITS * BITS)
    pairs[list(both)] = list(both.values())
    m = part_count(n, radius)
    parts = group_bits(n, pairs.reshape(BITS, BITS), m)

    def index_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            bits = _bits_of(fp)
            yield pd.DataFrame({"part": np.repeat(np.arange(m), len(fp)), "value": np.concatenate([_part_value(bits, p) for p in parts]), "x": np.tile(fp, m)})

    index = fps.mapInPandas(index_rows, "part int, value long, x long")
    seen = min(SEEN_BITS, min(map(len, parts)))
    tables = np.zeros((m, 1 << seen))
    for r in index.groupBy("part", F.col("value").bitwiseAND(F.lit((1 << seen) - 1)).alias("low")).count().collect():  # at most parts x 2^SEEN_BITS rows
        tables[r["part"], r["low"]] = r["count"]
    costs = []
    for t, p in zip(tables, parts, strict=True):
        probes = np.cumsum([comb(len(p), k) for k in range(radius + 1)])[:, None]
        costs.append(np.vstack([np.zeros(1 << seen), estimates(t, len(p), radius) + PROBE_COST * probes]))

    def probe_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reach: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for at in range(0, len(b), 5000):
                fp = b["fp"].to_numpy(np.int64)[at : at + 5000]
                bits = _bits_of(fp)
                values = [_part_value(bits, p) for p in parts]
                shares = allocate([c[:, v & ((1 << seen) - 1)] for c, v in zip(costs, values, strict=True)], radius)
                for i, v in enumerate(values):
                    for share in np.unique(shares[:, i]):
                        if share:
                            masks = reach.setdefault((len(parts[i]), share), _reach(len(parts[i]), int(share) - 1))
                            own = shares[:, i] == share
                            step = max(1, 500_000 // len(masks))
                            for k in range(0, int(own.sum()), step):
                                some, f = v[own][k : k + step], fp[own][k : k + step]
                                yield pd.DataFrame({"part": i, "value": (some[:, None] ^ masks[None, :]).ravel(), "q": np.repeat(f, len(masks))})

    probes = fps.mapInPandas(probe_rows, "part int, value long, q long")
    key = ["part", "value"]
    crowd = 16 + 2 * int(n / 2 ** (BITS / m))
    crowded = cut(index.groupBy(*key).agg(F.count("*").alias("members")).filter(F.col("members") > crowd))
    # Either of a pair finds the other, so it is enough that the larger does.
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("q"))) <= radius
    links = probes.join(index.join(crowded, key, "left_anti"), key).filter(near & (F.col("x") < F.col("q"))).select(F.col("x").alias("a"), F.col("q").alias("b"))
    if crowded.isEmpty():
        return links
    asked = crowded.join(probes.join(crowded, key, "left_semi").groupBy(*key).agg(F.count("*").alias("probes")), key)
    grid = cut(asked.select(*key, F.ceil(F.col("members") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("probes") / BLOCK).cast("int").alias("columns")))
    spread = lambda c, size: F.pmod(F.xxhash64(c), F.col(size)).cast("int")
    every = lambda size: F.explode(F.sequence(F.lit(0), F.col(size) - 1))
    members = index.join(grid, key).select(*key, spread("x", "rows").alias("r"), every("columns").alias("c"), F.col("x").alias("fp"), F.lit(True).alias("member"))
    askers = probes.join(grid, key).select(*key, every("rows").alias("r"), spread("q", "columns").alias("c"), F.col("q").alias("fp"), F.lit(False).alias("member"))

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        fp, member = rows["fp"].to_numpy(np.int64), rows["member"].to_numpy(bool)
        return pd.DataFrame(_forest(fp[member], fp[~member], radius), columns=["a", "b"], dtype="int64")

    return links.unionByName(members.unionByName(askers).groupBy(*key, "r", "c").applyInPandas(block, "a long, b long"))


# ---------------------------------------------------------------- operator


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (long) and component_id: the smallest doc_id reachable over links of ``radius`` or fewer bits.

    A row for each row of ``docs``. Texts without words (null or empty too) have fingerprint zero and are linked
    like any other; rows with a null doc_id take part and get their component's smallest id, null if it has none.
    Other columns are not read. An empty table gives no rows.
    """
    marked = cut(with_fingerprints(docs, shingle))
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(link_fingerprints(classes, radius), "a", "b")
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_class = named.join(lowest, "root").select(F.col("fp").alias("class_fp"), "component_id")
    return marked.join(by_class, marked["fp"] == by_class["class_fp"]).select("doc_id", "fp", "component_id")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all of ``documents``; see near_duplicates."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash_near_dedup": op9_simhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
