"""Near copies by exact Jaccard similarity over sets of five-word shingles.

Candidates are first the links of SimHash fingerprints over the same shingles, by the generalised pigeonhole search of ``simhash``, and then what
shares a band of MinHash values: SimHash alone would need a radius of over ten bits for pairs at a similarity of ``LEAST``, while such a pair
shares none of the ``BANDS`` with a probability of 3e-5, more similar ones with less. Every link is verified by the sets themselves.
Equal texts are one class throughout. The members of a band meet in bounded blocks that hold each set once; there, pairs are found by the rarest
members of their sets, so that a passage that many texts share brings no pairs by itself, and a block returns its components. Fingerprints' pairs are looked at after that,
where bands have not joined their texts yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of
from .components import components
from .simhash import _LOWER, link_fingerprints, majority, shingle_hashes
from .words import mixed

SHINGLE = 5
#: The least similarity of a link, as a fraction.
LEAST = (4, 5)
BANDS = 20
#: MinHash values of a band.
ROWS = 4
#: Members of the sets of a slot of a band, or of small bands that are looked at together.
VOLUME = 1 << 20

#: So many keys go to the tasks as a broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 500_000

_TURNS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_AT_ONCE = 1 << 13


def shingle_set(text: str) -> np.ndarray:
    """The sorted hashes of a text's shingles; a text under five words is one shingle, one without words is zero."""
    return np.unique(_hashes(text))


def _hashes(text: str) -> np.ndarray:
    words = text.encode().translate(_LOWER).split()
    return shingle_hashes(words, SHINGLE) if words else np.zeros(1, dtype=np.uint64)


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """One number a band, which holds the band's place too."""
    with np.errstate(over="ignore"):
        least = np.min([(_TURNS[:, None] * shingles[None, at : at + _AT_ONCE]).min(axis=1) for at in range(0, len(shingles), _AT_ONCE)], axis=0)
        value = np.arange(1, BANDS + 1, dtype=np.uint64)
        for column in least.reshape(BANDS, ROWS).T:
            value = mixed(value ^ column)
    return value.view(np.int64)


def _enough(shared, a, b):
    """Whether sets of a and b members that share so many are similar enough."""
    return shared * (LEAST[0] + LEAST[1]) >= (a + b) * LEAST[0]


def _signed(rows: DataFrame) -> DataFrame:
    """key, the size n of its set, its MinHash bands, and its SimHash fingerprint fp."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [(len(s := np.unique(h)), bands_of(s), majority(h)) for h in map(_hashes, b["text"])]
            yield pd.DataFrame({"key": b["key"], "n": np.array([m[0] for m in made], dtype=np.int64), "bands": [m[1] for m in made], "fp": np.array([m[2] for m in made], dtype=np.int64)})

    return rows.select("key", "text").mapInPandas(run, "key long, n long, bands array<long>, fp long")


def _by_fingerprint(signed: DataFrame) -> DataFrame:
    """(a, b), structs of key and n: of each fingerprint its texts with the one of the smallest key, and those of linked fingerprints."""
    classes = cut(signed.groupBy("fp").agg(F.min(F.struct("key", "n")).alias("first")))
    same = signed.join(classes, "fp").select(F.struct("key", "n").alias("a"), F.col("first").alias("b"))
    side = lambda end: classes.select(F.col("fp").alias(end), F.col("first").alias(f"first_{end}"))
    linked = link_fingerprints(classes).join(side("a"), "a").join(side("b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    return same.unionByName(linked)


def _sets(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 200):
                some = b.iloc[at : at + 200]
                yield pd.DataFrame({"key": some["key"], "shingles": [shingle_set(t).view(np.int64) for t in some["text"]]})

    return rows.select("key", "text").mapInPandas(run, "key long, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    side = lambda end: sets.select(F.col("key").alias(end), F.col("shingles").alias(f"set_{end}"))
    shared = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(_enough(shared, F.size("set_a"), F.size("set_b"))).select("a", "b")


def _forest(keys: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """The components of the similar pairs of one of left and one of right (places among the keys), as stars: (key, the least key of its component).

    With the members of each set in one order, the rarest here first, a similar pair's first common member stands within the first ninth of
    the smaller set and the first fifth of the larger: what follows it must hold the whole overlap. Only pairs that meet so are counted in full."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(sets)), size)
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    often = np.bincount(number)
    order = np.empty(len(often), dtype=np.int64)
    order[np.argsort(often, kind="stable")] = np.arange(len(often))
    token = order[number]
    token = token[np.lexsort((token, owner))]
    place = np.arange(len(token)) - first[owner]
    asked = np.zeros(len(sets), dtype=bool)
    asked[right] = True
    index = {}
    for share in (9, 5):
        at = np.flatnonzero((place <= size[owner] // share) & asked[owner])
        at = at[np.argsort(token[at], kind="stable")]
        index[share] = at, token[at]
    mark, root = np.zeros(len(often), dtype=np.int64), np.arange(len(keys))
    for i in left:
        if (root[right] == root[i]).all():
            continue
        met = []
        for own_share, other_share in ((9, 5), (5, 9)):
            own = np.arange(first[i], min(first[i] + size[i] // own_share + 1, first[i + 1]))
            at, tokens = index[other_share]
            low = np.searchsorted(tokens, token[own], "left")
            many = np.searchsorted(tokens, token[own], "right") - low
            hit = at[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())]
            j = owner[hit]
            rest = np.minimum(size[i] - np.repeat(place[own], many), size[j] - place[hit])
            larger = size[j] >= size[i] if own_share == 9 else size[j] < size[i]
            met.append(j[larger & (root[j] != root[i]) & _enough(rest, size[i], size[j])])
        met = np.unique(np.concatenate(met))
        if not len(met):
            continue
        starts = np.cumsum(size[met]) - size[met]
        members = token[np.repeat(first[met] - starts, size[met]) + np.arange(size[met].sum())]
        mark[token[first[i] : first[i + 1]]] = 1
        shared = np.add.reduceat(mark[members], starts)
        mark[token[first[i] : first[i + 1]]] = 0
        for j in met[_enough(shared, size[i], size[met])]:
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
    least = np.full(len(keys), np.iinfo(np.int64).max)
    np.minimum.at(least, root, keys)
    return [(a, b) for a, b in zip(keys.tolist(), least[root].tolist(), strict=True) if a != b]


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    """The components of the bands in a block: of a small band among its members, of a large one between two of its slots."""
    out: list[tuple[int, int]] = []
    keys, slot, r, c = rows["key"].to_numpy(np.int64), rows["slot"].to_numpy(), rows["r"].to_numpy(), rows["c"].to_numpy()
    for at in rows.groupby("value").indices.values():
        left, right = np.flatnonzero(slot[at] == r[at]), np.flatnonzero(slot[at] == c[at])
        if len(left) and len(right) and len(at) > 1:
            out += _forest(keys[at], [np.asarray(rows["shingles"].iat[k], dtype=np.int64) for k in at], left, right)
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _blocks(bands: DataFrame, sets: DataFrame) -> DataFrame:
    """Links within bands. bands: value, key, and ``volume``, the size of all the band's sets.

    A band of up to ``VOLUME`` goes to a block with others, each of its sets once; a larger one is dealt into slots of that size, and every two slots meet in a block."""
    slots = F.ceil(F.col("volume") / VOLUME).cast("int")
    small = bands.filter(slots == 1).agg(F.sum("n").alias("n")).first()["n"] or 0
    few = 1 + 2 * small // VOLUME
    together = F.when(slots > 1, F.col("value")).otherwise(F.pmod(F.xxhash64("value"), F.lit(few)))
    dealt = bands.select("value", "key", together.alias("together"), slots.alias("slots"), F.pmod(F.xxhash64("key", "value"), slots).cast("int").alias("slot"))
    other = F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("other")
    cells = dealt.select("*", other).select("value", "key", "together", "slot", F.least("slot", "other").alias("r"), F.greatest("slot", "other").alias("c"), (F.col("slots") > 1).alias("large"))
    return cells.join(sets, "key").groupBy("large", "together", "r", "c").applyInPandas(_block, "a long, b long")


def _needed(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The sets of some keys."""
    keys = cut(keys)
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    return cut(_sets(rows.join(keys, "key", "left_semi")).dropDuplicates(["key"]))


def near_texts(docs: DataFrame) -> DataFrame:
    """doc_id and component_id: the smallest doc_id reachable over links of texts of a Jaccard similarity of 0.8 or more.

    A row for each row of ``docs``. Texts without words (null or empty too) are alike; rows with a null doc_id take part
    and get their component's smallest id, null if it has none. Other columns are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).withColumn("key", F.xxhash64("text"))
    signed = cut(_signed(rows).dropDuplicates(["key"]))
    entries = signed.select("key", "n", F.explode("bands").alias("value"))
    members = (F.count("*").alias("m"), F.bit_xor("key").alias("x"), F.sum(F.pmod(F.xxhash64("key"), F.lit(1 << 40))).alias("s"), F.sum("n").alias("volume"))
    # Bands of the same members are one.
    bands = entries.groupBy("value").agg(*members).filter("m > 1").groupBy("m", "x", "s", "volume").agg(F.min("value").alias("value")).select("value", "volume")
    shared = cut(entries.join(bands, "value"))
    links = cut(_blocks(shared, _needed(rows, shared.select("key").distinct())))
    # Of the pairs by fingerprint only those that no band has joined outright, and whose sizes allow it.
    labels = links.groupBy("a").agg(F.min("b").alias("b"))
    end = lambda name: labels.select(F.col("a").alias(name), F.col("b").alias(f"root_{name}"))
    near = _by_fingerprint(signed.select("key", "n", "fp")).filter((F.col("a.key") != F.col("b.key")) & _enough(F.least("a.n", "b.n"), F.col("a.n"), F.col("b.n")))
    near = near.select(F.least("a.key", "b.key").alias("a"), F.greatest("a.key", "b.key").alias("b")).distinct().join(end("a"), "a", "left").join(end("b"), "b", "left")
    near = cut(near.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"))
    links = links.unionByName(_verified(near, _needed(rows, near.select(F.explode(F.array("a", "b")).alias("key")).distinct())))
    roots = components(links, "a", "b")
    classes = rows.groupBy("key").agg(F.min("doc_id").alias("first_id"))
    named = cut(classes.join(roots, classes["key"] == roots["node"], "left").select("key", "first_id", F.coalesce("root", "key").alias("root")))
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_class = named.join(lowest, "root").select(F.col("key").alias("class_key"), "component_id")
    marked = rows.select("doc_id", "key")
    return marked.join(by_class, marked["key"] == by_class["class_key"]).select("doc_id", "component_id")
