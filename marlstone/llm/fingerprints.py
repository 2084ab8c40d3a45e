"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text's terms are its five-word shingles, weighted by their counts. Every unit of a term's weight, told apart by its number, is
dealt by hash into one of ``SLOTS`` slots, so a heavy term is spread evenly over the slots, and of two texts the one where it
weighs less has its units among the other's: over all slots, the sums of the smaller and of the larger weights are those of the
whole texts. Every weighted term of a slot draws a gamma-based sample: with r and c from Gamma(2, 1) and b uniform, all fixed by
the hash of term and slot, t = floor(ln(w) / r + b) and ln a = ln c - r (t - b) - r. A slot keeps its smallest a; two texts keep
the same (term, t) there with a probability equal to the generalised Jaccard similarity of their weights in the slot. As the
slots get equal shares of the whole, the share of equal ones among those in use estimates the similarity of the whole. One sample
for each term of a slot, instead of one for each term and slot, is what makes the fingerprint affordable without Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read_table, text_of

SHINGLE = 5
SLOTS = 96
#: Bits below the slot's in a sample's code; ln a + 64 is held in units of 2^-48.
_LOW = 55
_UNIT = float(1 << 48)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def terms(text: Column, shingle: int = SHINGLE) -> Column:
    """Hashes of the text's shingles, repeats included; of the whole sequence if it has fewer words."""
    words = F.array_remove(F.split(text, "[\\x20\\t-\\r]+"), "")

    def shingles(h: Column) -> Column:
        joined = F.transform(F.slice(h, 1, F.greatest(F.size(h) - (shingle - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, shingle)]))
        return F.when(F.size(h) >= shingle, joined).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), shingles)


def _dealt(term: Column, unit: Column) -> Column:
    """The term and, in its lowest seven bits, the slot of the unit of this number."""
    return term.bitwiseAND(F.lit(-128)).bitwiseOR(F.pmod(F.xxhash64(term, unit), F.lit(SLOTS)))


def _sample(item: Column, weight: Column | None) -> Column:
    """Slot and ln a of a weighted term of a slot in one whole number, smaller for smaller a within the slot."""
    h, g = F.xxhash64(F.lit(1), item), F.xxhash64(F.lit(2), item)
    unit = lambda x, shift: (F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << 21) - 1)) + F.lit(0.5)) * F.lit(2.0**-21)
    b, c = unit(g, 22), -F.ln(unit(h, 1) * unit(g, 43))

    def code(r: Column) -> Column:
        t = F.lit(0.0) if weight is None else F.floor(F.ln(weight) / r + b)
        log_a = F.ln(c) - r * (t - b + 1)
        return F.shiftleft(item.bitwiseAND(F.lit(127)), _LOW) + F.floor((log_a + 64) * F.lit(_UNIT))

    r = -F.ln(unit(h, 43) * unit(h, 22))
    return code(r) if weight is None else let(r, code)


def _by_runs(s: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of each distinct value of a sorted array and of how often it is there."""
    ends = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == F.size(s)) | (F.get(s, i) != F.get(s, i - 1)))
    return let(ends, lambda e: F.transform(e, lambda at, k: body(F.get(s, at - 1), at - F.coalesce(F.get(e, F.when(k > 0, k - 1)), F.lit(0)))))


def slots(text: Column) -> Column:
    """The fingerprint of a text."""
    return slots_of(terms(text))


def slots_of(term_hashes: Column) -> Column:
    """The fingerprint of an array of terms, repeats included: for each of ``SLOTS`` slots a number from 1 to 32767 for what it keeps, or 0 if no term fell into it."""

    def codes(t: Column) -> Column:
        units = lambda s: F.flatten(_by_runs(s, lambda term, n: F.transform(F.sequence(F.lit(1), n), lambda k: _dealt(term, k))))
        weighted = lambda items: _by_runs(items, lambda item, n: _sample(item, n.cast("double")))
        repeated = F.size(F.array_distinct(t)) < F.size(t)
        once = let(F.transform(t, lambda x: _dealt(x, F.lit(1))), lambda items: F.transform(items, lambda x: _sample(x, None)))
        return F.when(repeated, let(F.sort_array(t), lambda s: let(F.sort_array(units(s)), weighted))).otherwise(once)

    def kept(s: Column) -> Column:
        slot = lambda x: F.shiftright(x, _LOW)
        first = F.filter(s, lambda x, i: (i == 0) | (slot(x) != slot(F.get(s, i - 1))))
        none = F.array().cast("array<smallint>")
        value = lambda x: (F.pmod(F.xxhash64(x), F.lit(32767)) + 1).cast("smallint")
        gap = lambda n: F.array_repeat(F.lit(0).cast("smallint"), n.cast("int"))
        step = lambda acc, x: F.struct((slot(x) + 1).cast("int").alias("at"), F.concat(acc["out"], gap(slot(x) - acc["at"]), F.array(value(x))).alias("out"))
        return F.aggregate(first, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: F.concat(acc["out"], gap(SLOTS - acc["at"])))

    return let(F.sort_array(let(term_hashes, codes)), kept)


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal slots among those in use by either; 1 for two texts without words."""
    used = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x > 0) | (y > 0)), lambda x: x))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x > 0) & (x == y)), lambda x: x))
    return F.when(used > 0, same / used).otherwise(F.lit(1.0))


# ---------------------------------------------------------------- each document and its next


def next_documents(rows: DataFrame) -> DataFrame:
    """(id, key, is_null, n_chars, next_id, next_key): each distinct document and the one after it by doc_id, the first
    after the last. Null ids come first; texts of one id are in the order of their keys.

    ``rows``: id (0 for null), key (of text and whether the id is null), is_null, n_chars. The ids alone are sorted, by range; the
    first of each range goes to the range before it."""
    keys = rows.groupBy("id", "key").agg(F.first("is_null").alias("is_null"), F.first("n_chars").alias("n_chars"))
    place = [F.desc("is_null"), F.asc("id"), F.asc("key")]
    dealt = cut(keys.repartitionByRange(max(2, rows.rdd.getNumPartitions()), *place).withColumn("part", F.spark_partition_id()))
    item = F.struct("id", "key")
    firsts = dealt.groupBy("part").agg(F.min_by(item, F.struct((~F.col("is_null")).alias("n"), "id", "key")).alias("first"))
    # A row for each range.
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = firsts.select("part", F.coalesce(F.lead("first").over(Window.orderBy("part")), F.first("first").over(whole)).alias("head"))
    after = F.coalesce(F.lead(item).over(Window.partitionBy("part").orderBy(*place)), F.col("head"))
    found = dealt.join(heads, "part").withColumn("after", after)
    return found.select("id", "key", "is_null", "n_chars", F.col("after.id").alias("next_id"), F.col("after.key").alias("next_key"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text is the text with its last floor(n/2) code points replaced by the first as many, or all, of the next
    document's. Null texts count as empty; a repeated row gives its result as often, and its next document is the next
    different one (itself if there is no other); other columns are not read. An empty table gives no rows.
    """
    doc_id = docs["doc_id"].cast("long")
    rows = docs.select(F.coalesce(doc_id, F.lit(0)).alias("id"), F.xxhash64(text_of(docs), doc_id.isNull()).alias("key"), doc_id.isNull().alias("is_null"), text_of(docs).alias("text"))
    order = cut(next_documents(rows.select("id", "key", "is_null", F.length("text").cast("long").alias("n_chars"))))
    texts = rows.select("id", "key", "text")
    # What each document lends to the one before it; the texts are dealt by (id, key) once for both joins.
    asked = order.select(F.col("id").alias("to_id"), F.col("key").alias("to_key"), F.expr("n_chars div 2").cast("int").alias("half"), "next_id", "next_key")
    lent = texts.join(asked, (F.col("id") == F.col("next_id")) & (F.col("key") == F.col("next_key"))).select("to_id", "to_key", F.expr("substring(text, 1, half)").alias("part"))
    own_half = F.expr("substring(text, 1, length(text) - length(text) div 2)")
    joined = texts.join(lent.dropDuplicates(["to_id", "to_key"]), (F.col("id") == F.col("to_id")) & (F.col("key") == F.col("to_key")))
    edited = joined.select("id", "key", "text", F.concat(own_half, F.col("part")).alias("edited"))
    made = cut(edited.select("id", "key", F.unhex(F.sha2(F.col("edited").cast("binary"), 256)).alias("edited_sha"), slots(F.col("text")).alias("own"), slots(F.col("edited")).alias("other")))
    following = made.select(F.col("id").alias("next_id"), F.col("key").alias("next_key"), F.col("own").alias("next_own")).dropDuplicates(["next_id", "next_key"])
    both = made.join(order, ["id", "key"]).join(following, ["next_id", "next_key"])
    return both.select(
        F.when(~F.col("is_null"), F.col("id")).alias("doc_id"), "n_chars", F.lower(F.hex("edited_sha")).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all of ``documents``; see fingerprint_documents."""
    return fingerprint_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {"op1_document_fingerprints": op1_document_fingerprints}
ORACLE_SQL: dict[str, str] = {}
