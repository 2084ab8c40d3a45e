"""Mixing sources to target weights by systematic sampling.

Each document of a source is expected as often as its source's rate says, in fixed-point units. These are prefix-summed within the
source, from the shortest document to the longest, one random offset is added, and a document is emitted once for each whole
number that its stretch crosses. As expected and emitted copies never differ by one copy or more up to any document, and documents come by
size, a source's words miss its target by less than its longest document. Prefix sums are those of ``operators.prefix``: a source
of any size lies in many parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import numbered, running
from .common import cut, read_table

#: A word, as in the token rule of the other operators.
WORD = r"[^\x20\x09-\x0D]+"
#: No source is taken more than so many times.
MOST = 3
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: A copy in fixed-point units: rates are exact to 3e-8, and sums stay whole up to 1e11 documents of a source.
UNIT = 1 << 24
SEED = "mix"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, total: int, most: int = MOST) -> DataFrame:
    """``sources`` (source, weight, source_size and more) with ``target``: shares of ``total`` by weight; what goes beyond ``most`` times the
    source's size is shared among the others, until none is above. In order of size to weight the targets that are cut come first, so one
    pass of running sums finds the level of the rest. A source without words has target 0."""
    summed = running(sources, [], [(F.col("source_size") / F.col("weight")).asc(), F.asc_nulls_last("source")], _sizes=F.col("source_size"), _weights=F.col("weight"))
    summed = cut(summed.withColumn("_left", F.lit(total) - most * (F.col("_sizes") - F.col("source_size"))))
    weights = summed.agg(F.sum("weight").alias("w")).first()["w"] or 0
    level = F.col("_left").cast("double") / (F.lit(weights) - F.col("_weights") + F.col("weight"))
    cap = F.col("source_size").cast("double") * most
    fits = summed.filter(level * F.col("weight") <= cap * (1 + 1e-12)).agg(F.min(F.struct("_weights", level.alias("level"))).alias("first"))
    found = fits.first()["first"]
    return summed.withColumn("target", F.least(F.lit(found["level"] if found else 0.0) * F.col("weight"), cap)).drop("_sizes", "_weights", "_left")


def planned(sized: DataFrame, sources: DataFrame, order: list[Column], seed: str = SEED) -> DataFrame:
    """``sized`` (source, size and more) with its source's columns and ``copies``: how often the mix takes each row.

    sources: source (one row each, null for the null source), source_size, target. order: how rows of one source and size come; rows that tie in it too
    come in any order. Rows of a source without a target get 0."""
    by = sources.withColumnRenamed("source", "_of")
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT + 0.5)).otherwise(0)
    joined = sized.join(by, sized["source"].eqNullSafe(by["_of"]), "left").withColumn("_rate", F.coalesce(rate, F.lit(0)))
    upto = running(joined, ["source"], [F.asc("size"), *order], _upto=F.col("_rate"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 6), 16, 10).cast("long")
    whole = lambda x: F.shiftright(x + offset, UNIT.bit_length() - 1)
    return upto.withColumn("copies", whole(F.col("_upto")) - whole(F.col("_upto") - F.col("_rate"))).drop("_of", "_rate", "_upto")


def sources_of(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Each source with its documents' size and its weight: the weights by code point of the sources, null last, repeating."""
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = numbered(each, [], [F.asc_nulls_last("source")], "_nth")
    return nth.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_nth") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")).drop("_nth")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, weight, target and copies of every row of ``docs`` (doc_id, source, text; other columns are not read).

    Size: words of the text, 0 for a null or empty one, which the mix may take but which adds nothing. Targets share the size of all
    documents. A null source is a source of its own; rows with a null doc_id take part, last among their size. Repeated rows count each.
    Two runs agree: the offset is a hash of seed and source. An empty table gives no rows. Texts are read once and never shuffled.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"))
    sized = cut(narrow)
    sources = cut(sources_of(sized, weights))
    total = sources.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    return planned(sized, targets(sources, total, most), [F.asc_nulls_last("doc_id")], seed)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix_plan`` takes it, with ``copy`` from 0 (in place of a column of that name).

    Rows are told apart by doc_id, source and size; of rows that agree in all three (null ids too) each is emitted by the mean of
    their copies, the remainder by the first of them in an order by text."""
    plan = mix_plan(docs, weights, most, seed).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).filter("_copies > 0")
    plan = cut(plan.select(F.col("doc_id").alias("_id"), F.col("source").alias("_of"), F.col("size").alias("_size"), "_copies", "_rows"))
    sized = docs.withColumn("_words", words_in(F.col("text")))
    same = sized["doc_id"].cast("long").eqNullSafe(plan["_id"]) & sized["source"].cast("string").eqNullSafe(plan["_of"]) & (sized["_words"] == plan["_size"])
    names = [c for c in docs.columns if c != "copy"]
    single = sized.join(plan.filter("_rows = 1"), same).select(*names, F.col("_copies").alias("_take"))
    alike = sized.join(plan.filter("_rows > 1"), same)
    nth = numbered(alike.withColumn("_text", F.md5("text")), ["_id", "_of", "_size"], [F.asc("_text")], "_nth")
    share = F.floor(F.col("_copies") / F.col("_rows")) + (F.col("_nth") <= F.col("_copies") % F.col("_rows")).cast("long")
    taken = single.unionByName(nth.select(*names, share.alias("_take"))).filter("_take > 0")
    return taken.select(*names, F.explode(F.sequence(F.lit(0), (F.col("_take") - 1).cast("int"))).alias("copy"))


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents`` with weights 1, 2, 3, no source over 3 times its size; see mix_plan."""
    plan = mix_plan(read_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "source", "weight", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {"op11_source_mixing": op11_source_mixing}
ORACLE_SQL = {
    "op11_source_mixing": f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, encode(source) NULLS LAST) AS nth FROM w),
r AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(weight) OVER (ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM o),
l AS (SELECT arg_min(level, nth) AS level FROM r WHERE level * weight <= 3.0::DOUBLE * source_size * (1 + 1e-12::DOUBLE)),
t AS (SELECT o.*, least(l.level * weight, source_size::DOUBLE * 3) AS target FROM o, l),
e AS (SELECT t.*, CASE WHEN source_size > 0 THEN floor(target / source_size * {UNIT} + 0.5)::BIGINT ELSE 0 END AS rate,
  ('0x' || substr(md5('{SEED}:' || coalesce(source, '')), 1, 6))::BIGINT AS first FROM t),
p AS (SELECT d.doc_id, d.source, e.weight, d.size, e.source_size, e.target, e.rate, e.first + e.rate * row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS upto
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, weight, size, source_size, target, (upto // {UNIT} - (upto - rate) // {UNIT})::BIGINT AS copies, (upto // {UNIT} - (upto - rate) // {UNIT})::BIGINT * size AS taken FROM p"""
}
