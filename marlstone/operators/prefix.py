"""Running totals within ordered groups of any size, without a group in one task.

Rows are dealt by ranges of group and order, so a large group lies in many parts. Each part sums its rows; a group's sums
of earlier parts are the offsets of its later ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def dealt(rows: DataFrame, group: Sequence[str], order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """``rows`` by ranges of group and order, each with its part (``_part``), the parts in order; rows that tie are dealt by ``_tie``."""
    keys = [*group, *order, "_tie"]
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(parts, *keys) if parts else ranged.repartitionByRange(*keys)
    return cut(ranged.withColumn("_part", F.spark_partition_id()))


def running(rows: DataFrame, group: Sequence[str], order: Sequence[Column], parts: int | None = None, **totals: Column) -> DataFrame:
    """``rows`` with, for each named whole-number column, its total over the group's rows up to this one, this one included.

    A null value counts as 0, null groups are one group, and rows that tie in the order come in any order among themselves. Rows are
    shuffled twice and written once, so wide columns are better joined later. Only the offsets of groups that lie in
    several parts are broadcast: under two rows a part. Spark chooses the number of parts by the size, unless ``parts`` is given.
    """
    group, names = list(group), list(totals)
    ranged = dealt(rows.withColumns({f"_own_{n}": F.coalesce(c, F.lit(0)).cast("long") for n, c in totals.items()}), group, order, parts)
    sums = ranged.groupBy("_part", *group).agg(*[F.sum(f"_own_{n}").alias(f"_sum_{n}") for n in names])
    parts, before = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    split = sums.withColumns({"_parts": F.count("*").over(parts), **{f"_before_{n}": F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)) for n in names}}).filter("_parts > 1")
    offsets = split.select(F.col("_part").alias("_at"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], *[f"_before_{n}" for n in names])
    own = Window.partitionBy("_part", *group).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumns({f"_upto_{n}": F.sum(f"_own_{n}").over(own) for n in names})
    same = F.col("_part") == F.col("_at")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    found = summed.join(F.broadcast(offsets), same, "left")
    return found.select(*rows.columns, *[(F.col(f"_upto_{n}") + F.coalesce(f"_before_{n}", F.lit(0))).alias(n) for n in names])


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``rows`` with their number in the group's order, from 1; as ``running``."""
    return running(rows, group, order, **{name: F.lit(1)})
