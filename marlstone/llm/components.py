"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _lowest(edges: DataFrame) -> DataFrame:
    """(u, v) with the smallest of u and its neighbours v beside it; joined, so that a hub's rows can be split."""
    low = edges.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("hub"), F.least("u", "low").alias("low"))
    return edges.join(low, edges["u"] == low["hub"]).select("u", "v", "low")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _lowest(both).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges lead from the larger to the smaller end here."""
    low = _lowest(edges)
    down = low.filter("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return down.unionByName(low.select("u", F.col("low").alias("v"))).filter("u != v").distinct()


#: Rows of an edge table that a task reads.
ROWS_A_TASK = 100_000


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): each linked node with the smallest node of its component. Self-links, repeats and
    either direction are allowed, null ends are left out; nodes without links give no rows.

    Rounds end once every edge leads from a node with no other to one that leads nowhere."""
    known = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = cut(known.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct())
    while True:
        ends = edges.select(F.col("u").alias("node"), F.col("v").alias("to")).unionByName(edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("to")))
        each = ends.groupBy("node").agg(F.count("to").alias("out"), F.count_if(F.col("to").isNull()).alias("in"))
        state = each.agg(F.sum("out").alias("n"), F.max((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("in") > 0))).alias("open")).first()
        if not state["open"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        edges = cut(_small_star(_large_star(edges.coalesce(1 + state["n"] // ROWS_A_TASK))))
