"""Connected components of an edge table by alternating large and small stars.

Labels are the smallest node of a component. All state is in tables in the shared folder; the driver sees two
numbers per round. Stars keep their neighbours' minimum by a map-side combined aggregate; the join that follows is
a plain sort-merge join of two stored tables, so a centre with very many neighbours can be split at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over undirected edges (u, v), u > v, without loops."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")))
    joined = both.join(least, both["u"] == least["k"])
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component for every node that has an edge. ``edges``: two long columns u and v; loops and nulls are ignored."""
    state = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        row = state.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        now = (row["n"], row["x"])
        if now == mark or not row["n"]:
            break
        mark = now
        state = cut(_star(_star(state, True), False))
    # at rest every edge leads from a node to its component's smallest node
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
