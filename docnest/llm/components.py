"""Connected components of a graph given as edges, without gathering it anywhere.

Alternating star contractions: every vertex hands its larger neighbours (then its smaller ones) to the smallest
vertex it knows, until only stars are left. An edge is rewritten in place, so the number of edges never grows, and
a vertex with very many neighbours is a partial minimum and a join that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docnest.llm.frames import discard, stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One contraction of edges (u, v), u > v."""
    if small:
        near = edges  # u with its smaller neighbours
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        moved = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    else:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def _seen(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest of its component) of every node of edges (u, v); loops and repeated edges do no harm."""
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stored(ordered, "edges")
    state = _seen(now)
    while True:
        large = stored(_star(now, small=False), "edges")
        after = stored(_star(large, small=True), "edges")
        discard(now, large)
        now, before, state = after, state, _seen(after)
        if state == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
