"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import materialise


def _state(edges: DataFrame) -> tuple:
    """Enough of the edges to see that a round changed none."""
    return tuple(
        edges.agg(
            F.count(F.lit(1)),
            F.bit_xor(F.xxhash64("u", "v")),
            F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31))),
        ).first()
    )


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node with an edge; the root is the smallest node it reaches.

    Each round connects every node's larger neighbours to its smallest one, then its
    smaller ones, until stars are left: a logarithmic number of rounds, each of
    aggregates and joins on nodes, whose hot keys adaptive execution splits. Every round
    is written, so lineage stays short. Loops, repeated edges and null ends are harmless.
    """
    edges = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u IS NOT NULL AND v IS NOT NULL AND u <> v AND u > v")
        .distinct()
    )
    edges = materialise(edges)
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        ends = F.array(
            F.struct(F.col("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
        )
        edges = materialise(moved.select(F.inline(ends)).where("u <> v").distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
