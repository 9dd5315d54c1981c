"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    """Tells two sets of links apart; neither part grows with their number."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the smallest node
    reachable.

    Alternates two steps until nothing changes: every node passes its smallest neighbour to
    its larger neighbours, then to its smaller ones. Nodes with very many links never gather
    them in one place: the smallest neighbour is a combined aggregate, and passing it on is a
    join that AQE may split. Links from a node to itself and nulls are left out.
    """
    edges = cut_lineage(links.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("u"), "v").distinct()
    return edges.union(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
