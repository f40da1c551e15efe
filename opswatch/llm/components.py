"""Connected components of an edge table, by rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opswatch.session import cut_lineage


def _stars(edges: DataFrame, upward: bool) -> DataFrame:
    """Each node's neighbours above it (or those not above it and itself) tied to its least neighbour.

    The least neighbour is an aggregate that combines before the shuffle and is joined
    back, so a node with very many neighbours is never one task's group.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    near = both if upward else both.where("b < a")
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = near.join(least, "a")
    if upward:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least node) for every node of ``edges`` (long columns ``a``, ``b``).

    Rounds go on until nothing changes; their number grows with the logarithm of the longest chain.
    Every round is written to the checkpoint folder. Nothing is collected but two sums per round.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    now, before = cut_lineage(edges.select("a", "b").where("a <> b").distinct()), None
    while True:
        now = cut_lineage(_stars(_stars(now, True), False))
        state = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if before == (state["n"], state["x"]):
            break
        before = (state["n"], state["x"])
    # every remaining edge ties a node to the least of its component
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
