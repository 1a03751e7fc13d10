"""Connected components over an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.workspace import materialise


def _least(edges: DataFrame) -> DataFrame:
    """(src, low): the least neighbour of each source. The key is an expression, so that a join shuffles both of its sides and can split a hub's rows."""
    least = edges.groupBy("src").agg(F.min("dst").alias("low"))
    return least.select(F.col("src").bitwiseOR(F.lit(0).cast("long")).alias("src"), "low")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (src, dst); root is the least node.

    Each round points all larger neighbours of a node at its least neighbour,
    then all smaller ones. Only minima are aggregated, so a node with very many
    neighbours combines map-side. Rounds are written tables; edges never reach the driver. Self-loops and repeated edges are
    dropped; null ends are ignored.
    """

    def ordered(df: DataFrame) -> DataFrame:
        return df.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()

    def contracted(edges: DataFrame) -> DataFrame:
        both = edges.union(edges.select("dst", "src"))
        least = _least(both).select("src", F.least("src", "low").alias("low"))
        up = ordered(both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")))
        least = _least(up)
        return ordered(up.join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).union(least))

    edges, seen = materialise(ordered(edges)), None
    for _ in range(max_rounds):
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst")), F.sum(F.xxhash64("dst", "src") % 1000003)).first()
        if state == seen or not state[0]:
            return edges.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(edges.select("dst", "dst").distinct())
        seen, edges = state, materialise(contracted(edges))
    raise RuntimeError("the components did not settle")


def with_roots(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root, component_id) for every node of ``nodes`` (node, least): its root of ``roots``, or itself, and the least of its component."""
    top = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    named = materialise(nodes.join(top, F.col("node") == F.col("_node"), "left").select("node", "least", F.coalesce("_root", "node").alias("root")))
    low = named.groupBy("root").agg(F.min("least").alias("component_id")).select(F.col("root").bitwiseOR(F.lit(0).cast("long")).alias("root"), "component_id")
    return named.select("node", "root").join(low, "root").select("node", "root", "component_id")
