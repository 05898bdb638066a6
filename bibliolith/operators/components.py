"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, materialize


def _round(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Large-star, then small-star of edges (u, v) with u > v; `least` has the least neighbour, or itself, of every node.

    The first join meets a table of minima, so that a hub's edges can be split over tasks; most of what it yields for a hub is one
    edge again and again, which goes before rows are dealt by u, for the minima of the second step and for the join with them.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    dealt = large.repartition("u")
    low = dealt.groupBy("u").agg(F.min("v").alias("m"))
    joined = dealt.join(low, "u")
    return joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component) for every endpoint of `edges` (columns src, dst); a component is named by its least node.

    Alternates large-star (each node's larger neighbours move to the least neighbour) and small-star steps until only
    stars are left: O(log^2 n) rounds, each five shuffles of the edges, whatever the diameter, and none for edges that are
    stars from the start. Self-loops give single nodes; rows with a null endpoint are ignored; repeated edges count once;
    no edges give no rows.
    """
    clean = edges.where("src is not null and dst is not null").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    first = materialize(clean.distinct(), "star-edges")
    nodes = first.select(F.col("u").alias("node")).union(first.select("v")).distinct()
    current, rounds = first.where("u <> v"), 0
    while True:
        ends = current.select(F.col("u").alias("u"), F.col("v").alias("o"), F.lit(1).alias("child")).union(current.select("v", "u", F.lit(0)))
        info = ends.groupBy("u").agg(F.least(F.min("o"), F.col("u")).alias("m"), F.sum("child").alias("children"), F.min("child").alias("leaf"))
        info = materialize(info, "star-min")
        # stars: every u has one v, and no v is a u
        if info.where("children > 1 or (children > 0 and leaf = 0)").isEmpty():
            break
        if rounds == max_rounds:
            raise RuntimeError(f"components did not converge in {max_rounds} rounds")
        after = materialize(_round(current, info.select("u", "m")), "star-edges")
        discard(info, *([current] if rounds else []))
        current, rounds = after, rounds + 1
    discard(info)
    return nodes.join(current.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
