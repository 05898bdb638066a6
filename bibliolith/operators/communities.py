"""Communities of a weighted graph by greedy modularity, in DataFrame rounds; components where that is enough."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, materialize
from .components import connected_components


def _moved(links: DataFrame, degree: DataFrame, place: DataFrame, total: float, turn: int) -> DataFrame:
    """(node, community) after the nodes whose turn it is took the neighbouring community with the most gain, if any gains."""
    strength = place.join(degree, "node").groupBy("community").agg(F.sum("k").alias("tot"))
    near = links.join(place.select(F.col("node").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("node"), "community").agg(F.sum("weight").alias("w"))
    own = place.select("node", F.col("community").alias("old"))
    rows = near.join(own, "node").join(degree, "node").join(strength, "community")
    gain = F.col("w") - F.col("k") * (F.col("tot") - F.when(F.col("community") == F.col("old"), F.col("k")).otherwise(0.0)) / total
    best = rows.withColumn("gain", F.round(gain, 9)).groupBy("node", "old").agg(
        F.max(F.when(F.col("community") == F.col("old"), F.col("gain"))).alias("stay"), F.min_by("community", F.struct(-F.col("gain"), "community")).alias("best"), F.max("gain").alias("most"), F.any_value("k").alias("k")
    )
    alone = best.join(strength.select(F.col("community").alias("old"), "tot"), "old").withColumn("_stay", F.coalesce("stay", -F.col("k") * (F.col("tot") - F.col("k")) / total))
    goes = (F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0) & (F.col("most") > F.col("_stay") + 1e-9)
    moves = alone.where(goes).select("node", F.col("best").alias("community"))
    return place.join(moves.withColumnRenamed("community", "_new"), "node", "left").select("node", F.coalesce("_new", "community").alias("community"))


def modularity(edges: DataFrame, place: DataFrame) -> float:
    """The modularity of a partition (node, community) of edges (src, dst, weight), each once."""
    rows = edges.join(place.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(place.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    ends = rows.select(F.col("a").alias("c"), "weight").union(rows.select("b", "weight")).groupBy("c").agg(F.sum("weight").alias("tot"))
    inside, total = rows.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)), F.sum("weight")).first()
    if not total:
        return 0.0
    return inside / total - ends.agg(F.sum(F.pow(F.col("tot") / (2 * total), F.lit(2.0)))).first()[0]


def communities(edges: DataFrame, rounds: int = 8, levels: int = 3) -> DataFrame:
    """(node, community) of edges (src, dst, weight); a community is named by its least node.

    Levels of local moves and contraction, as in the Louvain method, but with half of the nodes moving at a time, told by a
    hash, so the result is the same each time. Every round is a few joins on the edges; nothing is gathered. Self-loops,
    null ends and weights of 0 are ignored; repeated edges add up.
    """
    clean = edges.where("src is not null and dst is not null and src <> dst and weight > 0").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
    clean = materialize(clean, "community-edges")
    total = clean.agg(F.sum("weight")).first()[0]
    nodes = clean.select(F.col("src").alias("node")).union(clean.select("dst")).distinct()
    final = materialize(nodes.select("node", F.col("node").alias("community")), "communities")
    if not total:
        return final
    level_edges, best = clean, modularity(clean, final)
    for level in range(levels):
        both = level_edges.union(level_edges.select("dst", "src", "weight"))
        links = materialize(both.where("src <> dst"), "community-links")
        degree = materialize(both.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k")), "community-degrees")
        place = materialize(degree.select("node", F.col("node").alias("community")), "community-places")
        quiet = 0
        for turn in range(rounds):
            after = materialize(_moved(links, degree, place, 2 * total, level * rounds + turn), "community-places")
            changed = after.join(place.withColumnRenamed("community", "_old"), "node").where("community <> _old").count()
            discard(place)
            place, quiet = after, 0 if changed else quiet + 1
            if quiet == 2:  # both halves stayed
                break
        joined = materialize(final.join(place.select(F.col("node").alias("community"), F.col("community").alias("_next")), "community").select("node", F.col("_next").alias("community")), "communities")
        now = modularity(clean, joined)
        discard(links, degree)
        if now <= best + 1e-9:
            break
        final, best = joined, now
        up = level_edges.join(place.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(place.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
        level_edges = materialize(up.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("weight").alias("weight")), "community-edges")
    names = final.groupBy("community").agg(F.min("node").alias("name"))
    return final.join(names, "community").select("node", F.col("name").alias("community"))


def cluster(pairs: DataFrame, method: str = "modularity", rounds: int = 8) -> tuple[DataFrame, str]:
    """((node, community), method used) of weighted pairs (a, b, weight): none for no pairs, else modularity or components."""
    edges = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
    if edges.isEmpty():
        return edges.select(F.col("src").alias("node"), F.col("src").alias("community")), "none"
    if method == "modularity":
        return communities(edges, rounds), method
    return connected_components(edges.select("src", "dst")).withColumnRenamed("component", "community"), "components"
