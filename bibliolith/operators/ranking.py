"""Scores, fusion of ranked lists, funnels, budgets and retrieval metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..schema import rounded

#: Fixed weights of the value score, and the reciprocal-rank constant.
VALUE_WEIGHTS = {"impact": 0.20, "cited": 0.15, "ai": 0.25, "topic": 0.15, "year": 0.10, "rank": 0.10, "library": 0.05}
RRF_K = 60
#: Parts that go up to 5; the others go up to 1.
VALUE_SCALES = {"impact": 5.0, "ai": 5.0, "rank": 5.0, "library": 5.0}


def impact_band(quartile: Column, jif: Column, zone: Column) -> Column:
    """Q1 to Q4 as 4 to 1, else by impact factor; one more for zone 1, at most 5; null with neither."""
    band = F.when(quartile.isin("Q1", "Q2", "Q3", "Q4"), 5 - F.substring(quartile, 2, 1).try_cast("double")).when(jif >= 10, 4.0).when(jif >= 5, 3.0).when(jif >= 2, 2.0).when(jif > 0, 1.0)
    return F.when(band.isNotNull(), F.least(band + F.when(zone == 1, 1.0).otherwise(0.0), F.lit(5.0)))


def cited_part(cites: Column) -> Column:
    """0 to 1 by the logarithm; pass null where nothing is known of citations."""
    return F.least(F.lit(1.0), F.log10(F.greatest(F.lit(1.0), cites.cast("double")) + 1) / 2.5)


def year_part(year: Column, now: int) -> Column:
    age = F.greatest(F.lit(0), F.lit(now) - year)
    return F.when(year.isNull(), None).when(age <= 3, 1.0).when(age <= 10, 0.7).otherwise(0.4)


def rank_part(rank: Column) -> Column:
    """1 up to 1e-4, then piecewise linear through (1e-3, 3) and (1e-2, 5); null for no rank."""
    return (
        F.when(rank.isNull() | (rank <= 0), None).when(rank < 1e-4, 1.0).when(rank < 1e-3, 1 + 2 * (rank - 1e-4) / 9e-4)
        .when(rank < 1e-2, 3 + 2 * (rank - 1e-3) / 9e-3).otherwise(5.0)
    )


def library_part(n: Column) -> Column:
    return F.when(n > 0, F.least(F.lit(5.0), 5 * F.log10(n.cast("double") + 1)))


def value_score(parts: dict[str, Column]) -> Column:
    """0 to 5, to two places: the weighted mean of the parts that are there, each rounded to two places on its own scale first; weights of absent parts drop out."""
    total = weight = F.lit(0.0)
    for name, part in parts.items():
        there = part.isNotNull()
        total = total + F.when(there, rounded(part, 2) * VALUE_WEIGHTS[name] / VALUE_SCALES.get(name, 1.0)).otherwise(0.0)
        weight = weight + F.when(there, VALUE_WEIGHTS[name]).otherwise(0.0)
    return F.when(weight > 0, rounded(F.greatest(F.lit(0.0), F.least(F.lit(5.0), 5 * total / weight)), 2)).otherwise(0.0)


def level(score: Column, has_ai: Column, at: float = 2.5) -> Column:
    return F.when((score >= at) & has_ai, "L2").otherwise("L1")


def channel_ranks(hits: DataFrame, score: str = "score") -> DataFrame:
    """Rank within each query and channel from 1, ties by key."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query", "channel").orderBy(F.desc(score), "key")))


def rrf(hits: DataFrame, weights: dict[str, float], k: int = RRF_K) -> DataFrame:
    """(query, key, rrf, source, snippet) of hits (query, channel, key, rank, snippet): the sum of weight / (k + rank).

    The source is the vector channel if it found the key, else the first channel in order of `weights`; the longest snippet wins.
    """
    names = list(weights)
    w = F.lit(0.0)
    order = F.lit(len(names))
    for i, n in enumerate(names):
        w = F.when(F.col("channel") == n, weights[n]).otherwise(w)
        order = F.when(F.col("channel") == n, -1 if n == "vector" else i).otherwise(order)
    return hits.groupBy("query", "key").agg(
        F.sum(w / (k + F.col("rank"))).alias("rrf"), F.min_by("channel", F.struct(order, "channel")).alias("source"), F.max_by("snippet", F.struct(F.length("snippet"), "snippet")).alias("snippet")
    )


def funnel(candidates: DataFrame, deliver: int = 20, keep: int = 50) -> DataFrame:
    """Rerank scores cut to `keep`, then 0.40 rerank + 0.15 rank / max rank + 0.20 cites / max cites over what is left."""
    w = Window.partitionBy("query").orderBy(F.desc_nulls_last("rerank"), "key")
    pool = candidates.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep)
    q = Window.partitionBy("query")
    share = lambda c: F.coalesce(F.col(c) / F.when(F.max(c).over(q) > 0, F.max(c).over(q)), F.lit(0.0))
    scored = pool.withColumn("final", 0.40 * F.coalesce("rerank", F.lit(0.0)) + 0.15 * share("paper_rank") + 0.20 * share("times_cited"))
    return scored.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("final"), "key")).cast("bigint")).where(F.col("nth") <= deliver).drop("_n")


def keep_scored(df: DataFrame, score: str, least: float = 0.30, at_least: int = 5, group: str = "query") -> DataFrame:
    """Rows of a score of `least` or more; where fewer than `at_least` of a group survive, all of it."""
    n = F.count_if(F.col(score) >= least).over(Window.partitionBy(group))
    return df.withColumn("_n", n).where((F.col(score) >= least) | (F.col("_n") < at_least)).drop("_n")


def within_budget(df: DataFrame, group: list[str], order: list, cost: Column, budget: int) -> DataFrame:
    """The longest prefix of each group whose costs fit; its first row always stays."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_sum", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_rn", F.row_number().over(w)).where((F.col("_sum") <= budget) | (F.col("_rn") == 1)).drop("_sum", "_rn")


def pack_skipping(df: DataFrame, group: str, order: str, cost: str, budget: int) -> DataFrame:
    """(group, order, cost) of a greedy pack that skips what does not fit and goes on: a fold over each group's sorted array."""
    items = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, cost))).alias("items"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast(T.ArrayType(df.select(F.struct(order, cost)).schema[0].dataType)).alias("kept"))
    folded = F.aggregate(
        "items", start,
        lambda acc, x: F.when(acc["used"] + x[cost] <= budget, F.struct((acc["used"] + x[cost]).cast("bigint").alias("used"), F.array_append(acc["kept"], x).alias("kept"))).otherwise(acc),
    )
    return items.select(group, F.explode(folded["kept"]).alias("x")).select(group, f"x.{order}", f"x.{cost}")


@dataclass(frozen=True)
class Gate:
    recall: float = 0.8
    mrr: float = 0.6
    tolerance: float = 0.05


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query, recall, mrr, ndcg) of ranked (query, rank, key) against relevant (query, item, key): an item counts once, at its first hit."""
    first = relevant.join(ranked, ["query", "key"], "left").groupBy("query", "item").agg(F.min("rank").alias("rank"))
    n = F.count(F.lit(1))
    gain = F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return first.groupBy("query").agg((F.count_if(F.col("rank") <= k) / n).alias("recall"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("mrr"), (gain / ideal).alias("ndcg"))


def gate(metrics: DataFrame, limits: Gate = Gate(), before: tuple[float, float] | None = None) -> DataFrame:
    """One row: mean recall and mrr, and whether they pass and have not fallen by more than the tolerance."""
    means = metrics.agg(F.avg("recall").alias("recall"), F.avg("mrr").alias("mrr"), F.avg("ndcg").alias("ndcg"))
    ok = (F.col("recall") >= limits.recall) & (F.col("mrr") >= limits.mrr)
    if before is not None:
        ok = ok & (F.col("recall") >= before[0] - limits.tolerance) & (F.col("mrr") >= before[1] - limits.tolerance)
    return means.withColumn("passed", ok)
