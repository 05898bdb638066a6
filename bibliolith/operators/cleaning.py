"""Rule-driven cleaning, metric lookup and rename write-back."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import lax_int


@dataclass(frozen=True)
class CleaningRules:
    """Reasons to remove a paper; any one suffices, and no rule removes nothing."""

    min_year: int | None = None
    min_impact: float | None = None
    keep_quartiles: tuple[str, ...] = ()
    min_library_citations: int | None = None
    non_wos: bool = False
    include_mains: bool = False

    def reasons(self) -> dict[str, Column]:
        found = {
            "year": None if self.min_year is None else lax_int(F.col("year")) < self.min_year,
            "impact": None if self.min_impact is None else F.col("impact_factor") < self.min_impact,
            "quartile": ~F.col("quartile").isin(*self.keep_quartiles) if self.keep_quartiles else None,
            "library": None if self.min_library_citations is None else F.col("library_citations") < self.min_library_citations,
            "non_wos": (~F.col("source_main").ilike("wos%") | (F.col("abstract") == "")) if self.non_wos else None,
        }
        return {k: v for k, v in found.items() if v is not None}

    def condition(self) -> Column:
        parts = list(self.reasons().values())
        if not parts:
            return F.lit(False)
        hit = reduce(lambda a, b: a | b, parts)
        return hit if self.include_mains else F.col("is_reference") & hit


def preview(papers: DataFrame, rules: CleaningRules) -> DataFrame:
    """One row, one pass: total, to_remove, to_keep, and each rule's own count within its scope."""
    scope = F.lit(True) if rules.include_mains else F.col("is_reference")
    gone = F.count_if(rules.condition())
    return papers.agg(F.count(F.lit(1)).alias("total"), gone.alias("to_remove"), (F.count(F.lit(1)) - gone).alias("to_keep"), *(F.count_if(scope & c).alias(f"by_{k}") for k, c in rules.reasons().items()))


def samples(papers: DataFrame, rules: CleaningRules, n: int = 20) -> DataFrame:
    return papers.where(rules.condition()).orderBy("doi").limit(n).select("doi", F.substring("title", 1, 60).alias("title"))


def execute(papers: DataFrame, edges: DataFrame, rules: CleaningRules) -> tuple[DataFrame, DataFrame]:
    """Papers and edges that remain; an edge goes with either of its ends."""
    gone = papers.where(rules.condition()).select("doi")
    kept = edges.join(gone.withColumnRenamed("doi", "citing"), "citing", "left_anti").join(gone.withColumnRenamed("doi", "cited"), "cited", "left_anti")
    return papers.where(~F.coalesce(rules.condition(), F.lit(False))), kept.select("citing", "cited")


def mark(papers: DataFrame, rules: CleaningRules) -> DataFrame:
    return papers.withColumn("is_cleaned", F.coalesce(rules.condition(), F.lit(False)))


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """The newest row per journal name, case ignored; ties by impact."""
    w = Window.partitionBy(F.upper("journal_name")).orderBy(F.desc("year"), F.desc("jif"))
    return metrics.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def attach_metrics(papers: DataFrame, metrics: DataFrame) -> DataFrame:
    """Impact factor and quartile from the newest row of the paper's journal, unmatched papers unchanged."""
    m = latest_metrics(metrics).select(F.upper("journal_name").alias("_key"), F.col("jif").alias("_jif"), F.col("quartile").alias("_q"))
    joined = papers.withColumn("_key", F.upper("journal")).join(m, "_key", "left")
    return joined.withColumn("impact_factor", F.coalesce("_jif", "impact_factor")).withColumn("quartile", F.coalesce("_q", "quartile")).drop("_key", "_jif", "_q")


def rename(papers: DataFrame, mapping: DataFrame, column: str = "journal") -> DataFrame:
    """Write back a mapping (old, new) where it has an entry."""
    return papers.join(mapping.select(F.col("old").alias(column), "new"), column, "left").withColumn(column, F.coalesce("new", column)).drop("new").select(papers.columns)


def distinct_journals(papers: DataFrame, longest: int = 100) -> DataFrame:
    """(journal, n, sample): count and the least doi of under `longest` characters."""
    return papers.where("journal <> ''").groupBy("journal").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.length("doi") < longest, F.col("doi"))).alias("sample"))
