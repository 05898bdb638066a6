"""Rule tables: mining, merging, statistics and application."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed orders of application.
CATEGORIES = ("latex", "formula", "variable", "spacing", "metadata", "layout")
LEVELS = ("builtin", "learned", "user")


def mine_pairs(texts: DataFrame, least: int = 3) -> DataFrame:
    """(context, word, n): words that recur often enough in a context to become dictionary rules."""
    words = texts.select("context", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{6,})"), F.lit(1))).alias("word"))
    return words.groupBy("context", "word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


#: Whose rules count more when two disagree, first the strongest.
PRECEDENCE = ("user", "builtin", "learned")


def merge_rules(rules: DataFrame) -> DataFrame:
    """One rule per (category, pattern_type, pattern): that of the strongest level, then confidence, then version, then least id.

    Hits and evidence are added up over rules of the same replacement only; `dropped` lists the ids of those that lost.
    """
    level = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("level")), F.lit(0)), F.lit(99))
    best = F.struct(level.alias("p"), (-F.col("confidence")).alias("c"), (-F.col("version")).alias("v"), "rule_id", "level", "confidence", "version")
    same = rules.groupBy("category", "pattern_type", "pattern", "replacement").agg(
        F.min(best).alias("best"), F.sum("hits").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence")
    )
    whole = same.groupBy("category", "pattern_type", "pattern").agg(F.min(F.struct("best", "replacement", "hits", "evidence")).alias("w"), F.array_sort(F.collect_list("best.rule_id")).alias("ids"))
    kept = [F.col(f"w.best.{c}").alias(c) for c in ("rule_id", "level", "confidence", "version")]
    return whole.select("category", "pattern_type", "pattern", "w.replacement", "w.hits", "w.evidence", *kept, F.array_remove("ids", F.col("w.best.rule_id")).alias("dropped"))


def statistics(rules: DataFrame) -> DataFrame:
    return rules.groupBy("category").agg(F.count(F.lit(1)).alias("rules"), F.count_if("enabled").alias("enabled"), F.count_if("auto_apply").alias("automatic"), F.count_distinct("level").alias("levels"))


def validate(rules: DataFrame) -> DataFrame:
    """`rules` with the list of what is wrong with each."""
    checks = [
        (F.coalesce("rule_id", F.lit("")) == "", "no id"), (~F.col("category").isin(*CATEGORIES), "unknown category"), (~F.col("pattern_type").isin("regex", "literal", "dict"), "unknown pattern type"),
        (F.coalesce("pattern", F.lit("")) == "", "no pattern"), (~F.col("level").isin(*LEVELS), "unknown level"), (~F.col("confidence").between(0, 1), "confidence outside 0 to 1"),
    ]
    return rules.withColumn("errors", F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), m) for c, m in checks))))


def automatic(rules: DataFrame, least: float = 0.9) -> DataFrame:
    return rules.withColumn("auto_apply", F.col("directed") & (F.col("confidence") >= least))


def ordered(rules: list[dict]) -> list[dict]:
    """By category, then level, then falling confidence, then id."""
    return sorted((r for r in rules if r.get("enabled", True)), key=lambda r: (CATEGORIES.index(r["category"]), LEVELS.index(r["level"]), -r["confidence"], r["rule_id"]))


def _java(replacement: str) -> str:
    return re.sub(r"([\\$])", r"\\\1", replacement)


def apply_rules(text: Column, rules: list[dict]) -> Column:
    """A chain of replacements in rule order. Dictionary entries match whole words, as written and with a capital."""
    for r in ordered(rules):
        if r["pattern_type"] == "regex":
            text = F.regexp_replace(text, r["pattern"], r["replacement"])
        elif r["pattern_type"] == "literal":
            text = F.replace(text, F.lit(r["pattern"]), F.lit(r["replacement"]))
        else:
            for a, b in ((r["pattern"], r["replacement"]), (r["pattern"][:1].upper() + r["pattern"][1:], r["replacement"][:1].upper() + r["replacement"][1:])):
                text = F.regexp_replace(text, rf"\b\Q{a}\E\b", _java(b))
    return text
