"""Quality score from a sparse rule ensemble over text statistics.

Trees of a random forest propose conjunctions of thresholds (every path from a root to a node); an L1-penalised logistic
regression over these rules keeps few of them; the kept rules become one Spark column expression, so scoring is a
projection of the scan without shuffle or Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def statistics(text: Column) -> dict[str, Column]:
    """Numbers about a whole text, null as empty. None depends on language, source or identity."""
    text = F.coalesce(text, F.lit(""))
    words = F.greatest(F.regexp_count(text, F.lit("\\S++")), F.lit(1))
    per_word = lambda pattern: F.regexp_count(text, F.lit(pattern)) / words
    tokens, lines = F.split(text, "\\s+"), F.split(text, "\n")
    return {
        "log_chars": F.log1p(F.length(text).cast("double")),
        "word_length": F.length(text) / words,
        "caps": per_word("\\p{Lu}{2,}+"),
        "symbols": per_word("[^\\p{L}\\p{N}\\s.,;:!?'\"()-]++"),
        "shouts": per_word("[!?]{2,}+"),
        "bars": per_word("\\|"),
        "digits": per_word("\\p{N}++"),
        "stops": per_word("[.]"),
        "line_words": F.log1p(words / F.size(lines)),
        "distinct_words": F.size(F.array_distinct(tokens)) / F.size(tokens),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, "<=" or ">", threshold)."""

    terms: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (F.col(n) <= t if op == "<=" else F.col(n) > t for n, op, t in self.terms))


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The probability of label 1 as an expression over the columns of `statistics`."""
        total = reduce(lambda a, b: a + b, (F.when(r.column(), w).otherwise(0.0) for r, w in self.weights), F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: the CRC-32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _tree_rules(model, names: list[str]) -> list[Rule]:
    """Every path from a root to another node, thresholds of the same side merged to the tightest."""
    found: dict[Rule, None] = {}

    def walk(node, terms: tuple) -> None:
        if terms:
            tight: dict[tuple[str, str], float] = {}
            for n, op, t in terms:
                k = (n, op)
                tight[k] = t if k not in tight else (min if op == "<=" else max)(tight[k], t)
            found[Rule(tuple(sorted((n, op, t) for (n, op), t in tight.items())))] = None
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            name, at = names[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), (*terms, (name, "<=", at)))
            walk(node.rightChild(), (*terms, (name, ">", at)))

    for tree in model._java_obj.trees():
        walk(tree.rootNode(), ())
    return list(found)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 20_000, trees: int = 16, depth: int = 3, penalty: float = 0.002) -> RuleEnsemble:
    """Learn a rule ensemble from labelled documents that are not held out.

    At most `sample` of them are used, the first by a hash of their id. Null labels are ignored; a document with several
    labels is learnt from with the least. With one class only, or none, the ensemble is a constant.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = materialize(texts.select("label", *(c.cast("double").alias(n) for n, c in statistics(F.col("text")).items())).repartition(8), "quality-sample")
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        rate = (counts.get(1.0, 0) + 1) / (total + 2)
        return RuleEnsemble(math.log(rate / (1 - rate)), ())
    names = [n for n in rows.columns if n != "label"]
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("label", "features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=max(2, total // 500), featureSubsetStrategy="onethird", seed=7).fit(vectors)
    rules = _tree_rules(forest, names)
    fired = rows.select("label", array_to_vector(F.array(*(F.when(r.column(), 1.0).otherwise(0.0) for r in rules))).alias("features"))
    fired = materialize(fired.select("label", "features"), "quality-rules")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(fired)
    weights = tuple((r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w)
    discard(rows, fired)
    return RuleEnsemble(float(lasso.intercept), weights)


def _scored(docs: DataFrame, model: RuleEnsemble, threshold: float, extra: list[Column]) -> tuple[DataFrame, list[str]]:
    stats = statistics(F.col("text"))
    kept = [c for c in docs.columns if c not in (*stats, "score", "predicted")]
    rows = docs.select(*kept, *extra, *(c.cast("double").alias(n) for n, c in stats.items())).withColumn("score", model.score())
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int")), kept


def score_documents(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` with score (0 to 1) and predicted (1 where score >= threshold). Null and empty texts are scored by their statistics, too."""
    rows, kept = _scored(docs, model, threshold, [])
    return rows.select(*kept, "score", "predicted")


def accepted(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` that are predicted 1.

    A filter on the prediction would be pushed below the statistics and compute each again for every rule that names it; the
    row number, which no filter passes, keeps them computed once.
    """
    names = {c: f"_{i}" for i, c in enumerate(docs.columns) if c not in ("text", "doc_id")}
    renamed = docs.select(*(F.col(c).alias(names.get(c, c)) for c in docs.columns))
    rows, _ = _scored(renamed, model, threshold, [F.monotonically_increasing_id().alias("_row")])
    return rows.where("predicted = 1 and _row >= 0").select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))
