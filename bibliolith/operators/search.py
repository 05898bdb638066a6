"""Inverted-index search: BM25, phrase and trigram match, staged fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.segment import let, stripped, trimmed
from ..scratch import materialize

#: Fixed values of the ranking function.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
MOST_TERMS = 8


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\p{L}\p{N}]+"), lambda t: t != "")


def trigrams(text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.length(low) >= 3, F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def cjk_grams(text: Column, most: int = 12) -> Column:
    """Distinct pairs of adjacent CJK characters in order, at most `most`."""
    only = F.regexp_replace(text, "[^\u4e00-\u9fff]", "")
    return F.when(F.length(only) >= 2, F.slice(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(only) - 1), lambda i: F.substring(only, i, F.lit(2)))), 1, most)).otherwise(F.array().cast("array<string>"))


def query_terms(query: Column, most: int | None = None) -> Column:
    """Distinct tokens of a query, of all its words or of the first `most`."""
    words = tokens(F.regexp_replace(query, '"', " "))
    return F.array_distinct(words if most is None else F.slice(words, 1, most))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf, dl): one row per document and term."""
    t = docs.select(key, tokens(F.col(text)).alias("_t"))
    return t.select(key, F.size("_t").cast("bigint").alias("dl"), F.explode("_t").alias("term")).groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, require_all: bool = False, k: int | None = 10, key: str = "doc_id", most: int | None = None) -> DataFrame:
    """(query_id, key, hits, score): queries (query_id, query) against documents; higher is better, ties by key.

    Query terms are few: they prune the postings before anything is shuffled, and only then are frequencies counted. Postings lie
    together by document, so a query's parts of a document meet before the shuffle. Parts are added as decimals: the sum is the
    same in any order, and equal documents tie.
    """
    q = queries.select("query_id", query_terms(F.col("query"), most).alias("_q")).select("query_id", F.size("_q").alias("terms"), F.explode("_q").alias("term"))
    lengths = docs.select(key, F.size(tokens(F.col("text"))).cast("bigint").alias("dl"))
    n, avg = lengths.agg(F.count(F.lit(1)), F.avg("dl")).first()
    hits = materialize(postings(docs, key).join(q.select("term").distinct(), "term", "left_semi").repartition(key), "postings")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.lit(LEAST_IDF), F.ln((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(avg or 1.0))))
    scored = hits.join(df, "term").join(q, "term").withColumn("part", part.cast("decimal(38,18)")).groupBy("query_id", "terms", key).agg(F.count(F.lit(1)).alias("hits"), F.sum("part").cast("double").alias("score"))
    if require_all:
        scored = scored.where("hits = terms")
    scored = scored.drop("terms")
    if k is None:
        return scored
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("nth", F.row_number().over(w).cast("bigint")).where(F.col("nth") <= k)


def staged(docs: DataFrame, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """(query_id, key, stage) of the first stage that finds anything: 1 all terms, 2 any term, 3 the query as a substring.

    All stages are computed at once; each query keeps the rows of its least stage. The first two take a query's first words.
    """
    hits = bm25(docs, queries, k=None, key=key, most=MOST_TERMS)
    n = queries.select("query_id", F.size(query_terms(F.col("query"), MOST_TERMS)).alias("terms"))
    by_terms = hits.join(n, "query_id").select("query_id", key, F.when(F.col("hits") == F.col("terms"), 1).otherwise(2).alias("stage"))
    like = docs.select(key, F.lower("text").alias("_low")).join(F.broadcast(queries.select("query_id", F.lower(F.trim("query")).alias("_q"))), F.contains("_low", "_q")).select("query_id", key, F.lit(3).alias("stage"))
    every = by_terms.union(like).groupBy("query_id", key).agg(F.min("stage").alias("stage"))
    least = every.groupBy("query_id").agg(F.min("stage").alias("stage"))
    return every.join(least, ["query_id", "stage"]).select("query_id", key, F.col("stage").cast("bigint").alias("stage"))


def phrase(docs: DataFrame, needle: str, key: str = "doc_id") -> DataFrame:
    """Documents that hold a phrase, case ignored, as an index of trigrams would find it; phrases of under three characters match nothing."""
    low = needle.lower()
    if len(low) < 3:
        return docs.select(key, F.lit(0).cast("bigint").alias("n")).limit(0)
    text = F.lower("text")
    return docs.where(F.contains(text, F.lit(low))).select(key, ((F.length(text) - F.length(F.replace(text, F.lit(low), F.lit("")))) / len(low)).cast("bigint").alias("n"))


def match_window(text: Column, anchors: Column, limit: int = 1200, before: int = 300, slack: int = 300) -> Column:
    """The text around the earliest of all anchors (case counts), trimmed at a break; without a hit the start of the text.

    Half a line at its start goes if it is no longer than 200 characters. `slack` more than the limit is read, so that the end
    falls on a break, too.
    """
    at = F.array_min(F.filter(F.transform(F.filter(anchors, lambda a: a != ""), lambda a: F.position(a, text)), lambda p: p > 0))

    def window(start: Column) -> Column:
        return let(stripped(text.substr(F.greatest(start - before, F.lit(1)), F.lit(limit + slack))), whole_lines)

    def whole_lines(part: Column) -> Column:
        line = F.instr(part, "\n")
        return trimmed(F.when((line > 0) & (line <= 201), F.regexp_replace(part.substr(line + 1, F.length(part)), r"(?U)^\s+", "")).otherwise(part), limit)

    return let(at, lambda a: F.when(a.isNull(), trimmed(stripped(text), limit)).otherwise(window(a)))


def anchors(query: Column) -> Column:
    """Where to look for a query in a text: its words, then its CJK pairs."""
    words = F.filter(F.split(F.replace(query, F.lit('"'), F.lit(" ")), r"(?U)\s+"), lambda w: w != "")
    return F.array_distinct(F.concat(words, cjk_grams(query)))
