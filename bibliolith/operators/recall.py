"""Retrieval over several channels: staged note and full-text search, neighbours, fusion, reranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import neighbours
from .ranking import RRF_K, rrf
from .search import B, K1, LEAST_IDF, MOST_TERMS, anchors, cjk_grams, match_window

#: What each channel counts, how many hits have their neighbours looked at, how many of these, and the least pool.
CHANNEL_WEIGHTS = {"notes": 1.0, "vector": 1.0, "meta": 0.5, "neighbor": 0.4, "cards": 0.5, "fulltext": 0.6}
NEIGHBOUR_SEEDS, NEIGHBOUR_CAP, LEAST_POOL = 3, 8, 12
#: Query terms that meet the documents at once.
TERMS_AT_ONCE = 1000


def _words(query: Column) -> Column:
    return F.filter(F.split(F.replace(query, F.lit('"'), F.lit(" ")), r"(?U)\s+"), lambda w: w != "")


def _containing(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, length, term, tf): the documents (key, content) that hold a term, case ignored.

    Terms come in blocks, each one row that holds an array, so a document is read once for each block and meets no query.
    """
    distinct = terms.select("term").distinct()
    blocks = max(1, -(-distinct.count() // TERMS_AT_ONCE))
    low = docs.select("key", F.lower("content").alias("_c"), F.length("content").alias("length"))
    parts = []
    for k in range(blocks):
        block = distinct.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k).agg(F.collect_list("term").alias("_terms"))
        held = low.crossJoin(F.broadcast(block)).select("key", "length", "_c", F.explode(F.filter("_terms", lambda t: F.contains(F.col("_c"), F.lower(t)))).alias("term"))
        times = (F.length("_c") - F.length(F.replace(F.col("_c"), F.lower("term"), F.lit("")))) / F.length("term")
        parts.append(held.select("key", "length", "term", times.cast("bigint").alias("tf")))
    return reduce(DataFrame.union, parts)


def search_staged(docs: DataFrame, queries: DataFrame, k: int = 10, stages: tuple[str, ...] = ("all", "any", "like_all", "like_any", "grams"), key: str = "key") -> DataFrame:
    """(query_id, key, stage, nth, snippet) of queries (query_id, query) against documents (key, content), by the first stage that finds any.

    all and any: the first eight words as phrases of a trigram index, so words of under three characters match nothing; ordered
    by BM25. The others only for queries with CJK characters: all words or any word as substrings, then pairs of CJK characters;
    shortest documents first. Ties by key. The snippet is the text around the earliest word.
    """
    cjk = F.col("query").rlike("[\u4e00-\u9fff]")
    q = queries.select("query_id", "query", _words(F.col("query")).alias("words"), cjk.alias("cjk"))
    phrases = q.select("query_id", F.explode(F.array_distinct(F.slice("words", 1, MOST_TERMS))).alias("term"), F.lit("phrase").alias("kind"))
    like = q.where("cjk").select("query_id", F.explode(F.array_distinct("words")).alias("term"), F.lit("like").alias("kind"))
    grams = q.where("cjk").select("query_id", F.explode(cjk_grams(F.col("query"))).alias("term"), F.lit("gram").alias("kind"))
    asked = phrases.union(like).union(grams)
    needed = asked.groupBy("query_id", "kind").agg(F.count(F.lit(1)).alias("terms"))
    base = docs.select(F.col(key).alias("key"), "content")
    held = _containing(base, asked)
    size = base.agg(F.count(F.lit(1)).alias("_docs"), F.avg(F.greatest(F.length("content") - 2, F.lit(1))).alias("_avg"))
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.lit(LEAST_IDF), F.ln((F.col("_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weighed = held.join(df, "term").crossJoin(F.broadcast(size)).withColumn("part", idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * (F.col("length") - 2) / F.col("_avg"))))
    usable = (F.col("kind") != "phrase") | (F.length("term") >= 3)
    found = weighed.join(asked, "term").where(usable).groupBy("query_id", "kind", "key", "length").agg(F.count(F.lit(1)).alias("hits"), F.sum("part").alias("score")).join(needed, ["query_id", "kind"])
    every = {
        "all": (F.col("kind") == "phrase") & (F.col("hits") == F.col("terms")), "any": F.col("kind") == "phrase", "like_all": (F.col("kind") == "like") & (F.col("hits") == F.col("terms")),
        "like_any": F.col("kind") == "like", "grams": F.col("kind") == "gram",
    }
    stage = F.coalesce(*(F.when(every[s], n) for n, s in enumerate(stages, 1)))
    staged = found.withColumn("stage", stage).where("stage is not null").groupBy("query_id", "key", "length").agg(F.min("stage").alias("stage"), F.min_by("score", "stage").alias("score"))
    least = staged.groupBy("query_id").agg(F.min("stage").alias("stage"))
    order = F.when(F.element_at(F.array(*map(F.lit, stages)), F.col("stage")).isin("all", "any"), -F.col("score")).otherwise(F.col("length"))
    w = Window.partitionBy("query_id").orderBy(order, "key")
    top = staged.join(least, ["query_id", "stage"]).withColumn("nth", F.row_number().over(w).cast("bigint")).where(F.col("nth") <= k)
    texts = top.join(base, "key").join(queries.select("query_id", "query"), "query_id")
    return texts.select("query_id", "key", F.col("stage").cast("bigint").alias("stage"), "nth", match_window(F.col("content"), anchors(F.col("query"))).alias("snippet"))


def search_notes(notes: DataFrame, queries: DataFrame, k: int = 10, doi: str | None = None) -> DataFrame:
    """(query_id, doi, file, stage, nth, snippet) of notes (doi, file, content), of one document if `doi` is given."""
    rows = (notes if doi is None else notes.where(F.col("doi") == doi)).withColumn("key", F.struct("doi", "file"))
    return search_staged(rows, queries, k).select("query_id", "key.doi", "key.file", "stage", "nth", "snippet")


def search_fulltext(texts: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doi, stage, nth, snippet) of texts (doi, content): all words, then, for CJK queries, all as substrings."""
    return search_staged(texts.withColumn("key", F.col("doi")), queries, k, ("all", "like_all")).withColumnRenamed("key", "doi")


def phrase_ranked(docs: DataFrame, needle: str, k: int = 20, cut: int = 300, key: str = "doc_id") -> DataFrame:
    """(key, nth, snippet): documents that hold a phrase of three characters or more, by BM25 of its occurrences; the text cut to `cut`."""
    low = needle.lower()
    text = F.lower("text")
    tf = (F.length(text) - F.length(F.replace(text, F.lit(low), F.lit("")))) / max(1, len(low))
    dl = F.greatest(F.length("text") - 2, F.lit(1))
    mean = docs.agg(F.avg(dl).alias("_avg"))
    hits = docs.where(F.contains(text, F.lit(low)) & F.lit(len(low) >= 3)).crossJoin(F.broadcast(mean))
    scored = hits.select(key, F.substring("text", 1, cut).alias("snippet"), (tf / (tf + K1 * (1 - B + B * dl / F.col("_avg")))).alias("score"))
    top = scored.orderBy(F.desc("score"), key).limit(k)
    return top.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("score"), key)).cast("bigint")).select(key, "nth", "snippet")  # k rows


def neighbour_hits(hits: DataFrame, edges: DataFrame, notes_hits: DataFrame) -> DataFrame:
    """(query, key, rank, snippet) of the neighbours of a query's first hits, where their own notes match the query, too.

    hits: query, nth, doi; edges: citing, cited; notes_hits: query, doi, nth, snippet. Up to eight cited and eight citing documents of
    each of the first three hits, the first three of all of them; the first hit itself is none.
    """
    seeds = hits.where(F.col("nth") <= NEIGHBOUR_SEEDS)
    near = neighbours(edges, seeds.select("doi").distinct(), NEIGHBOUR_CAP)
    order = F.struct("nth", F.when(F.col("direction") == "cites", 0).otherwise(1).alias("d"), "neighbour")
    each = seeds.join(near, "doi").groupBy("query", "neighbour").agg(F.min(order).alias("_at"))
    w = Window.partitionBy("query").orderBy("_at")
    first = each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= NEIGHBOUR_SEEDS)
    top = hits.where("nth = 1").select("query", F.col("doi").alias("_top"))
    kept = first.join(top, "query").where("neighbour <> _top").select("query", F.col("neighbour").alias("doi"), "rank")
    found = notes_hits.where(F.col("nth") <= 5).groupBy("query", "doi").agg(F.min_by("snippet", "nth").alias("snippet"))
    return kept.join(found, ["query", "doi"]).select("query", F.col("doi").alias("key"), "rank", "snippet")


def recall(channels: dict[str, DataFrame], k: int = 8, rerank: DataFrame | None = None, weights: dict[str, float] | None = None, constant: int = RRF_K) -> DataFrame:
    """(query, nth, key, rrf, source, snippet): channels (query, key, rank, snippet) fused by reciprocal rank, a pool of max(12, 3k) reranked.

    rerank has query, key, rerank_score; what it does not score comes last. Without it the fused order stands. Ties by key.
    """
    rows = [df.select("query", F.lit(name).alias("channel"), "key", "rank", "snippet") for name, df in channels.items()]
    fused = rrf(reduce(DataFrame.unionByName, rows), weights or CHANNEL_WEIGHTS, constant)
    pool = fused.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("rrf"), "key"))).where(F.col("_n") <= max(LEAST_POOL, 3 * k))
    scored = pool.join(rerank, ["query", "key"], "left") if rerank is not None else pool.withColumn("rerank_score", F.lit(None).cast("double"))
    w = Window.partitionBy("query").orderBy(F.desc_nulls_last("rerank_score"), F.desc("rrf"), "key")
    return scored.withColumn("nth", F.row_number().over(w).cast("bigint")).where(F.col("nth") <= k).select("query", "nth", "key", "rrf", "source", "snippet")
