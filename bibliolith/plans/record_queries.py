"""Merge, ranking and retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge, ranking
from ..schema import rounded
from .standins import PAPERS, papers, table, view

_RECORDS = """SELECT o_orderkey AS position, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('10.1/', CAST(o_custkey % 900 AS STRING)) END AS doi,
    CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('t', CAST(o_custkey % 700 AS STRING)) END AS title, CAST(CAST(year(o_orderdate) AS BIGINT) AS STRING) AS year,
    CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('s', CAST(o_custkey % 300 AS STRING)) END AS surname, o_orderpriority AS journal FROM orders"""
_OLD = "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 4 = 0 THEN 0.0e0 ELSE c_acctbal END AS balance FROM customer WHERE c_custkey % 5 <> 0"
_NEW = "SELECT c_custkey AS id, concat('new ', c_name) AS name, 'FILLED' AS segment, 1.5e0 AS balance FROM customer WHERE c_custkey % 2 = 0"
_SCORED = f"SELECT *, CASE WHEN id % 3 = 0 THEN NULL ELSE times_cited / 10.0e0 END AS ai FROM ({PAPERS}) q"
_HITS = """SELECT CAST(user_id % 40 AS BIGINT) AS query, event_type AS channel, CAST(event_id % 60 AS BIGINT) AS key, max(value) AS score, max(props) AS snippet FROM events GROUP BY 1, 2, 3"""
_WEIGHTS = {"click": 1.0, "vector": 1.0, "purchase": 0.5, "view": 0.6}
_CAND = "SELECT CAST(l_suppkey AS BIGINT) AS query, CAST(l_orderkey AS BIGINT) AS key, max(l_discount) AS rerank, max(l_tax) AS paper_rank, max(l_quantity) AS times_cited FROM lineitem GROUP BY 1, 2"
_RANKED = "SELECT o_custkey AS query, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rank, o_orderkey AS key, o_orderpriority AS p FROM orders"


def upsert_merge(spark, sf):
    return merge.upsert(view(spark, sf, _OLD), view(spark, sf, _NEW), "id")


def fill_only_merge(spark, sf):
    return merge.fill_only(view(spark, sf, _OLD), view(spark, sf, _NEW), "id", ["name", "segment", "balance"])


def keep_owned_merge(spark, sf):
    new = view(spark, sf, _NEW).withColumn("segment", F.lit(""))
    return merge.keep_owned(view(spark, sf, _OLD), new, "id", ["segment"])


def first_wins_edges(spark, sf):
    e = view(spark, sf, "SELECT l_orderkey AS citing, l_partkey AS cited, l_linenumber AS n, l_quantity AS weight FROM lineitem")
    cols = ["citing", "cited", "weight"]
    return merge.insert_absent(e.where("n > 5").groupBy("citing", "cited").agg(F.min("weight").alias("weight")), e.where("n <= 5").select(*cols), ["citing", "cited"], [F.col("weight")])


def replace_edges(spark, sf):
    e = view(spark, sf, "SELECT l_orderkey AS citing, l_partkey AS cited, l_quantity AS weight, l_returnflag AS f FROM lineitem")
    old, new = e.where("f = 'R'").select("citing", "cited", "weight"), e.where("f = 'A'").select("citing", "cited", "weight")
    return merge.replace_group(old.distinct(), new, "citing", ["citing", "cited"], [F.desc("weight")])


def dedup_three_tier(spark, sf):
    r = view(spark, sf, _RECORDS)
    return merge.three_tier(r, r.where("position % 97 = 1").select("doi")).select("position", "doi", "title", "year")


def source_priority(spark, sf):
    base = view(spark, sf, "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer")
    one = base.where("id % 2 = 0").withColumn("name", F.when(F.col("id") % 4 == 0, "").otherwise("first"))
    return merge.by_priority([one, base.where("id % 3 = 0").withColumn("segment", F.lit("second")), base], "id", ["name", "segment"])


def reconcile(spark, sf):
    return merge.reconcile(table(spark, sf, "documents"), table(spark, sf, "labels").where("quality = 1"), "doc_id")


def missing_keys(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").orderBy("c_custkey")


def set_difference(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey").exceptAll(li.where("l_returnflag = 'A'").select("l_partkey", "l_suppkey"))


def identifier_cascade(spark, sf):
    names = view(spark, sf, "SELECT DISTINCT CAST(o_custkey % 2000 AS STRING) AS name FROM orders")
    c = view(spark, sf, "SELECT CAST(c_custkey AS STRING) AS k, c_custkey AS id FROM customer")
    return merge.resolve(names, c.where("id % 3 = 0").select(F.col("k").alias("rid")), c.where("id % 3 = 1").select(F.col("k").alias("value"), F.concat(F.lit("i"), "k").alias("rid")), c.where("id % 3 = 2 and id % 2 = 0").select(F.col("k").alias("dirname"), F.concat(F.lit("d"), "k").alias("rid")))


def cascade_delete(spark, sf):
    gone = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    kids = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey")
    return merge.cascade_delete(table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), kids, gone, "k")[1].groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def segment_compaction(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("version"), (F.col("event_id") % 5 == 0).alias("deleted"), "value")
    return merge.compact(e, "k", "version", "deleted")


def snapshot_diff(spark, sf):
    e = table(spark, sf, "events")
    pick = lambda lo: e.where(F.col("event_id") % 3 != lo).groupBy("user_id").agg(F.max("event_type").alias("body"), F.max("event_id").alias("meta"))
    return merge.snapshot_diff(pick(0), pick(1), "user_id", "body", "meta")


def value_score(spark, sf):
    p = view(spark, sf, _SCORED)
    year = F.col("year").try_cast("bigint")
    parts = {
        "impact": ranking.impact_band(F.col("quartile"), F.col("impact_factor"), F.col("cluster")), "cited": ranking.cited_part(F.col("times_cited")), "ai": F.col("ai"),
        "year": ranking.year_part(year, 2026), "rank": ranking.rank_part(F.col("paper_rank")), "library": ranking.library_part(F.col("library_citations")),
    }
    s = ranking.value_score(parts)
    return p.select("doi", s.alias("score"), ranking.level(s, F.col("ai").isNotNull()).alias("level"))


def rrf_fusion(spark, sf):
    ranked = ranking.channel_ranks(view(spark, sf, _HITS))
    return ranking.rrf(ranked, _WEIGHTS).select("query", "key", rounded(F.col("rrf"), 9).alias("rrf"), "source", "snippet")


def funnel_rank(spark, sf):
    return ranking.funnel(view(spark, sf, _CAND)).select("query", "nth", "key", rounded(F.col("final"), 9).alias("final"))


def score_min_keep(spark, sf):
    c = view(spark, sf, _CAND)
    return ranking.keep_scored(c, "rerank", 0.0999, 300).select("query", "key", "rerank")


def history_budget(spark, sf):
    m = table(spark, sf, "conversations")
    return ranking.within_budget(m, ["conv_id"], [F.desc("turn")], F.greatest(F.lit(1), F.floor(F.length("text") / 2)), 300).select("conv_id", "turn")


def context_pack(spark, sf):
    m = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("chars"))
    return ranking.pack_skipping(m, "conv_id", "turn", "chars", 500)


def ir_metrics(spark, sf):
    ranked = view(spark, sf, _RANKED)
    wanted = ranked.where("key % 3 = 0").select("query", F.col("p").alias("item"), "key")
    m = ranking.retrieval_metrics(ranked.select("query", "rank", "key"), wanted)
    return m.select("query", *(rounded(F.col(c), 9).alias(c) for c in ("recall", "mrr", "ndcg")))


QUERIES = {
    f.__name__: f
    for f in (
        upsert_merge, fill_only_merge, keep_owned_merge, first_wins_edges, replace_edges, dedup_three_tier, source_priority, reconcile, missing_keys, set_difference, identifier_cascade, cascade_delete,
        segment_compaction, snapshot_diff, value_score, rrf_fusion, funnel_rank, score_min_keep, history_budget, context_pack, ir_metrics,
    )
}

_SNAP = "SELECT user_id, max(event_type) AS body, max(event_id) AS meta FROM events WHERE event_id % 3 <> {} GROUP BY 1"
_R2 = lambda x: f"(floor(({x}) * 100 + 0.5) / 100.0)"
ORACLE_SQL = {
    "upsert_merge": f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT *, false AS is_new FROM o WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT *, id NOT IN (SELECT id FROM o) FROM n",
    "fill_only_merge": f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT o.id, coalesce(nullif(o.name, ''), n.name, o.name) AS name, coalesce(nullif(o.segment, ''), n.segment, o.segment) AS segment, coalesce(nullif(o.balance, 0), n.balance, o.balance) AS balance FROM o LEFT JOIN n USING (id)",
    "keep_owned_merge": f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM o WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT n.id, n.name, coalesce(nullif(o.segment, ''), o.segment, ''), n.balance FROM n LEFT JOIN o USING (id)",
    "first_wins_edges": """WITH a AS (SELECT l_orderkey AS citing, l_partkey AS cited, min(l_quantity) AS weight FROM lineitem WHERE l_linenumber > 5 GROUP BY 1, 2), b AS (SELECT l_orderkey AS citing, l_partkey AS cited, min(l_quantity) AS weight FROM lineitem WHERE l_linenumber <= 5 GROUP BY 1, 2)
        SELECT * FROM a UNION ALL SELECT b.* FROM b ANTI JOIN a USING (citing, cited)""",
    "replace_edges": """WITH o AS (SELECT DISTINCT l_orderkey AS citing, l_partkey AS cited, l_quantity AS weight FROM lineitem WHERE l_returnflag = 'R'), n AS (SELECT l_orderkey AS citing, l_partkey AS cited, max(l_quantity) AS weight FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2)
        SELECT * FROM o WHERE citing NOT IN (SELECT citing FROM n) UNION ALL SELECT * FROM n""",
    "dedup_three_tier": f"""WITH r AS ({_RECORDS}), a AS (SELECT * FROM r WHERE doi NOT IN (SELECT doi FROM r WHERE position % 97 = 1 AND doi <> '')),
        b AS (SELECT * FROM a QUALIFY doi = '' OR row_number() OVER (PARTITION BY doi ORDER BY position) = 1),
        c AS (SELECT * FROM b QUALIFY title = '' OR row_number() OVER (PARTITION BY title, year ORDER BY position) = 1),
        d AS (SELECT * FROM c QUALIFY surname = '' OR row_number() OVER (PARTITION BY surname, year, journal ORDER BY position) = 1) SELECT position, doi, title, year FROM d""",
    "source_priority": "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 4 <> 0 THEN 'first' ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 0 THEN 'second' ELSE c_mktsegment END AS segment FROM customer",
    "reconcile": "WITH l AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) SELECT doc_id, 'left_only' AS reason FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l) UNION ALL SELECT doc_id, 'right_only' FROM l WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "missing_keys": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "set_difference": "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'",
    "identifier_cascade": """WITH n AS (SELECT DISTINCT CAST(o_custkey % 2000 AS VARCHAR) AS name FROM orders), c AS (SELECT CAST(c_custkey AS VARCHAR) AS k, c_custkey AS id FROM customer)
        SELECT name, CASE WHEN id IS NULL THEN '' WHEN id % 3 = 0 THEN k WHEN id % 3 = 1 THEN concat('i', k) WHEN id % 2 = 0 THEN concat('d', k) ELSE '' END AS rid,
               CASE WHEN id IS NULL THEN '' WHEN id % 3 = 0 THEN 'rid' WHEN id % 3 = 1 THEN 'identifier' WHEN id % 2 = 0 THEN 'dirname' ELSE '' END AS how FROM n LEFT JOIN c ON k = name""",
    "cascade_delete": "SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1",
    "segment_compaction": "SELECT k, version, deleted, value FROM (SELECT user_id AS k, event_id AS version, event_id % 5 = 0 AS deleted, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE NOT deleted",
    "snapshot_diff": f"""WITH o AS ({_SNAP.format(0)}), n AS ({_SNAP.format(1)}) SELECT user_id, CASE WHEN n.body IS NULL THEN 'delete' WHEN o.body IS NULL THEN 'insert' WHEN o.body <> n.body THEN 'refresh' WHEN o.meta IS DISTINCT FROM n.meta THEN 'meta_only' ELSE 'keep' END AS action FROM o FULL JOIN n USING (user_id)""",
    "value_score": f"""WITH p AS ({_SCORED}), q AS (SELECT doi, ai,
            {_R2("least(5.0, CASE WHEN quartile LIKE 'Q%' THEN 5 - CAST(substr(quartile, 2, 1) AS DOUBLE) WHEN impact_factor >= 10 THEN 4.0 WHEN impact_factor >= 5 THEN 3.0 WHEN impact_factor >= 2 THEN 2.0 WHEN impact_factor > 0 THEN 1.0 END + CASE WHEN cluster = 1 THEN 1.0 ELSE 0.0 END)")} AS a0,
            CASE WHEN quartile NOT LIKE 'Q%' AND impact_factor <= 0 THEN true ELSE false END AS no_band,
            {_R2("least(1.0, log10(greatest(1.0, CAST(times_cited AS DOUBLE)) + 1) / 2.5)")} AS b, {_R2("ai")} AS c,
            {_R2("CASE WHEN TRY_CAST(year AS BIGINT) IS NULL THEN NULL WHEN greatest(0, 2026 - TRY_CAST(year AS BIGINT)) <= 3 THEN 1.0 WHEN greatest(0, 2026 - TRY_CAST(year AS BIGINT)) <= 10 THEN 0.7 ELSE 0.4 END")} AS d,
            {_R2("CASE WHEN paper_rank <= 0 THEN NULL WHEN paper_rank < 1e-4 THEN 1.0 WHEN paper_rank < 1e-3 THEN 1 + 2 * (paper_rank - 1e-4) / 9e-4 WHEN paper_rank < 1e-2 THEN 3 + 2 * (paper_rank - 1e-3) / 9e-3 ELSE 5.0 END")} AS e,
            {_R2("CASE WHEN library_citations > 0 THEN least(5.0, 5 * log10(CAST(library_citations AS DOUBLE) + 1)) END")} AS f FROM p),
        r AS (SELECT doi, ai, CASE WHEN no_band THEN NULL ELSE a0 END AS a, b, c, d, e, f FROM q),
        w AS (SELECT doi, ai, coalesce(a * CAST(0.2 AS DOUBLE) / 5, 0) + coalesce(b * CAST(0.15 AS DOUBLE), 0) + coalesce(c * CAST(0.25 AS DOUBLE) / 5, 0) + coalesce(d * CAST(0.1 AS DOUBLE), 0) + coalesce(e * CAST(0.1 AS DOUBLE) / 5, 0) + coalesce(f * CAST(0.05 AS DOUBLE) / 5, 0) AS total,
            CASE WHEN a IS NULL THEN 0 ELSE CAST(0.2 AS DOUBLE) END + CAST(0.15 AS DOUBLE) + CASE WHEN c IS NULL THEN 0 ELSE CAST(0.25 AS DOUBLE) END + CASE WHEN d IS NULL THEN 0 ELSE CAST(0.1 AS DOUBLE) END + CASE WHEN e IS NULL THEN 0 ELSE CAST(0.1 AS DOUBLE) END + CASE WHEN f IS NULL THEN 0 ELSE CAST(0.05 AS DOUBLE) END AS weight FROM r),
        s AS (SELECT doi, ai, {_R2("greatest(0.0, least(5.0, 5 * total / weight))")} AS score FROM w)
        SELECT doi, score, CASE WHEN score >= 2.5 AND ai IS NOT NULL THEN 'L2' ELSE 'L1' END AS level FROM s""",
    "rrf_fusion": f"""WITH h AS ({_HITS}), r AS (SELECT *, row_number() OVER (PARTITION BY query, channel ORDER BY score DESC, key) AS rank FROM h),
        w AS (SELECT *, CASE channel WHEN 'click' THEN 1.0 WHEN 'vector' THEN 1.0 WHEN 'purchase' THEN 0.5 WHEN 'view' THEN 0.6 ELSE 0.0 END AS wt, CASE channel WHEN 'vector' THEN -1 WHEN 'click' THEN 0 WHEN 'purchase' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS pos FROM r)
        SELECT query, key, floor(sum(CAST(wt AS DOUBLE) / (60 + rank)) * 1000000000 + 0.5) / 1000000000.0 AS rrf, first(channel ORDER BY pos, channel) AS source, first(snippet ORDER BY length(snippet) DESC, snippet DESC) AS snippet FROM w GROUP BY 1, 2""",
    "funnel_rank": f"""WITH c AS ({_CAND}), p AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query ORDER BY rerank DESC NULLS LAST, key) <= 50),
        s AS (SELECT query, key, CAST(0.40 AS DOUBLE) * coalesce(rerank, 0.0) + CAST(0.15 AS DOUBLE) * coalesce(paper_rank / nullif(max(paper_rank) OVER (PARTITION BY query), 0), 0.0) + CAST(0.20 AS DOUBLE) * coalesce(times_cited / nullif(max(times_cited) OVER (PARTITION BY query), 0), 0.0) AS f FROM p)
        SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY f DESC, key) AS BIGINT) AS nth, key, floor(f * 1000000000 + 0.5) / 1000000000.0 AS final FROM s QUALIFY nth <= 20""",
    "score_min_keep": f"WITH c AS ({_CAND}), n AS (SELECT *, count(*) FILTER (rerank >= 0.0999) OVER (PARTITION BY query) AS n FROM c) SELECT query, key, rerank FROM n WHERE rerank >= 0.0999 OR n < 300",
    "history_budget": """SELECT conv_id, turn FROM (SELECT *, sum(greatest(1, length(text) // 2)) OVER w AS s, row_number() OVER w AS rn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE s <= 300 OR rn = 1""",
    "ir_metrics": f"""WITH r AS ({_RANKED}), f AS (SELECT query, p AS item, min(rank) AS rank FROM r WHERE key % 3 = 0 GROUP BY 1, 2)
        SELECT query, floor(count(*) FILTER (rank <= 10) / count(*) * 1000000000 + 0.5) / 1000000000.0 AS recall, floor(1.0e0 / min(rank) * 1000000000 + 0.5) / 1000000000.0 AS mrr,
               floor(sum(CASE WHEN rank <= 10 THEN 1.0e0 / log2(rank + 1) ELSE 0 END) / list_sum([1.0e0 / log2(i + 1) FOR i IN range(1, least(count(*), 10) + 1)]) * 1000000000 + 0.5) / 1000000000.0 AS ndcg FROM f GROUP BY query""",
}
