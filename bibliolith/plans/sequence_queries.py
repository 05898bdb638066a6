"""Queries of ordered-row operators, audits, text repair and staged retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import repair, segment, text
from ..operators import audit, communities, ranking, recall, search, sequence, similar
from ..schema import rounded
from .standins import EDGES, edges, table, view

_PARAS = """SELECT conv_id AS doc_id, turn AS idx, CASE WHEN turn % 5 = 3 AND conv_id % 2 = 0 THEN 'Acknowledgements to all' WHEN turn % 7 = 5 THEN 'Funding' ELSE text END AS text, CASE WHEN turn % 4 = 2 AND conv_id % 3 = 0 THEN 'References' ELSE role END AS section,
    turn % 7 = 5 AND conv_id % 3 = 1 AS is_heading FROM conversations"""
_BLOCKS = """SELECT l_orderkey AS doc_id, 1 + l_linenumber % 2 AS page, l_orderkey * 10 + l_linenumber AS block, CASE WHEN l_linenumber = 7 THEN 10.0e0 ELSE CAST(l_partkey % 2 * 300 + l_suppkey % 40 AS DOUBLE) END AS x0, CAST(l_quantity * 10 AS DOUBLE) AS y0,
    CASE WHEN l_linenumber = 7 THEN 590.0e0 ELSE CAST(l_partkey % 2 * 300 + l_suppkey % 40 + 200 AS DOUBLE) END AS x1, CAST(l_quantity * 10 + 9 AS DOUBLE) AS y1, 600.0e0 AS width FROM lineitem"""
_MANY = "SELECT o_custkey % 40 AS doc_id, 1 AS page, o_orderkey AS block, CAST(o_orderkey % 4 * 60 + CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 250 ELSE 0 END AS DOUBLE) AS x0, CAST(o_orderkey % 97 AS DOUBLE) AS y0, CAST(o_orderkey % 4 * 60 + CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 250 ELSE 0 END + 100 AS DOUBLE) AS x1, CAST(o_orderkey % 97 + 5 AS DOUBLE) AS y1, 600.0e0 AS width FROM orders"
_STEPS = "SELECT o_custkey AS id, o_orderkey AS step, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey END AS i, CASE WHEN o_orderkey % 4 = 1 OR o_orderkey % 3 = 0 AND o_orderkey % 2 = 1 THEN NULL ELSE o_orderkey END AS j FROM orders"
_EVIDENCE = """SELECT CASE WHEN l_linenumber < 5 THEN 'spacing' ELSE 'formula' END AS category, CASE WHEN l_partkey % 2 = 0 THEN 'dict' ELSE 'regex' END AS pattern_type, concat('w', CAST(l_partkey % 50 AS STRING)) AS pattern, concat('v', CAST(l_partkey % 50 AS STRING)) AS replacement,
    l_orderkey AS paper, CASE WHEN l_suppkey % 7 < l_partkey % 7 THEN concat('w', CAST(l_partkey % 50 AS STRING)) ELSE concat('v', CAST(l_partkey % 50 AS STRING)) END AS before, CASE WHEN l_suppkey % 7 < l_partkey % 7 THEN concat('v', CAST(l_partkey % 50 AS STRING)) ELSE concat('w', CAST(l_partkey % 50 AS STRING)) END AS after FROM lineitem"""
_RULES = """SELECT concat('r', CAST(p_partkey AS STRING)) AS rule_id, 'spacing' AS category, 'regex' AS pattern_type, p_brand AS pattern, CAST(p_partkey % 3 AS STRING) AS replacement, CASE p_partkey % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'builtin' WHEN 2 THEN 'learned' ELSE 'other' END AS level,
    CAST(p_size AS DOUBLE) / 50 AS confidence, CAST(p_partkey % 2 AS INT) AS version, CAST(p_partkey % 10 AS BIGINT) AS hits FROM part"""
_LAYER = """SELECT doc_id, doc_id AS para_id, CASE doc_id % 5 WHEN 0 THEN concat(text, chr(3)) WHEN 1 THEN concat(text, ' 1 5 0 <sup>ab</sup>') ELSE text END AS text, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat(text, '�') ELSE text END AS page_text FROM documents"""


def before_closing(spark, sf):
    return sequence.before_closing(view(spark, sf, _PARAS)).select("doc_id", "idx")


def greedy_batches(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("n"))
    return sequence.batches(rows, "conv_id", "turn", "n", 3, 400)


def page_furniture(spark, sf):
    b = view(spark, sf, "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS STRING) ELSE o_orderpriority END AS text, CAST(o_orderkey % 800 AS DOUBLE) AS y0, CAST(o_orderkey % 800 + 10 AS DOUBLE) AS y1, 800.0e0 AS height, 1 + o_orderkey % 3 AS page FROM orders")
    return b.select("id", sequence.is_page_furniture(*(F.col(c) for c in ("text", "y0", "y1", "height", "page"))).alias("out"))


def page_columns(spark, sf):
    return sequence.page_columns(view(spark, sf, _MANY)).select("doc_id", "page", "columns", rounded(F.col("threshold"), 3).alias("threshold"))


def reading_order(spark, sf):
    return sequence.reading_order(view(spark, sf, _BLOCKS)).select("doc_id", "block", "nth")


def stitched_paragraphs(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), F.concat(F.when(F.col("turn") % 3 == 1, "and ").otherwise("So "), F.lit("it is"), F.when(F.col("turn") % 2 == 1, ".").otherwise("")).alias("text"))
    return sequence.stitched(rows)


def alignment_regions(spark, sf):
    return sequence.regions(view(spark, sf, _STEPS))


def reference_list(spark, sf):
    b = view(spark, sf, "SELECT l_orderkey AS doc_id, l_linenumber AS nth, CASE l_linenumber % 3 WHEN 0 THEN 'runs on' ELSE concat('[', CAST(l_linenumber AS STRING), '] ', l_returnflag, ' [', CAST(l_linenumber + 10 AS STRING), '] two') END AS text FROM lineitem")
    return sequence.references(b)


def head_tail_drift(spark, sf):
    d = sequence.head_and_tail(table(spark, sf, "orders"), ["o_orderkey"], "o_totalprice")
    return d.select(*(rounded(F.col(c), 4).alias(c) for c in ("head", "tail", "drift")))


def covered_ranges(spark, sf):
    a = view(spark, sf, "SELECT o_custkey AS id, o_orderkey AS paragraph, o_orderkey % 1000 AS first_line, o_orderkey % 1000 + 40 AS last_line FROM orders WHERE o_orderstatus = 'F'")
    b = view(spark, sf, "SELECT o_custkey AS id, o_orderkey AS name, o_orderkey % 1000 AS first_line, o_orderkey % 1000 + 90 AS last_line FROM orders WHERE o_orderstatus <> 'F'")
    return sequence.covered(a, b).select("id", "paragraph", F.array_join(F.transform("others", lambda x: x.cast("string")), ",").alias("others"))


def near_paragraphs(spark, sf):
    d = table(spark, sf, "documents")
    rows = d.select(F.pmod("doc_id", F.lit(50)).alias("doc_id"), F.col("doc_id").alias("idx"), "text", F.when(F.col("doc_id") % 3 == 0, "Abstract").otherwise("").alias("section"), F.lit(False).alias("is_heading"))
    return audit.near_paragraphs(rows)


def layer_audit(spark, sf):
    a = audit.text_layer_audit(view(spark, sf, _LAYER).withColumn("text", F.translate("text", "$", "")).withColumn("page_text", F.translate("page_text", "$", "")))
    return a.select("doc_id", "judged", "out_ctrl", "out_hole", "out_sup_word", "page_ctrl", "page_fffd")


def layer_probe(spark, sf):
    pages = view(spark, sf, f"SELECT doc_id % 300 AS doc_id, doc_id AS page, page_text AS text FROM ({_LAYER}) l")
    return audit.probe(pages.withColumn("page", F.floor(F.col("page") / 300) + 1)).select("doc_id", "pages", "chars", "score", "language", "needs_ocr")


def quality_assertions(spark, sf):
    d = view(spark, sf, "SELECT doc_id, concat(text, CASE WHEN doc_id % 2 = 0 THEN '$' ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN '<sup>ab</sup><sup>cd</sup><sup>ef</sup>' ELSE '' END) AS text, doc_id % 90 AS paras, doc_id % 7 AS issues, doc_id % 4 AS markers FROM documents")
    bad = audit.assertions(F.translate("text", "", ""), F.col("paras"), F.col("issues"), F.col("markers"), F.lit(1))
    return d.select("doc_id", F.array_join(bad, ",").alias("failed"))


def majority_votes(spark, sf):
    return audit.majority(view(spark, sf, "SELECT l_orderkey AS k, l_suppkey % 7 AS v FROM lineitem"), "k", "v")


def multiset_mismatch(spark, sf):
    li = view(spark, sf, "SELECT l_suppkey AS k, l_suppkey % 7 AS item, l_returnflag AS f FROM lineitem")
    return audit.multiset_distance(li.where("f = 'R'"), li.where("f = 'A'"), "k")


def rule_evidence(spark, sf):
    r = audit.rule_evidence(view(spark, sf, _EVIDENCE))
    return r.select("category", "pattern_type", "pattern", "replacement", "papers", "evidence", rounded(F.col("confidence"), 2).alias("confidence"))


def merged_rules(spark, sf):
    from ..operators import rules

    r = view(spark, sf, _RULES).withColumn("evidence", F.array(F.col("replacement")))
    return rules.merge_rules(r).select("pattern", "replacement", "rule_id", "level", "hits", F.size("dropped").cast("bigint").alias("lost"))


def batch_budget(spark, sf):
    return audit.budget(view(spark, sf, "SELECT CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS pages FROM part"), 1200)


def block_consistency(spark, sf):
    a = view(spark, sf, "SELECT conv_id AS doc_id, turn AS place, concat('## ', text) AS text FROM conversations WHERE conv_id % 5 <> 0 OR turn < 3")
    b = view(spark, sf, "SELECT conv_id AS doc_id, turn AS place, CASE WHEN (conv_id + turn) % 6 = 0 THEN 'other' ELSE concat('  ', text) END AS text FROM conversations")
    return audit.consistency(a, b)[0]


def store_absorbs(spark, sf):
    from ..operators import merge

    store = view(spark, sf, "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 4 = 0 THEN 0.0e0 ELSE c_acctbal END AS balance FROM customer")
    records = view(spark, sf, "SELECT o_custkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderpriority END AS name, CASE WHEN o_orderkey % 3 = 0 THEN 0.0e0 ELSE o_totalprice END AS balance, o_orderkey AS position FROM orders")
    return merge.absorb(store, records, "id", ["name", "balance"])


def trimmed_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(segment.trimmed(F.col("text"), 500).cast("binary")).alias("md5"))


def window_texts(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.length(segment.window_around(F.col("text"), F.instr("text", "an") - 1, 200, 400)).cast("bigint").alias("n"))


def query_words(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(text.query_words(F.col("text")), " ").alias("words"))


def passages(spark, sf):
    p = view(spark, sf, "SELECT p_partkey AS id, p_name AS title, p_type AS authors, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS journal, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE '2020' END AS year, p_type AS abstract FROM part")
    c = {n: F.col(n) for n in ("title", "journal", "year", "abstract")}
    return p.select("id", text.passage(c["title"], F.split("authors", " "), c["journal"], c["year"], c["abstract"]).alias("passage"), text.embed_prefix(c["title"], c["journal"], F.lit(" ")).alias("prefix"), text.text_to_embed(c["title"], c["abstract"]).alias("embed"))


def joined_word_counts(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(text.joined_words(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def bare_scripts(spark, sf):
    p = table(spark, sf, "part")
    d = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("x^{"), "p_brand", F.lit("} and $y_{2}$ and z_{"), F.col("p_partkey").cast("string"), F.lit("}")).alias("t"))
    return d.select("id", repair.wrap_bare_scripts(F.col("t")).alias("fixed"), repair.count_bare_scripts(F.col("t")).alias("n"))


def normal_forms(spark, sf):
    d = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" $\\mathrm{"), "p_brand", F.lit("}$ 1 5 0 é")).alias("t"))
    return d.select("id", repair.normalized(F.col("t")).alias("tight"), repair.normalized_words(F.col("t")).alias("spaced"))


def staged_search(spark, sf):
    q = view(spark, sf, "SELECT n_nationkey AS query_id, CASE WHEN n_nationkey % 3 = 0 THEN 'the and' WHEN n_nationkey % 3 = 1 THEN concat('der ', n_name) ELSE concat(n_name, ' xy') END AS query FROM nation")
    r = recall.search_staged(table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("content")), q, 1_000_000)
    return r.groupBy("query_id", "stage").agg(F.count(F.lit(1)).alias("n"))


def phrase_ranking(spark, sf):
    return recall.phrase_ranked(table(spark, sf, "documents"), "And the", 20).select("doc_id", "nth")


def neighbour_recall(spark, sf):
    h = view(spark, sf, "SELECT o_custkey % 30 AS query, CAST(o_orderkey % 200 AS STRING) AS doi, min(o_orderkey) AS pos FROM orders GROUP BY 1, 2")
    hits = h.selectExpr("query", "doi", "row_number() over (partition by query order by pos) as nth").where("nth <= 5")
    notes = h.selectExpr("query", "doi", "row_number() over (partition by query order by doi) as nth", "concat('s', doi) as snippet")
    return recall.neighbour_hits(hits, edges(spark, sf), notes)


_CHANNEL = "SELECT o_custkey % 50 AS query, o_orderkey % 40 AS key, min(o_orderkey) AS pos, max(o_orderpriority) AS snippet FROM orders WHERE o_orderkey % 3 = {} GROUP BY 1, 2"


def fused_recall(spark, sf):
    ranked = lambda k: view(spark, sf, _CHANNEL.format(k)).selectExpr("query", "key", "snippet", "row_number() over (partition by query order by pos) as rank")
    score = view(spark, sf, "SELECT o_custkey % 50 AS query, o_orderkey % 40 AS key, max(o_totalprice) AS rerank_score FROM orders WHERE o_orderkey % 5 > 0 GROUP BY 1, 2")
    return recall.recall({"notes": ranked(0), "vector": ranked(1), "meta": ranked(2)}, 5, score).select("query", "nth", "key", rounded(F.col("rrf"), 9).alias("rrf"), "source")


def verified_pairs(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("left"), F.when(F.col("item_id") % 3 == 0, F.col("text")).when(F.col("item_id") % 3 == 1, F.array_join(F.reverse(F.split("text", " ")), " ")).otherwise(F.substring("text", 1, 60)).alias("right"))
    return similar.verdict_counts(similar.verify_pairs(b))


def community_sizes(spark, sf):
    # customers and suppliers are counted before they meet: their pairs grow with the product of both tables
    pairs = view(spark, sf, """SELECT a, b, sum(x * y) AS weight FROM (SELECT c_custkey % 25 AS k, c_nationkey AS a, count(*) AS x FROM customer GROUP BY 1, 2) c
        JOIN (SELECT s_suppkey % 25 AS k, s_nationkey AS b, count(*) AS y FROM supplier GROUP BY 1, 2) s ON c.k = s.k GROUP BY a, b""")
    return communities.cluster(pairs, rounds=4)[0].groupBy("community").agg(F.count(F.lit(1)).alias("n"))


def metric_gate(spark, sf):
    ranked = view(spark, sf, "SELECT o_custkey AS query, o_orderkey % 10 / 10.0e0 AS recall, o_orderkey % 7 / 7.0e0 AS mrr, 0.5e0 AS ndcg FROM orders")
    return ranking.gate(ranked, ranking.Gate(), (0.4, 0.4)).select(*(rounded(F.col(c), 9).alias(c) for c in ("recall", "mrr", "ndcg")), "passed")


def cjk_pairs(spark, sf):
    d = view(spark, sf, "SELECT p_partkey AS id, concat('研究', p_brand, '方法研究', p_name, '结果') AS t FROM part")
    return d.select("id", F.array_join(search.cjk_grams(F.col("t")), ",").alias("grams"), F.array_join(search.anchors(F.col("t")), ",").alias("anchors"))


QUERIES = {
    f.__name__: f
    for f in (
        before_closing, greedy_batches, page_furniture, page_columns, reading_order, stitched_paragraphs, alignment_regions, reference_list, head_tail_drift, covered_ranges, near_paragraphs, layer_audit, layer_probe,
        quality_assertions, majority_votes, multiset_mismatch, rule_evidence, merged_rules, batch_budget, block_consistency, store_absorbs, trimmed_texts, window_texts, query_words, passages, joined_word_counts, bare_scripts,
        normal_forms, staged_search, phrase_ranking, neighbour_recall, fused_recall, verified_pairs, community_sizes, metric_gate, cjk_pairs,
    )
}

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_HIDDEN = ", ".join(f"'{w}'" for w in text.HIDDEN_WORDS)
_CTRL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]"
_BREAKS = ["chr(10) || chr(10)", "chr(10)", "'。'", "'！'", "'？'", "'；'", "'. '", "'! '", "'? '", "'; '", "'，'", "', '", "' '"]
_ENDS = ", ".join(f"CASE WHEN contains(h, {b}) THEN length(h) - strpos(reverse(h), reverse({b})) + 1 ELSE 0 END" for b in _BREAKS)
ORACLE_SQL = {
    "before_closing": f"""WITH p AS ({_PARAS}), t AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total FROM p), c AS (SELECT *, (text = 'Acknowledgements to all' AND (is_heading OR total > 4 AND idx >= total * 0.5 OR true)) OR (text = 'Funding' AND (is_heading OR total > 4 AND idx >= total * 0.5))
        OR (section = 'References' AND (is_heading OR (total > 4 AND idx >= total * 0.5) OR length(trim(text)) <= 200)) AS closing FROM t), k AS (SELECT doc_id, min(idx) FILTER (closing) AS cut FROM c GROUP BY 1)
        SELECT doc_id, idx FROM c JOIN k USING (doc_id) WHERE (cut IS NULL OR idx < cut) AND section <> 'References'""",
    "page_furniture": """SELECT o_orderkey AS id, (o_orderkey % 3 = 0 AND o_orderkey % 800 + 10 > 800 * 0.955) OR (1 + o_orderkey % 3 <> 1 AND (o_orderkey % 800 < 800 * 0.08 OR o_orderkey % 800 + 10 > 800 * 0.955)) AS out FROM orders""",
    "page_columns": f"""WITH b AS ({_MANY}), n AS (SELECT *, (x0 + x1) / 2 AS c FROM b WHERE x1 - x0 < width * 0.5), g AS (SELECT *, lead(c) OVER (PARTITION BY doc_id, page ORDER BY c, block) AS nx FROM n), w AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page) AS n, row_number() OVER (PARTITION BY doc_id, page ORDER BY nx - c DESC NULLS LAST, c) AS r FROM g)
        SELECT doc_id, page, CAST(CASE WHEN n >= 6 AND nx - c > width * 0.12 THEN 2 ELSE 1 END AS BIGINT) AS columns, CASE WHEN n >= 6 AND nx - c > width * 0.12 THEN floor((c + nx) / 2 * 1000 + 0.5) / 1000.0 END AS threshold FROM w WHERE r = 1""",
    "alignment_regions": f"""WITH p AS ({_STEPS}), m AS (SELECT *, sum(CASE WHEN i IS NOT NULL AND j IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY step) AS run FROM p)
        SELECT id, min(step) AS first, CASE WHEN min(i) IS NOT NULL AND min(j) IS NOT NULL THEN 'shift' WHEN min(i) IS NOT NULL THEN 'extra' ELSE 'missing' END AS kind, min(i) AS left_from, max(i) AS left_to, min(j) AS right_from, max(j) AS right_to FROM m WHERE i IS NULL OR j IS NULL GROUP BY id, run""",
    "head_tail_drift": """WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_orderkey) AS n, count(*) OVER () AS total FROM orders), m AS (SELECT avg(v) FILTER (n <= greatest(1, total // 10)) AS h, avg(v) FILTER (n > total - greatest(1, total // 10)) AS t FROM r)
        SELECT floor(h * 10000 + 0.5) / 10000.0 AS head, floor(t * 10000 + 0.5) / 10000.0 AS tail, floor(t / h * 10000 + 0.5) / 10000.0 AS drift FROM m""",
    "covered_ranges": """WITH a AS (SELECT o_custkey AS id, o_orderkey AS p, o_orderkey % 1000 AS f FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS id, o_orderkey AS q, o_orderkey % 1000 AS f FROM orders WHERE o_orderstatus <> 'F')
        SELECT a.id, p AS paragraph, string_agg(CAST(q AS VARCHAR), ',' ORDER BY q) AS others FROM a JOIN b ON a.id = b.id AND a.f <= b.f + 90 AND b.f <= a.f + 40 GROUP BY 1, 2 HAVING count(*) > 1""",
    "layer_audit": f"""WITH l AS (SELECT doc_id, replace(text, '$', '') AS t, replace(page_text, '$', '') AS p FROM ({_LAYER})), j AS (SELECT *, trim(coalesce(t, '')) <> '' AND trim(coalesce(p, '')) <> '' AS judged FROM l)
        SELECT doc_id, judged, CAST(CASE WHEN judged THEN len(regexp_extract_all(t, '{_CTRL}')) ELSE 0 END AS BIGINT) AS out_ctrl, CAST(CASE WHEN judged THEN len(regexp_extract_all(t, '[0-9][ \\t]{{1,3}}')) - len(regexp_extract_all(t, '[0-9][ \\t]{{1,3}}([^0-9 \\t]|[ \\t]|$)')) ELSE 0 END AS BIGINT) AS out_hole,
        CAST(CASE WHEN judged THEN len(regexp_extract_all(t, '<sup>[A-Za-z]{{2,}}</sup>')) ELSE 0 END AS BIGINT) AS out_sup_word, CAST(CASE WHEN judged THEN len(regexp_extract_all(p, '{_CTRL}')) ELSE 0 END AS BIGINT) AS page_ctrl, CAST(CASE WHEN judged AND doc_id % 4 = 1 THEN 1 ELSE 0 END AS BIGINT) AS page_fffd FROM j""",
    "majority_votes": "SELECT k, first(v ORDER BY n DESC, v) AS v, max(n) AS n FROM (SELECT l_orderkey AS k, l_suppkey % 7 AS v, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    "multiset_mismatch": "SELECT k, CAST(sum(abs(a - b)) AS BIGINT) AS mismatch FROM (SELECT l_suppkey AS k, l_suppkey % 7, count(*) FILTER (l_returnflag = 'R') AS a, count(*) FILTER (l_returnflag = 'A') AS b FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1, 2) GROUP BY 1",
    "rule_evidence": f"""WITH g AS (SELECT category, pattern_type, pattern, replacement, count(*) FILTER (pattern_type <> 'dict' OR before = pattern) AS f, count(*) FILTER (pattern_type = 'dict' AND before = replacement) AS b, count(DISTINCT paper) AS papers FROM ({_EVIDENCE}) GROUP BY 1, 2, 3, 4), r AS (SELECT *, greatest(f, b) * 1.0e0 / (f + b) AS ratio FROM g)
        SELECT category, pattern_type, CASE WHEN b > f THEN replacement ELSE pattern END AS pattern, CASE WHEN b > f THEN pattern ELSE replacement END AS replacement, papers, greatest(f, b) AS evidence, floor(CASE WHEN pattern_type = 'dict' THEN round(least(0.9e0, 0.5e0 * greatest(f, b) / 3 * ratio), 2) WHEN f >= 3 THEN 0.85e0 ELSE 0.6e0 END * 100 + 0.5) / 100.0 AS confidence FROM r WHERE ratio >= 0.75""",
    "merged_rules": f"""WITH r AS (SELECT *, CASE level WHEN 'user' THEN 1 WHEN 'builtin' THEN 2 WHEN 'learned' THEN 3 ELSE 99 END AS p FROM ({_RULES})), s AS (SELECT pattern, replacement, sum(hits) AS hits, first(struct_pack(p := p, c := -confidence, v := -version, id := rule_id, level := level) ORDER BY p, confidence DESC, version DESC, rule_id) AS b FROM r GROUP BY 1, 2)
        SELECT pattern, first(replacement ORDER BY b) AS replacement, first(b.id ORDER BY b) AS rule_id, first(b.level ORDER BY b) AS level, CAST(first(hits ORDER BY b) AS BIGINT) AS hits, count(*) - 1 AS lost FROM s GROUP BY 1""",
    "batch_budget": "SELECT count(*) AS jobs, CAST(sum(CASE WHEN p_size % 7 <> 0 THEN p_size END) AS BIGINT) AS pages, CAST(sum(CASE WHEN p_size % 7 <> 0 THEN p_size END) * 1200 AS BIGINT) AS tokens FROM part",
    "block_consistency": """WITH b AS (SELECT conv_id AS doc_id, conv_id % 5 <> 0 OR turn < 3 AS has, (conv_id + turn) % 6 = 0 AND lower(regexp_replace(text, '\\s+', '', 'g')) <> 'other' AS differs FROM conversations) SELECT doc_id, count(*) FILTER (has) AS expected, count(*) AS found, count(*) FILTER (has AND differs) AS mismatches, count(*) FILTER (has AND differs) = 0 AND count(*) FILTER (has) = count(*) AS ok FROM b GROUP BY 1""",
    "store_absorbs": """WITH r AS (SELECT o_custkey AS id, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderkey % 2 <> 0) AS name, arg_min(o_totalprice, o_orderkey) FILTER (o_orderkey % 3 <> 0 AND o_totalprice <> 0) AS balance FROM orders GROUP BY 1)
        SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN coalesce(r.name, '') ELSE c_name END AS name, CASE WHEN c_custkey % 4 = 0 OR c_acctbal = 0 THEN coalesce(r.balance, 0.0) ELSE c_acctbal END AS balance FROM customer LEFT JOIN r ON r.id = c_custkey""",
    "trimmed_texts": f"""WITH d AS (SELECT doc_id, text, substr(text, 1, 500) AS h FROM documents), e AS (SELECT *, [x FOR x IN [{_ENDS}] IF x >= 300] AS ends FROM d), p AS (SELECT doc_id, text, h, [y FOR y IN [regexp_replace(substr(h, 1, x), '\\s+$', '') FOR x IN ends] IF y <> '' AND length(regexp_replace(y, '[^$]', '', 'g')) % 2 = 0] AS pieces FROM e)
        SELECT doc_id, md5(CASE WHEN length(text) <= 500 THEN text ELSE coalesce(pieces[1], h) END) AS md5 FROM p""",
    "query_words": f"SELECT item_id, coalesce(array_to_string([x FOR x IN regexp_extract_all(lower(text), '[a-z]{{2,}}') IF x NOT IN ({_STOP})], ' '), '') AS words FROM benchmark",
    "passages": """SELECT p_partkey AS id, concat_ws(' | ', p_name, array_to_string(list_slice(string_split(p_type, ' '), 1, 3), ' '), CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE '2020' END, p_type) AS passage,
        concat('[', concat_ws(' | ', p_name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END), ']', chr(10)) AS prefix, concat(p_name, '. ', p_type) AS embed FROM part""",
    "joined_word_counts": f"""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{6,}}')) AS word FROM documents), d AS (SELECT DISTINCT word FROM w), k AS (SELECT DISTINCT word FROM d, (SELECT unnest([{_HIDDEN}]) AS s) WHERE strpos(word, s) BETWEEN 3 AND length(word) - length(s) - 1) SELECT word, count(*) AS n FROM w JOIN k USING (word) GROUP BY 1""",
    "bare_scripts": "SELECT p_partkey AS id, concat('x$^{', p_brand, '}$ and $y_{2}$ and z$_{', p_partkey, '}$') AS fixed, CAST(2 AS BIGINT) AS n FROM part",
    "normal_forms": "SELECT p_partkey AS id, concat(regexp_replace(lower(concat(p_name, p_brand)), '[^a-z0-9]+', '', 'g'), '150e') AS tight, concat(trim(regexp_replace(lower(concat(p_name, ' ', p_brand)), '[^a-z0-9]+', ' ', 'g')), '150 e') AS spaced FROM part",
    "staged_search": """WITH q AS (SELECT n_nationkey AS query_id, unnest(CASE WHEN n_nationkey % 3 = 0 THEN ['the', 'and'] WHEN n_nationkey % 3 = 1 THEN list_distinct(['der'] || string_split(lower(n_name), ' ')) ELSE list_distinct(string_split(lower(n_name), ' ') || ['xy']) END) AS term FROM nation),
        h AS (SELECT query_id, doc_id, count(*) AS hits FROM q JOIN documents d ON contains(lower(d.text), term) AND length(term) >= 3 GROUP BY 1, 2), n AS (SELECT query_id, count(*) AS terms FROM q GROUP BY 1), s AS (SELECT query_id, CASE WHEN hits = terms THEN 1 ELSE 2 END AS stage FROM h JOIN n USING (query_id))
        SELECT query_id, CAST(stage AS BIGINT) AS stage, count(*) AS n FROM s WHERE stage = (SELECT min(stage) FROM s x WHERE x.query_id = s.query_id) GROUP BY 1, 2""",
    "phrase_ranking": """WITH h AS (SELECT doc_id, (length(lower(text)) - length(replace(lower(text), 'and the', ''))) / 7.0e0 AS tf, greatest(length(text) - 2, 1) AS dl, (SELECT avg(greatest(length(text) - 2, 1)) FROM documents) AS a FROM documents WHERE contains(lower(text), 'and the'))
        SELECT doc_id, row_number() OVER (ORDER BY tf / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / a)) DESC, doc_id) AS nth FROM h QUALIFY nth <= 20""",
    "neighbour_recall": f"""WITH h AS (SELECT o_custkey % 30 AS query, CAST(o_orderkey % 200 AS VARCHAR) AS doi, min(o_orderkey) AS pos FROM orders GROUP BY 1, 2), s AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY pos) AS nth FROM h QUALIFY nth <= 3), e AS ({EDGES}),
        nb AS (SELECT citing AS doi, cited AS nb, 0 AS d FROM e WHERE citing IN (SELECT doi FROM s) QUALIFY row_number() OVER (PARTITION BY citing ORDER BY cited) <= 8 UNION ALL SELECT cited, citing, 1 FROM e WHERE cited IN (SELECT doi FROM s) QUALIFY row_number() OVER (PARTITION BY cited ORDER BY citing) <= 8),
        a AS (SELECT query, nb, min(struct_pack(n := nth, d := d, x := nb)) AS pos FROM s JOIN nb USING (doi) GROUP BY 1, 2), r AS (SELECT query, nb, row_number() OVER (PARTITION BY query ORDER BY pos) AS rank FROM a QUALIFY rank <= 3),
        t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY doi) AS k FROM h) SELECT r.query, r.nb AS key, CAST(r.rank AS INT) AS rank, concat('s', r.nb) AS snippet FROM r JOIN t ON t.query = r.query AND t.doi = r.nb AND t.k <= 5 WHERE r.nb <> (SELECT doi FROM s WHERE s.query = r.query AND s.nth = 1)""",
    "fused_recall": f"""WITH c AS ({' UNION ALL '.join(f"SELECT query, key, {k} AS ch, {w}e0 AS w, row_number() OVER (PARTITION BY query ORDER BY pos) AS rank FROM ({_CHANNEL.format(k)})" for k, w in ((0, 1.0), (1, 1.0), (2, 0.5)))}), f AS (SELECT query, key, sum(w / (60 + rank)) AS rrf, min(CASE ch WHEN 1 THEN -1 ELSE ch END) AS src FROM c GROUP BY 1, 2),
        p AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query ORDER BY floor(rrf * 1000000000000), key) >= 0), o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rrf DESC, key) AS n FROM p QUALIFY n <= 15), s AS (SELECT o_custkey % 50 AS query, o_orderkey % 40 AS key, max(o_totalprice) AS sc FROM orders WHERE o_orderkey % 5 > 0 GROUP BY 1, 2)
        SELECT query, row_number() OVER (PARTITION BY query ORDER BY sc DESC NULLS LAST, rrf DESC, key) AS nth, key, floor(rrf * 1000000000 + 0.5) / 1000000000.0 AS rrf, CASE src WHEN -1 THEN 'vector' WHEN 0 THEN 'notes' ELSE 'meta' END AS source FROM o LEFT JOIN s USING (query, key) QUALIFY nth <= 5""",
    "metric_gate": """WITH m AS (SELECT avg(o_orderkey % 10 / 10.0e0) AS r, avg(o_orderkey % 7 / 7.0e0) AS m FROM orders) SELECT floor(r * 1000000000 + 0.5) / 1000000000.0 AS recall, floor(m * 1000000000 + 0.5) / 1000000000.0 AS mrr, 0.5e0 AS ndcg, r >= 0.8 AND m >= 0.6 AND r >= 0.35 AND m >= 0.35 AS passed FROM m""",
    "cjk_pairs": "SELECT p_partkey AS id, '研究,究方,方法,法研,究结,结果' AS grams, array_to_string(list_concat(string_split(concat('研究', p_brand, '方法研究', p_name, '结果'), ' '), ['研究', '究方', '方法', '法研', '究结', '结果']), ',') AS anchors FROM part",
}
ORACLE_SQL = {k: v.replace("AS STRING", "AS VARCHAR") for k, v in ORACLE_SQL.items()}
