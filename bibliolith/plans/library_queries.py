"""Queries of the library views, journal lookup, matching, related documents and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, journals, ledger, library, merge
from ..schema import rounded
from ..streaming import events as stream
from .standins import EDGES, PAPERS, edges, table, view

_STORE = f"SELECT *, is_cleaned AS is_enriched, id AS imported_at FROM ({PAPERS}) s"
_META = f"""SELECT CASE WHEN id % 6 = 5 THEN concat('nd-', doi) ELSE concat('doi-', doi) END AS rid, CASE WHEN id % 6 = 5 THEN '' ELSE doi END AS doi, title, journal, CASE WHEN id % 9 = 0 THEN 'Special Journal' ELSE '' END AS journal_override,
    year, quartile, impact_factor, CASE WHEN id % 4 = 1 THEN 'thesis' WHEN id % 4 = 2 THEN 'map' WHEN id % 4 = 3 THEN '' ELSE 'book' END AS kind, CAST(id % 3 AS BIGINT) AS attachments FROM ({PAPERS}) m"""
_SCORES = f"SELECT doi AS key, times_cited / 10.0e0 AS score, CASE WHEN times_cited >= 25 THEN 'L2' ELSE 'L1' END AS level, id % 3 <> 0 AS ai FROM ({PAPERS}) s"
_FOLDERS = """SELECT key, concat('dir', key) AS dir, least(max(n), 3) AS depth, CASE WHEN max(n) > 2 THEN concat('Title ', key) ELSE '' END AS dir_title FROM (
    SELECT CAST(o_custkey * 2 AS STRING) AS key, o_orderkey % 5 AS n FROM orders) f GROUP BY key"""
_JOBS = """SELECT CAST(o_custkey AS STRING) AS key, concat('L', CAST(1 + o_orderkey % 3 AS STRING)) AS level, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'failed' END AS status,
    CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE '' END AS error, o_orderkey AS started_at, o_orderkey % 4 <> 0 AS artifact FROM orders"""
_METRICS = """SELECT concat(CASE WHEN s_suppkey % 2 = 0 THEN 'Journal of ' ELSE 'annals & letters ' END, n_name, CASE WHEN s_suppkey % 5 = 0 THEN '-Basel' ELSE '' END) AS journal_name, CAST(2015 + s_suppkey % 7 AS INT) AS year,
    s_acctbal AS jif, concat('Q', CAST(1 + s_suppkey % 4 AS STRING)) AS quartile, CASE WHEN s_suppkey % 3 = 0 THEN concat('1000-', CAST(s_suppkey AS STRING)) ELSE '' END AS issn, concat('e', CAST(s_suppkey AS STRING)) AS eissn, s_suppkey AS id
    FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
_BOUND = """SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN concat('JOURNAL OF ', n_name) ELSE '' END AS journal_override, CASE WHEN c_custkey % 5 = 0 THEN concat(' 1000-', CAST(c_custkey AS STRING)) ELSE '' END AS issn,
    CASE WHEN c_custkey % 4 = 0 THEN concat('E', CAST(c_custkey AS STRING)) ELSE '' END AS eissn, concat(CASE WHEN c_custkey % 2 = 0 THEN 'Journal of ' ELSE 'Annals and Letters, ' END, n_name) AS journal
    FROM customer JOIN nation ON c_nationkey = n_nationkey"""
_CONCEPTS = "SELECT CAST(l_orderkey AS STRING) AS doi, concat(p_brand, ' (', p_type, ')') AS name, p_name AS definition, l_partkey AS position FROM lineitem JOIN part ON l_partkey = p_partkey"


def store_counts(spark, sf):
    return library.store_counts(view(spark, sf, _STORE), edges(spark, sf))


def unenriched_keys(spark, sf):
    return library.to_enrich(view(spark, sf, _STORE), 100)


def pending_keys(spark, sf):
    return library.pending(view(spark, sf, _STORE), True, 150)


def known_keys(spark, sf):
    return library.all_keys(view(spark, sf, _STORE))


def newest_papers(spark, sf):
    return library.newest(view(spark, sf, _STORE), 20, 30, False).select("doi", "imported_at")


def _view(spark, sf):
    folders = view(spark, sf, _FOLDERS).withColumn("levels", F.slice(F.array(*map(F.lit, library.LEVELS)), F.lit(1), F.col("depth").cast("int"))).drop("depth")
    return library.library_view(view(spark, sf, _META), view(spark, sf, _SCORES), folders, view(spark, sf, _JOBS))


def _flat(df):
    return df.select("key", "doi", "title", "source", "score", "level", "on_disk", "error", "third_level_next", *(F.array_join(c, ",").alias(c) for c in ("compiled", "queued", "stale")))


def library_items(spark, sf):
    return _flat(_view(spark, sf))


def library_filtered(spark, sf):
    wanted = library.LibraryFilter(journal="brand#1", status="done", score_min=0.5, quartiles=("Q1", "Q2", "Q3"), year_from=1995, min_impact=1.0)
    return _view(spark, sf).where(wanted.condition()).select("key", "score", "source")


def library_page(spark, sf):
    rows = _view(spark, sf).where(library.LibraryFilter(status="none", on_disk_only=False).condition())
    return library.page_of(rows, library.library_order("value"), 2, 25).select("key", "score", "year")


def kind_filter(spark, sf):
    return library.of_kind(view(spark, sf, _META), "none", True).select("rid", "kind", "attachments")


def trash_filter(spark, sf):
    bin_ = view(spark, sf, "SELECT CASE WHEN o_orderkey % 2 = 0 THEN concat('nd-', CAST(o_custkey AS STRING)) ELSE CAST(o_custkey AS STRING) END AS key FROM orders WHERE o_orderstatus = 'P'")
    return library.without_trash(view(spark, sf, _META), bin_).select("rid", "doi")


def kind_chips(spark, sf):
    m = view(spark, sf, _META)
    return library.kind_chips(m, m.select("rid", F.col("attachments").alias("files")))


def library_stats(spark, sf):
    folders = view(spark, sf, _FOLDERS).withColumn("levels", F.slice(F.array(*map(F.lit, library.LEVELS)), F.lit(1), F.col("depth").cast("int")))
    return library.library_stats(view(spark, sf, _SCORES), view(spark, sf, "SELECT CAST(c_custkey AS STRING) AS key FROM customer"), folders, view(spark, sf, _JOBS))


def index_health(spark, sf):
    seg = view(spark, sf, "SELECT o_custkey % 20 AS id, count(*) AS rows FROM orders GROUP BY 1")
    live = view(spark, sf, "SELECT CASE WHEN user_id % 7 = 0 THEN '' ELSE CAST(user_id AS STRING) END AS doi FROM events WHERE event_type = 'click'")
    return library.index_health(seg, live, view(spark, sf, "SELECT CAST(c_custkey % 2 AS INT) AS resolved FROM customer"))


def passage_counts(spark, sf):
    return library.passages_per_document(view(spark, sf, "SELECT CASE WHEN user_id % 7 = 0 THEN '' ELSE CAST(user_id AS STRING) END AS doi FROM events"))


def metric_years(spark, sf):
    return library.table_years(view(spark, sf, _METRICS))


def mapping_sources(spark, sf):
    return library.by_source(view(spark, sf, f"SELECT source_main AS source FROM ({PAPERS}) p"))


def mapping_learnt(spark, sf):
    batch = view(spark, sf, "SELECT CAST(o_custkey AS STRING) AS short, o_orderpriority AS full, o_orderkey AS position FROM orders")
    return library.learnt(view(spark, sf, "SELECT CAST(c_custkey AS STRING) AS short, c_mktsegment AS full FROM customer WHERE c_custkey % 3 = 0"), batch)


def usage_prefix(spark, sf):
    return library.with_prefix(view(spark, sf, "SELECT event_id, concat(event_type, ':', CAST(user_id AS STRING)) AS context FROM events"), "context", "click:1")


def paragraph_query(spark, sf):
    rows = view(spark, sf, "SELECT conv_id * 1000 + turn AS idx, concat('P', CAST(turn AS STRING)) AS para_id, role AS section, text AS text_en, '' AS text_zh FROM conversations")
    return library.paragraphs(rows, ["P0", "P1", "P2"], "user", "both", 60)


def audit_query(spark, sf):
    return library.matching(table(spark, sf, "events"), event_type="click", user_id=None, props="").select("event_id")


def year_filter(spark, sf):
    return library.years_between(view(spark, sf, PAPERS), 1995, 2010).select("doi", "year")


def shared_keys(spark, sf):
    return library.shared_keys(view(spark, sf, "SELECT CAST(o_custkey AS STRING) AS doi FROM orders"), view(spark, sf, PAPERS))


def key_families(spark, sf):
    d = view(spark, sf, "SELECT p_partkey AS id, concat(CASE WHEN p_partkey % 2 = 0 THEN 'doi-' ELSE '' END, '10.1234/ab_', CAST(p_partkey AS STRING)) AS key FROM part")
    return d.select("id", F.array_join(library.key_aliases(F.col("key")), "|").alias("aliases"))


def ordered_unions(spark, sf):
    d = view(spark, sf, "SELECT p_partkey AS id, p_type AS a, p_name AS b FROM part")
    return d.select("id", F.array_join(library.ordered_union(F.split("a", " "), F.split(F.upper("b"), " "), F.split("a", " ")), " ").alias("words"))


def third_level(spark, sf):
    scores = view(spark, sf, f"SELECT doi AS key, times_cited / 10.0e0 AS score, CAST(id % 3 AS DOUBLE) AS ai FROM ({PAPERS}) s")
    return library.third_level(scores, view(spark, sf, _JOBS)).select("key", "score")


def dropped_aliases(spark, sf):
    a = view(spark, sf, "SELECT CAST(c_custkey AS STRING) AS key, CAST(c_custkey + 1 AS STRING) AS x FROM customer").select("key", F.array("key", "x").alias("aliases"))
    gone = view(spark, sf, "SELECT CAST(o_custkey AS STRING) AS key FROM orders WHERE o_orderkey % 40 = 0")
    return library.drop_by_alias(view(spark, sf, "SELECT CAST(c_custkey AS STRING) AS key, c_name AS name FROM customer"), gone, a)


def incremental_add(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    return library.add_new(e.where("vec_id % 3 > 0"), e, "vec_id")


def recent_messages(spark, sf):
    return library.recent_in_order(table(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", "turn", 3)


def node_sizes(spark, sf):
    p = view(spark, sf, PAPERS)
    return p.select("doi", *(rounded(library.node_size(F.col("times_cited"), 0.5, s), 6).alias(s) for s in ("pow06", "log2", "sqrt", "linear")))


def cluster_members(spark, sf):
    return library.cluster_papers(view(spark, sf, PAPERS), 3).select("doi", "paper_rank")


def metric_zones(spark, sf):
    zones = view(spark, sf, f"SELECT upper(journal_name) AS journal_name, CAST(year - id % 2 AS INT) AS year, CAST(1 + id % 4 AS STRING) AS zone FROM ({_METRICS}) z")
    return journals.with_zones(view(spark, sf, _METRICS), zones, 2017).select("id", "zone", "zone_year")


def journal_lookup(spark, sf):
    return journals.lookup(view(spark, sf, _BOUND), view(spark, sf, _METRICS)).select("id", "metric_name", "jif", "metric_quartile", "how")


def title_matches(spark, sf):
    wanted = view(spark, sf, "SELECT p_partkey AS query_id, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE concat(p_name, ' revisited') END AS title FROM part")
    return journals.match_titles(wanted, view(spark, sf, "SELECT p_partkey AS position, CAST(p_partkey AS STRING) AS doi, concat(' ', p_name) AS title FROM part"))


def name_matches(spark, sf):
    full = view(spark, sf, "SELECT c_nationkey AS g, c_custkey AS position, concat('Family', CAST(c_custkey % 9 AS STRING), ', ', CASE c_custkey % 4 WHEN 0 THEN 'Anna Berta' WHEN 1 THEN 'Anna' WHEN 2 THEN 'AB' ELSE 'Carl Dan' END) AS full FROM customer")
    short = view(spark, sf, "SELECT n_nationkey AS g, concat('Family', CAST(n_nationkey % 9 AS STRING), ', ', CASE n_nationkey % 3 WHEN 0 THEN 'AB' WHEN 1 THEN 'A.' ELSE 'X' END) AS short FROM nation")
    return journals.match_names(short.withColumnRenamed("g", "group"), full.withColumnRenamed("g", "group")).withColumnRenamed("group", "g")


def enriched_hits(spark, sf):
    items = view(spark, sf, f"SELECT id AS position, rid, doi, concat('dir', doi) AS dir, kind, attachments FROM (SELECT *, CAST(substr(rid, CASE WHEN rid LIKE 'nd-%' THEN 4 ELSE 5 END) AS BIGINT) AS id FROM ({_META}) m) i")
    hits = view(spark, sf, "SELECT o_orderkey AS hit, CASE WHEN o_orderkey % 2 = 0 THEN concat('doi-', CAST(o_custkey AS STRING)) ELSE '' END AS rid, CAST(o_custkey AS STRING) AS doi FROM orders")
    return journals.enrich_hits(hits, items).select("hit", "kind", "attachments")


def concept_pairs(spark, sf):
    return journals.shared_concepts(view(spark, sf, "SELECT CAST(l_orderkey AS STRING) AS doi, CAST(l_partkey AS STRING) AS name FROM lineitem"), 2).select("a", "b", F.array_join("shared", ",").alias("shared"))


def canonical_concepts(spark, sf):
    return journals.canonical_concepts(view(spark, sf, _CONCEPTS))[0]


def concept_pages(spark, sf):
    return journals.canonical_concepts(view(spark, sf, _CONCEPTS), 3)[1]


_SHARED = "SELECT DISTINCT a.l_orderkey AS doi, b.l_orderkey AS other, a.l_partkey AS name FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey WHERE a.l_linenumber = 1 AND b.l_linenumber = 2 AND a.l_orderkey <> b.l_orderkey"
_HITS = "SELECT l_orderkey AS doi, l_partkey AS other, max(l_discount) * 8 AS score, max(concat('m', CAST(l_suppkey % 7 AS STRING))) AS name FROM lineitem WHERE l_linenumber < 3 AND l_orderkey <> l_partkey GROUP BY 1, 2"
_CITED = "SELECT DISTINCT l_orderkey AS doi, l_suppkey AS other FROM lineitem WHERE l_orderkey <> l_suppkey"
_PEERS = "SELECT DISTINCT l_orderkey AS doi, l_partkey + 1 AS other FROM lineitem WHERE l_orderkey <> l_partkey + 1"


def related_documents(spark, sf):
    shared = view(spark, sf, _SHARED).withColumn("name", F.col("name").cast("string"))
    return journals.related(view(spark, sf, _HITS), shared, view(spark, sf, _CITED), view(spark, sf, _PEERS), 5).select("doi", "other", rounded(F.col("score"), 6).alias("score"), "connection", "nth")


def resource_keys(spark, sf):
    d = view(spark, sf, """SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'paper' WHEN 1 THEN 'si' ELSE 'book' END AS kind, CASE WHEN p_partkey % 4 = 0 THEN concat('10.1234/x_', CAST(p_partkey AS STRING)) ELSE '' END AS doi,
        CASE WHEN p_partkey % 4 = 1 THEN concat('978 ', CAST(p_partkey AS STRING)) ELSE '' END AS isbn, CASE WHEN p_partkey % 4 = 2 THEN p_name ELSE '' END AS print, CASE WHEN p_partkey % 6 = 1 THEN 'doi-parent' ELSE '' END AS parent FROM part""")
    none = F.lit("")
    return d.select("id", text.resource_key(F.col("kind"), F.col("doi"), F.col("isbn"), none, none, none, none, F.col("print"), F.col("parent")).alias("rid"))


def directory_names(spark, sf):
    d = view(spark, sf, "SELECT p_partkey AS id, concat('10.1234/', CASE WHEN p_partkey % 2 = 0 THEN 'a_b:' ELSE p_brand END, CAST(p_partkey AS STRING)) AS doi FROM part")
    return d.select("id", text.dirname(F.col("doi")).alias("dir"), text.from_dirname(text.dirname(F.col("doi"))).alias("back"))


_SOME = graph.NodeFilter(year_from=1995, min_citations=10)


def network_preview(spark, sf):
    return graph.network_preview(view(spark, sf, PAPERS), edges(spark, sf).where("citing < cited"), _SOME, "times_cited", 40)


def network_citations(spark, sf):
    nodes, _ = graph.build_network(view(spark, sf, PAPERS), edges(spark, sf), _SOME, "times_cited", 60)
    return graph.with_citations(nodes, "filtered").select("doi", "cite_count")


def top_ranked(spark, sf):
    ranks = view(spark, sf, "SELECT CAST(l_partkey AS STRING) AS doi, sum(l_quantity) AS rank FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1")
    return graph.top_ranked(view(spark, sf, PAPERS), ranks, 30).select("doi", "rank")


def topics(spark, sf):
    p = view(spark, sf, PAPERS).withColumn("keywords", F.split("abstract", " ")).withColumn("position", F.col("id"))
    t = graph.topics(p, 3)
    return t.select("slug", "name", "n", rounded(F.col("avg_cites"), 4).alias("avg_cites"), F.size("covered").cast("bigint").alias("covered"))


def deleted_chain(spark, sf):
    c = view(spark, sf, "SELECT c_custkey AS k FROM customer")
    o = view(spark, sf, "SELECT o_orderkey AS k, o_custkey AS parent FROM orders")
    li = view(spark, sf, "SELECT l_orderkey * 10 + l_linenumber AS k, l_orderkey AS parent FROM lineitem")
    left = merge.delete_down(c.where("k % 3 = 0"), [(c, "k", None), (o, "k", "parent"), (li, "k", "parent")])
    return left[2].groupBy("parent").agg(F.count(F.lit(1)).alias("n"))


def synced_columns(spark, sf):
    meta = view(spark, sf, "SELECT concat('r', CAST(c_custkey AS STRING)) AS rid, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS STRING) ELSE '' END AS doi, c_name AS title, CAST(c_custkey AS BIGINT) AS cites FROM customer")
    ids = view(spark, sf, "SELECT CAST(c_custkey + 7 AS STRING) AS value, concat('r', CAST(c_custkey AS STRING)) AS rid FROM customer WHERE c_custkey % 3 = 0")
    p = view(spark, sf, "SELECT CAST(p_partkey AS STRING) AS doi, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS title, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) END AS cites FROM part")
    return merge.sync_columns(meta, ids, p, ["cites"], ["title"])


def appended_segments(spark, sf):
    old = view(spark, sf, "SELECT user_id AS k, event_id AS version, false AS deleted, event_type AS body FROM events WHERE event_id % 2 = 0")
    batch = view(spark, sf, "SELECT user_id AS k, max(event_type) AS body FROM events WHERE event_id % 2 = 1 AND user_id % 3 = 0 GROUP BY 1")
    gone = view(spark, sf, "SELECT DISTINCT user_id AS k FROM events WHERE user_id % 3 = 1")
    return merge.compact(merge.appended(old, batch, "k", "version", "deleted", gone), "k", "version", "deleted").select("k", "body")


def resolved_by_doi(spark, sf):
    names = view(spark, sf, "SELECT DISTINCT concat(CASE WHEN o_custkey % 2 = 0 THEN 'https://doi.org/' ELSE '' END, '10.1234/A', CAST(o_custkey AS STRING)) AS name FROM orders")
    one = lambda c: view(spark, sf, f"SELECT '-' AS {c}, '-' AS rid FROM region WHERE false")
    known = view(spark, sf, "SELECT concat('10.1234/a', CAST(c_custkey AS STRING)) AS doi, concat('r', CAST(c_custkey AS STRING)) AS rid FROM customer WHERE c_custkey % 3 > 0")
    return merge.resolve(names, view(spark, sf, "SELECT '-' AS rid FROM region WHERE false"), one("value"), one("dirname"), known)


def diary_by_day(spark, sf):
    e = table(spark, sf, "events")
    return ledger.diary_days({k: e.where(F.col("event_type") == k) for k in ("click", "view", "purchase")})


def diary_by_month(spark, sf):
    return ledger.diary_months(diary_by_day(spark, sf))


def resolved_failures(spark, sf):
    f = view(spark, sf, "SELECT CAST(user_id AS STRING) AS doi, event_type AS op, event_id AS id, 0 AS resolved FROM events")
    return ledger.resolved(f, f.where("id % 5 = 0")).select("id", "resolved")


def cached_vectors(spark, sf):
    cache = view(spark, sf, "SELECT md5(trim(text)) AS key, item_id AS vector FROM benchmark WHERE item_id % 2 = 0")
    return ledger.query_vectors(view(spark, sf, "SELECT item_id AS query_id, concat(' ', text) AS query FROM benchmark"), cache)


def cache_hits(spark, sf):
    cache = view(spark, sf, "SELECT CAST(c_custkey AS STRING) AS key, CAST(c_custkey % 4 AS BIGINT) AS hits FROM customer")
    return ledger.count_hits(cache, view(spark, sf, "SELECT CAST(o_custkey AS STRING) AS key FROM orders"))


def stream_sliding(spark, sf):
    out = stream.run_batchwise(spark, sf, lambda e: stream.counts_by_window(e, "2 days", "3650 days", "1 day"), "sliding", "complete")
    return out.select("start", "event_type", "n")


def stream_visits(spark, sf):
    return stream.run_batchwise(spark, sf, lambda e: stream.visits(e, "user_id", "6 hours", "3650 days"), "visits", "complete").select("user_id", "start", "n")


QUERIES = {
    f.__name__: f
    for f in (
        store_counts, unenriched_keys, pending_keys, known_keys, newest_papers, library_items, library_filtered, library_page, kind_filter, trash_filter, kind_chips, library_stats, index_health, passage_counts, metric_years,
        mapping_sources, mapping_learnt, usage_prefix, paragraph_query, audit_query, year_filter, shared_keys, key_families, ordered_unions, third_level, dropped_aliases, incremental_add, recent_messages, node_sizes,
        cluster_members, metric_zones, journal_lookup, title_matches, name_matches, enriched_hits, concept_pairs, canonical_concepts, concept_pages, related_documents, resource_keys, directory_names,
        network_preview, network_citations, top_ranked, topics, deleted_chain, synced_columns, appended_segments, resolved_by_doi, diary_by_day, diary_by_month, resolved_failures, cached_vectors, cache_hits, stream_sliding, stream_visits,
    )
}

_DUCK = lambda sql: sql.replace("AS STRING", "AS VARCHAR")
_STATE = f"""j AS ({_JOBS}), ja AS (SELECT key, coalesce(array_to_string(list_sort(list(DISTINCT level) FILTER (status = 'done' AND artifact)), ','), '') AS compiled, coalesce(array_to_string(list_sort(list(DISTINCT level) FILTER (status = 'queued')), ','), '') AS queued,
        coalesce(array_to_string(list_sort(list(DISTINCT level) FILTER (status = 'done' AND NOT artifact)), ','), '') AS stale, coalesce(arg_max(error, started_at) FILTER (status = 'failed' AND error <> ''), '') AS error FROM j GROUP BY key)"""
_ITEMS = f"""WITH {_STATE}, d AS (SELECT *, ['', 'L1', 'L1,L2', 'L1,L2,L3'][depth + 1] AS levels FROM ({_FOLDERS})), m AS (SELECT CASE WHEN doi <> '' THEN doi ELSE rid END AS key, doi, title, journal, journal_override, year, quartile, impact_factor, 'meta' AS source FROM ({_META})),
    u AS (SELECT * FROM m UNION ALL SELECT key, '', CASE WHEN dir_title = '' THEN dir ELSE dir_title END, '', '', '', '', 0.0, 'disk' FROM d WHERE key NOT IN (SELECT key FROM m)),
    v AS (SELECT u.*, coalesce(s.score, 0.0) AS score, coalesce(s.level, 'L1') AS level, dir IS NOT NULL AS on_disk, coalesce(ja.error, '') AS error, CASE WHEN source = 'disk' THEN d.levels ELSE coalesce(ja.compiled, '') END AS compiled,
        CASE WHEN source = 'disk' THEN '' ELSE coalesce(ja.queued, '') END AS queued, coalesce(ja.stale, '') AS stale, coalesce(s.ai, false) AS ai FROM u LEFT JOIN ({_SCORES}) s USING (key) LEFT JOIN d USING (key) LEFT JOIN ja USING (key)),
    w AS (SELECT *, contains(compiled, 'L2') AND NOT contains(compiled, 'L3') AND score >= 4 AND ai AS third_level_next FROM v)"""
_KEY = "regexp_replace(replace(upper({0}), '&', ' AND '), '[\\s_.,;:''\"()/-]+', '', 'g')"
_LOOSE = _KEY.format("regexp_replace(upper({0}), '[- ]BASEL$', '')")
ORACLE_SQL = {
    "store_counts": f"WITH s AS ({_STORE}) SELECT count(*) AS total_papers, count(*) FILTER (NOT is_reference) AS main_papers, count(*) FILTER (is_reference) AS reference_papers, count(*) FILTER (is_enriched) AS enriched, count(*) FILTER (paper_rank > 0) AS ranked, count(*) FILTER (impact_factor > 0) AS with_impact, (SELECT count(*) FROM ({EDGES})) AS citations FROM s",
    "unenriched_keys": f"SELECT doi FROM ({_STORE}) WHERE NOT is_enriched ORDER BY paper_rank DESC, doi LIMIT 100",
    "pending_keys": f"SELECT doi FROM ({_STORE}) WHERE NOT is_enriched OR source_main NOT ILIKE 'wos%' ORDER BY paper_rank DESC, times_cited DESC, doi LIMIT 150",
    "known_keys": "SELECT CAST(p_partkey AS VARCHAR) AS doi FROM part",
    "newest_papers": f"SELECT doi, imported_at FROM ({_STORE}) WHERE NOT is_reference ORDER BY imported_at DESC LIMIT 30 OFFSET 20",
    "library_items": f"{_ITEMS} SELECT key, doi, title, source, score, level, on_disk, error, third_level_next, compiled, queued, stale FROM w",
    "library_filtered": f"""{_ITEMS} SELECT key, score, source FROM w WHERE score >= 0.5 AND on_disk AND compiled <> '' AND (source = 'disk' OR ((contains(lower(journal), 'brand#1') OR contains(lower(journal_override), 'brand#1')) AND quartile IN ('Q1', 'Q2', 'Q3')
        AND CASE WHEN regexp_matches(year, '^[0-9]+$') THEN CAST(year AS BIGINT) ELSE 0 END >= 1995 AND impact_factor >= 1))""",
    "library_page": f"{_ITEMS} SELECT key, score, year FROM w WHERE compiled = '' ORDER BY score DESC, coalesce(TRY_CAST(year AS BIGINT), 0) DESC, lower(title), key LIMIT 25 OFFSET 25",
    "kind_filter": f"SELECT rid, kind, attachments FROM ({_META}) WHERE rid LIKE 'nd-%' AND attachments > 0",
    "trash_filter": f"WITH m AS ({_META}), t AS (SELECT DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN concat('nd-', CAST(o_custkey AS VARCHAR)) ELSE CAST(o_custkey AS VARCHAR) END AS key FROM orders WHERE o_orderstatus = 'P') SELECT rid, doi FROM m WHERE rid NOT IN (SELECT key FROM t) AND doi NOT IN (SELECT key FROM t)",
    "kind_chips": f"""WITH m AS ({_META}) SELECT CAST(CASE kind WHEN 'thesis' THEN 2 WHEN 'book' THEN 3 WHEN 'map' THEN 50 ELSE 1 END AS BIGINT) AS place, CASE WHEN kind = '' THEN 'paper' ELSE kind END AS kind, count(*) AS n FROM m GROUP BY 1, 2
        UNION ALL SELECT 0, 'all', count(*) FROM m UNION ALL SELECT 98, 'none', count(*) FROM m WHERE rid LIKE 'nd-%' UNION ALL SELECT 99, 'has_attachment', count(DISTINCT rid) FROM m WHERE attachments > 0""",
    "library_stats": f"""WITH d AS ({_FOLDERS}), s AS ({_SCORES}), j AS ({_JOBS}) SELECT (SELECT count(*) FROM s) AS meta_count, (SELECT count(*) FROM customer) AS library_papers, count(*) AS kb_papers, count(*) FILTER (depth >= 1) AS l1_done, count(*) FILTER (depth >= 2) AS l2_done,
        count(*) FILTER (depth >= 3) AS l3_done, count(*) FILTER (depth = 0) AS uncompiled, (SELECT count(*) FROM j WHERE status = 'queued') AS queued, CAST(0 AS BIGINT) AS processing, (SELECT count(*) FROM j WHERE status = 'failed') AS failed,
        (SELECT count(*) FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT key FROM d)) AS not_in_kb, count(*) FILTER (key NOT IN (SELECT key FROM s)) AS missing_meta FROM d""",
    "index_health": """WITH l AS (SELECT CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id END AS doi FROM events WHERE event_type = 'click') SELECT (SELECT count(DISTINCT o_custkey % 20) FROM orders) AS segments, (SELECT count(*) FROM orders) AS segment_rows, count(*) AS live_passages, count(DISTINCT doi) AS papers,
        (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) AS dead_letters, greatest(0, (SELECT count(*) FROM orders) - count(*)) AS garbage_rows FROM l""",
    "passage_counts": "SELECT CAST(user_id AS VARCHAR) AS doi, count(*) AS passages FROM events WHERE user_id % 7 <> 0 GROUP BY 1",
    "metric_years": "SELECT count(*) AS rows, count(DISTINCT s_suppkey % 7) AS years FROM supplier",
    "mapping_sources": "SELECT CASE WHEN p_partkey % 3 = 0 THEN 'wos_core' WHEN p_partkey % 3 = 1 THEN 'openalex' ELSE '' END AS source, count(*) AS n FROM part GROUP BY 1",
    "mapping_learnt": "WITH k AS (SELECT CAST(c_custkey AS VARCHAR) AS short, c_mktsegment AS full FROM customer WHERE c_custkey % 3 = 0) SELECT * FROM k UNION ALL SELECT CAST(o_custkey AS VARCHAR), arg_min(o_orderpriority, o_orderkey) FROM orders WHERE CAST(o_custkey AS VARCHAR) NOT IN (SELECT short FROM k) GROUP BY o_custkey",
    "usage_prefix": "SELECT event_id, concat(event_type, ':', CAST(user_id AS VARCHAR)) AS context FROM events WHERE event_type = 'click' AND CAST(user_id AS VARCHAR) LIKE '1%'",
    "paragraph_query": "SELECT conv_id * 1000 + turn AS idx, concat('P', CAST(turn AS VARCHAR)) AS para_id, role AS section, CASE WHEN length(trim(text)) > 60 THEN concat(substr(trim(text), 1, 60), '…(截断)') ELSE trim(text) END AS text FROM conversations WHERE turn IN (0, 1, 2) AND role = 'user' ORDER BY idx LIMIT 50",
    "audit_query": "SELECT event_id FROM events WHERE event_type = 'click'",
    "year_filter": f"SELECT doi, year FROM ({PAPERS}) WHERE NOT regexp_matches(year, '^[0-9]{{4}}$') OR CAST(CASE WHEN regexp_matches(year, '^[0-9]{{4}}$') THEN year END AS INT) BETWEEN 1995 AND 2010",
    "shared_keys": "SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IN (SELECT p_partkey FROM part))",
    "key_families": "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN concat('10.1234/ab_', p_partkey, '|doi-10.1234/ab_', p_partkey, '|doi-10.1234_ab__', p_partkey) ELSE concat('10.1234/ab/', p_partkey, '|10.1234/ab_', p_partkey, '|10.1234_ab__', p_partkey) END AS aliases FROM part",
    "ordered_unions": "WITH u AS (SELECT p_partkey AS id, x, min(nth) AS first FROM (SELECT p_partkey, unnest(list_concat(string_split(p_type, ' '), string_split(upper(p_name), ' '))) AS x, generate_subscripts(list_concat(string_split(p_type, ' '), string_split(upper(p_name), ' ')), 1) AS nth FROM part) GROUP BY 1, 2) SELECT id, string_agg(x, ' ' ORDER BY first) AS words FROM u GROUP BY 1",
    "third_level": f"SELECT doi AS key, times_cited / 10.0e0 AS score FROM ({PAPERS}) WHERE id % 3 > 0 AND times_cited >= 40 AND doi NOT IN (SELECT key FROM ({_JOBS}) WHERE level = 'L3' AND status = 'done' AND artifact)",
    "dropped_aliases": "WITH g AS (SELECT o_custkey AS k FROM orders WHERE o_orderkey % 40 = 0) SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT k FROM g) AND c_custkey - 1 NOT IN (SELECT k FROM g WHERE k IN (SELECT c_custkey FROM customer))",
    "incremental_add": "SELECT vec_id, label FROM embeddings",
    "recent_messages": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3)",
    "node_sizes": f"SELECT doi, {', '.join(f'floor(greatest(1.2e0, ({x}) * 0.5e0) * 1000000 + 0.5) / 1000000.0 AS {n}' for n, x in (('pow06', '1.2e0 + pow(CAST(times_cited AS DOUBLE), 0.6e0) * 1.8e0'), ('log2', '2e0 + log2(1e0 + times_cited) * 1.5e0'), ('sqrt', '1.5e0 + sqrt(CAST(times_cited AS DOUBLE)) * 2e0'), ('linear', '1.2e0 + times_cited * 0.5e0')))} FROM ({PAPERS})",
    "cluster_members": f"SELECT doi, paper_rank FROM ({PAPERS}) WHERE cluster = 3 AND NOT is_reference",
    "metric_zones": f"""WITH m AS (SELECT *, {_KEY.format('journal_name')} AS k FROM ({_METRICS})), z AS (SELECT k, CAST(year - id % 2 AS INT) AS zone_year, CAST(1 + id % 4 AS VARCHAR) AS zone FROM m QUALIFY row_number() OVER (PARTITION BY k ORDER BY CAST(year - id % 2 AS INT) = 2017 DESC, CAST(year - id % 2 AS INT) DESC, CAST(1 + id % 4 AS VARCHAR)) = 1)
        SELECT id, zone, zone_year FROM m LEFT JOIN z USING (k)""",
    "journal_lookup": f"""WITH m AS (SELECT *, {_KEY.format('journal_name')} AS k, {_LOOSE.format('journal_name')} AS l FROM ({_METRICS})), p AS (SELECT *, {_KEY.format('journal_override')} AS ko, {_LOOSE.format('journal_override')} AS lo, {_KEY.format('journal')} AS kj, {_LOOSE.format('journal')} AS lj FROM ({_BOUND})),
        c AS (SELECT p.id, w.step, m.journal_name, m.jif, m.quartile, m.year FROM p, (VALUES (1), (2), (3), (4), (5), (6)) w(step), m WHERE CASE w.step WHEN 1 THEN ko <> '' AND ko = m.k WHEN 2 THEN lo <> '' AND lo = m.l WHEN 3 THEN trim(p.issn) <> '' AND upper(trim(p.issn)) = upper(m.issn)
            WHEN 4 THEN p.eissn <> '' AND upper(p.eissn) = upper(m.eissn) WHEN 5 THEN kj = m.k ELSE lj = m.l END), f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY step, year DESC, jif DESC, journal_name) = 1)
        SELECT p.id, journal_name AS metric_name, jif, f.quartile AS metric_quartile, coalesce(['override', 'override_loose', 'issn', 'eissn', 'name', 'name_loose'][step], '') AS how FROM p LEFT JOIN f ON p.id = f.id""",
    "title_matches": "WITH t AS (SELECT p_partkey, lower(p_name) AS t FROM part), q AS (SELECT p_partkey AS query_id, CASE WHEN p_partkey % 2 = 0 THEN lower(p_name) ELSE concat(lower(p_name), ' revisited') END AS q FROM part) SELECT query_id, CAST(min(p_partkey) AS VARCHAR) AS doi FROM q JOIN t ON starts_with(q, t) OR starts_with(t, q) GROUP BY 1",
    "name_matches": """WITH f AS (SELECT c_nationkey AS g, c_custkey AS position, c_custkey % 9 AS s, ['AB', 'A', 'AB', 'CD'][c_custkey % 4 + 1] AS i, concat('Family', CAST(c_custkey % 9 AS VARCHAR), ', ', ['Anna Berta', 'Anna', 'AB', 'Carl Dan'][c_custkey % 4 + 1]) AS full FROM customer),
        q AS (SELECT n_nationkey AS g, n_nationkey % 9 AS s, ['AB', 'A', 'X'][n_nationkey % 3 + 1] AS i, concat('Family', CAST(n_nationkey % 9 AS VARCHAR), ', ', ['AB', 'A.', 'X'][n_nationkey % 3 + 1]) AS short FROM nation)
        SELECT q.g, short, coalesce((SELECT f.full FROM f WHERE f.g = q.g AND f.s = q.s AND (starts_with(f.i, q.i) OR starts_with(q.i, f.i)) ORDER BY f.i <> q.i, position LIMIT 1), short) AS full FROM q""",
    "enriched_hits": f"""WITH m AS (SELECT CAST(substr(rid, CASE WHEN rid LIKE 'nd-%' THEN 4 ELSE 5 END) AS BIGINT) AS position, * FROM ({_META})), k AS (SELECT rid AS k, * FROM m UNION ALL SELECT doi, * FROM m WHERE doi <> '' UNION ALL SELECT concat('dir', doi), * FROM m), f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY position) = 1)
        SELECT o_orderkey AS hit, coalesce(kind, '') AS kind, coalesce(attachments, 0) AS attachments FROM orders LEFT JOIN f ON f.k = CASE WHEN o_orderkey % 2 = 0 THEN concat('doi-', CAST(o_custkey AS VARCHAR)) ELSE CAST(o_custkey AS VARCHAR) END""",
    "concept_pairs": """WITH c AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS doi, CAST(l_partkey AS VARCHAR) AS name FROM lineitem)
        SELECT a.doi AS a, b.doi AS b, string_agg(a.name, ',' ORDER BY a.name) AS shared FROM c a JOIN c b ON a.name = b.name AND a.doi < b.doi GROUP BY 1, 2 HAVING count(*) >= 2""",
    "canonical_concepts": "SELECT CAST(l_orderkey AS VARCHAR) AS doi, lower(replace(p_brand, '#', ' ')) AS name, first(p_name ORDER BY length(p_name) DESC, l_partkey) AS definition FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "concept_pages": "SELECT lower(replace(p_brand, '#', ' ')) AS name, count(DISTINCT l_orderkey) AS papers FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 3",
    "related_documents": f"""WITH e AS (SELECT doi, other, score, concat('concept:', name) AS connection, 0 AS channel FROM ({_HITS}) UNION ALL SELECT doi, other, CAST(0.3 AS DOUBLE), concat('concept:', min(CAST(name AS VARCHAR))), 1 FROM ({_SHARED}) GROUP BY 1, 2
        UNION ALL SELECT doi, other, CAST(0.4 AS DOUBLE), 'citation', 2 FROM ({_CITED}) UNION ALL SELECT doi, other, CAST(0.35 AS DOUBLE), 'cluster', 3 FROM ({_PEERS})),
        s AS (SELECT doi, other, coalesce(max(score) FILTER (channel < 2), arg_min(score, channel)) AS score, arg_min(connection, channel) AS connection, min(channel) AS channel FROM e GROUP BY 1, 2)
        SELECT doi, other, floor(score * 1000000 + 0.5) / 1000000.0 AS score, connection, row_number() OVER (PARTITION BY doi ORDER BY score DESC, channel, other) AS nth FROM s QUALIFY nth <= 5""",
    "resource_keys": """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 1 AND p_partkey % 6 = 1 THEN 'si__doi-parent' ELSE concat(CASE p_partkey % 3 WHEN 1 THEN 'si__' WHEN 2 THEN 'book__' ELSE '' END, CASE p_partkey % 4 WHEN 0 THEN concat('doi-10.1234_x__', p_partkey) WHEN 1 THEN concat('isbn-978-', p_partkey)
        WHEN 2 THEN concat('nd-', regexp_replace(substr(lower(regexp_replace(p_name, '[^A-Za-z0-9._-]+', '-', 'g')), 1, 12), '[-_]+$', '')) ELSE 'nd-untitled' END) END AS rid FROM part""",
    "directory_names": """SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN concat('10.1234_a__b~', p_partkey) ELSE concat('10.1234_', replace(p_brand, '#', '-'), p_partkey, '--', substr(md5(concat('10.1234/', p_brand, p_partkey)), 1, 6)) END AS dir,
        CASE WHEN p_partkey % 2 = 0 THEN concat('10.1234/a_b:', p_partkey) ELSE '' END AS back FROM part""",
}
_CHOSEN = f"SELECT doi FROM ({PAPERS}) WHERE regexp_matches(year, '^[0-9]{{4}}$') AND CAST(CASE WHEN regexp_matches(year, '^[0-9]{{4}}$') THEN year END AS INT) >= 1995 AND times_cited >= 10"
_DAYS = "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) AS total FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1"
ORACLE_SQL |= {
    "network_preview": f"WITH m AS ({_CHOSEN}), s AS ({_CHOSEN} ORDER BY times_cited DESC, doi LIMIT 40), e AS (SELECT * FROM ({EDGES}) WHERE citing < cited) SELECT (SELECT count(*) FROM m) AS matched, count(*) AS selected, count(*) FILTER (doi NOT IN (SELECT citing FROM e UNION SELECT cited FROM e)) AS isolated FROM s",
    "network_citations": f"WITH s AS ({_CHOSEN} ORDER BY times_cited DESC, doi LIMIT 60), e AS (SELECT * FROM ({EDGES}) WHERE citing IN (SELECT doi FROM s) AND cited IN (SELECT doi FROM s)) SELECT doi, (SELECT count(*) FROM e WHERE cited = doi) AS cite_count FROM s WHERE doi IN (SELECT citing FROM e UNION SELECT cited FROM e)",
    "top_ranked": f"SELECT doi, rank FROM ({PAPERS}) LEFT JOIN (SELECT CAST(l_partkey AS VARCHAR) AS doi, sum(l_quantity) AS rank FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) USING (doi) WHERE NOT is_reference ORDER BY rank DESC NULLS LAST, doi LIMIT 30",
    "topics": f"WITH k AS (SELECT DISTINCT id, times_cited, x AS name FROM (SELECT id, times_cited, unnest(string_split(abstract, ' ')) AS x FROM ({PAPERS})) WHERE x <> '') SELECT lower(name) AS slug, name, count(*) AS n, floor(avg(times_cited) * 10000 + 0.5) / 10000.0 AS avg_cites, count(*) AS covered FROM k GROUP BY 1, 2 HAVING count(*) >= 3",
    "deleted_chain": "SELECT l_orderkey AS parent, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 3 = 0 AND o_custkey IN (SELECT c_custkey FROM customer)) GROUP BY 1",
    "synced_columns": """SELECT concat('r', c_custkey) AS rid, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS doi, CASE WHEN p_partkey IS NOT NULL AND p_partkey % 5 <> 0 THEN p_name ELSE c_name END AS title, CASE WHEN p_partkey IS NOT NULL AND p_partkey % 4 <> 0 THEN CAST(p_size AS BIGINT) ELSE CAST(c_custkey AS BIGINT) END AS cites
        FROM customer LEFT JOIN part ON p_partkey = CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 7 WHEN c_custkey % 2 = 0 THEN c_custkey END""",
    "appended_segments": "SELECT user_id AS k, max(event_type) AS body FROM events WHERE event_id % 2 = 1 AND user_id % 3 = 0 GROUP BY 1 UNION ALL SELECT user_id, arg_max(event_type, event_id) FROM events WHERE event_id % 2 = 0 AND user_id % 3 <> 1 AND NOT (user_id % 3 = 0 AND user_id IN (SELECT user_id FROM events WHERE event_id % 2 = 1)) GROUP BY 1",
    "resolved_by_doi": "SELECT DISTINCT concat(CASE WHEN o_custkey % 2 = 0 THEN 'https://doi.org/' ELSE '' END, '10.1234/A', o_custkey) AS name, CASE WHEN o_custkey % 3 > 0 AND o_custkey IN (SELECT c_custkey FROM customer) THEN concat('r', o_custkey) ELSE '' END AS rid, CASE WHEN o_custkey % 3 > 0 AND o_custkey IN (SELECT c_custkey FROM customer) THEN 'doi' ELSE '' END AS how FROM orders",
    "diary_by_day": _DAYS,
    "diary_by_month": f"SELECT strftime(day, '%Y-%m') AS month, count(*) AS days, CAST(sum(click) AS BIGINT) AS click, CAST(sum(view) AS BIGINT) AS view, CAST(sum(purchase) AS BIGINT) AS purchase, CAST(sum(total) AS BIGINT) AS total FROM ({_DAYS}) GROUP BY 1",
    "resolved_failures": "SELECT event_id AS id, CASE WHEN EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = e.event_type AND x.event_id % 5 = 0) THEN 1 ELSE 0 END AS resolved FROM events e",
    "cached_vectors": "SELECT q.item_id AS query_id, md5(trim(concat(' ', q.text), ' ')) AS key, b.item_id AS vector FROM benchmark q LEFT JOIN (SELECT md5(trim(text, ' ')) AS key, item_id FROM benchmark WHERE item_id % 2 = 0) b ON b.key = md5(trim(concat(' ', q.text), ' '))",
    "cache_hits": "SELECT CAST(c_custkey AS VARCHAR) AS key, c_custkey % 4 + (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS hits FROM customer",
    "stream_sliding": "SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY]) AS start FROM events) GROUP BY 1, 2",
    "stream_visits": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM r GROUP BY user_id, run",
}
ORACLE_SQL = {k: _DUCK(v) for k, v in ORACLE_SQL.items()}
