"""Citation-graph and cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning, graph
from ..operators.components import connected_components
from ..schema import rounded
from .standins import BIPARTITE, EDGES, PAPERS, bipartite, edges, papers, table, view

FILTER = graph.NodeFilter(year_from=1995, year_to=2020, min_citations=5, quartiles=("Q1", "Q2", "Q3"))
LIMIT = 1_500
RULES = cleaning.CleaningRules(min_year=2000, min_impact=9.5, keep_quartiles=("Q1", "Q2", "Q3"), min_library_citations=2, non_wos=True)
RANK_ROUNDS = 8
KEYWORDS = "split(kind, ' ')"

_P = f"p AS ({PAPERS}), e AS ({EDGES})"
_SEL = f"""{_P}, sel AS (SELECT * FROM p WHERE regexp_matches(year, '^[0-9]{{4}}$') AND TRY_CAST(year AS BIGINT) BETWEEN 1995 AND 2020 AND times_cited >= 5 AND quartile IN ('Q1','Q2','Q3')
            ORDER BY times_cited DESC, doi LIMIT {LIMIT}),
       ind AS (SELECT citing, cited FROM e WHERE citing IN (SELECT doi FROM sel) AND cited IN (SELECT doi FROM sel)),
       ends AS (SELECT citing AS doi FROM ind UNION SELECT cited FROM ind)"""
_LAX = "coalesce(TRY_CAST(regexp_extract(year, '^[ ]*([+-]?[0-9]+)', 1) AS BIGINT), 0)"
_REASONS = {
    "year": f"{_LAX} < 2000", "impact": "impact_factor < 9.5", "quartile": "quartile NOT IN ('Q1','Q2','Q3')", "library": "library_citations < 2",
    "non_wos": "(NOT (source_main ILIKE 'wos%') OR abstract = '')",
}
_GONE = "(is_reference AND (" + " OR ".join(_REASONS.values()) + "))"
_METRICS = """SELECT CAST(l_suppkey AS STRING) AS journal_name, CAST(year(l_shipdate) AS BIGINT) AS year, max(l_extendedprice) AS jif, max(l_returnflag) AS quartile FROM lineitem GROUP BY 1, 2"""


def with_keywords(spark, sf):
    return papers(spark, sf).withColumn("keywords", F.split("kind", " "))


def network_nodes(spark, sf):
    nodes, _ = graph.build_network(papers(spark, sf), edges(spark, sf), FILTER, "times_cited", LIMIT)
    return nodes.select("doi", "times_cited", "filtered_citations")


def network_edges(spark, sf):
    return graph.build_network(papers(spark, sf), edges(spark, sf), FILTER, "times_cited", LIMIT)[1]


def network_meta(spark, sf):
    return graph.network_meta(papers(spark, sf), edges(spark, sf), FILTER, "times_cited", LIMIT)


def isolated_nodes(spark, sf):
    return graph.isolated(papers(spark, sf), edges(spark, sf)).select("doi")


def in_out_degree(spark, sf):
    return graph.degrees(edges(spark, sf))


def neighbours(spark, sf):
    return graph.neighbours(edges(spark, sf), papers(spark, sf).where("id % 50 = 1").select("doi"), cap=8)


def library_citations(spark, sf):
    return graph.library_citations(papers(spark, sf), edges(spark, sf))


def cocitation_pairs(spark, sf):
    return graph.cocitation_pairs(bipartite(spark, sf), 2)


def components(spark, sf):
    pairs = graph.cocitation_pairs(bipartite(spark, sf), 3)
    return connected_components(pairs.select(F.col("a").cast("bigint").alias("src"), F.col("b").cast("bigint").alias("dst")))


def paper_rank(spark, sf):
    r = graph.paper_rank(papers(spark, sf), edges(spark, sf), rounds=RANK_ROUNDS)
    return r.select("doi", rounded(F.col("rank"), 9).alias("rank"), "in_degree", "out_degree")


def top_papers(spark, sf):
    return papers(spark, sf).where(~F.col("is_reference")).orderBy(F.desc("paper_rank"), "doi").limit(25).select("doi", "title", "paper_rank")


def cluster_keywords(spark, sf):
    return graph.cluster_keywords(with_keywords(spark, sf))


def cluster_peers(spark, sf):
    p = papers(spark, sf)
    return graph.cluster_peers(p, p.where("id % 40 = 3").select("doi"))


def facets(spark, sf):
    return graph.facets(papers(spark, sf))


def facet_counts(spark, sf):
    return graph.facet_counts(papers(spark, sf))


def cleaning_preview(spark, sf):
    return cleaning.preview(papers(spark, sf), RULES)


def cleaning_samples(spark, sf):
    return cleaning.samples(papers(spark, sf), RULES)


def cleaning_execute_papers(spark, sf):
    return cleaning.execute(papers(spark, sf), edges(spark, sf), RULES)[0].select("doi")


def cleaning_execute_edges(spark, sf):
    return cleaning.execute(papers(spark, sf), edges(spark, sf), RULES)[1]


def cleaning_mark(spark, sf):
    return cleaning.mark(papers(spark, sf), RULES).select("doi", "is_cleaned")


def latest_metric_lookup(spark, sf):
    p = view(spark, sf, "SELECT CAST(s_suppkey AS STRING) AS doi, CAST(s_suppkey AS STRING) AS journal, 0.0e0 AS impact_factor, '' AS quartile FROM supplier")
    return cleaning.attach_metrics(p, view(spark, sf, _METRICS)).select("doi", "journal", "impact_factor", "quartile")


def journal_rename(spark, sf):
    names = view(spark, sf, "SELECT DISTINCT p_brand AS old, concat('Journal of ', p_brand) AS new FROM part WHERE p_brand LIKE '%1%'")
    return cleaning.rename(papers(spark, sf), names).select("doi", "journal")


def distinct_journals(spark, sf):
    return cleaning.distinct_journals(papers(spark, sf))


def _rank_sql() -> str:
    steps = ["r0 AS (SELECT doi, 1.0 / (SELECT count(*) FROM n) AS r FROM n)"]
    for k in range(RANK_ROUNDS):
        steps.append(
            f"r{k + 1} AS (SELECT n.doi, 0.15 / (SELECT count(*) FROM n) + 0.85 * (SELECT coalesce(sum(r), 0) FROM r{k} JOIN n USING (doi) WHERE o = 0) / (SELECT count(*) FROM n) + 0.85 * coalesce(g.s, 0) AS r "
            f"FROM n LEFT JOIN (SELECT i.cited AS doi, sum(r{k}.r / n.o) AS s FROM i JOIN r{k} ON r{k}.doi = i.citing JOIN n ON n.doi = i.citing GROUP BY 1) g ON g.doi = n.doi)"
        )
    return f"""WITH {_P}, i AS (SELECT * FROM e WHERE citing IN (SELECT doi FROM p) AND cited IN (SELECT doi FROM p)),
        n AS (SELECT p.doi, coalesce(a.c, 0) AS d, coalesce(b.c, 0) AS o FROM p LEFT JOIN (SELECT cited AS doi, count(*) AS c FROM i GROUP BY 1) a USING (doi) LEFT JOIN (SELECT citing AS doi, count(*) AS c FROM i GROUP BY 1) b USING (doi)),
        {', '.join(steps)} SELECT n.doi, floor(r * 1000000000 + 0.5) / 1000000000.0 AS rank, CAST(d AS BIGINT) AS in_degree, CAST(o AS BIGINT) AS out_degree FROM r{RANK_ROUNDS} JOIN n USING (doi)"""


QUERIES = {
    f.__name__: f
    for f in (
        network_nodes, network_edges, network_meta, isolated_nodes, in_out_degree, neighbours, library_citations, cocitation_pairs, components, paper_rank, top_papers, cluster_keywords, cluster_peers,
        facets, facet_counts, cleaning_preview, cleaning_samples, cleaning_execute_papers, cleaning_execute_edges, cleaning_mark, latest_metric_lookup, journal_rename, distinct_journals,
    )
}

ORACLE_SQL = {
    "network_nodes": f"WITH {_SEL} SELECT doi, times_cited, (SELECT count(*) FROM ind WHERE cited = sel.doi) AS filtered_citations FROM sel WHERE doi IN (SELECT doi FROM ends)",
    "network_edges": f"WITH {_SEL} SELECT citing, cited FROM ind",
    "network_meta": f"""WITH {_SEL}, m AS (SELECT count(*) AS matched FROM p WHERE regexp_matches(year, '^[0-9]{{4}}$') AND TRY_CAST(year AS BIGINT) BETWEEN 1995 AND 2020 AND times_cited >= 5 AND quartile IN ('Q1','Q2','Q3'))
        SELECT matched, (SELECT count(*) FROM sel) AS selected, (SELECT count(*) FROM ends) AS nodes, (SELECT count(*) FROM ind) AS edges, matched > (SELECT count(*) FROM sel) AS truncated FROM m""",
    "isolated_nodes": f"WITH {_P} SELECT doi FROM p WHERE doi NOT IN (SELECT citing FROM e) AND doi NOT IN (SELECT cited FROM e)",
    "in_out_degree": f"WITH {_P} SELECT doi, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT citing AS doi, 0 AS i, 1 AS o FROM e UNION ALL SELECT cited, 1, 0 FROM e) GROUP BY doi",
    "neighbours": f"""WITH {_P}, s AS (SELECT doi FROM p WHERE id % 50 = 1), b AS (SELECT citing AS doi, cited AS neighbour, 'cites' AS direction FROM e WHERE citing IN (SELECT doi FROM s) UNION SELECT cited, citing, 'cited_by' FROM e WHERE cited IN (SELECT doi FROM s))
        SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY doi, direction ORDER BY neighbour) <= 8""",
    "library_citations": f"WITH {_P} SELECT p.doi, coalesce(c.n, 0) AS library_citations FROM p LEFT JOIN (SELECT cited AS doi, count(*) AS n FROM e GROUP BY 1) c USING (doi)",
    "cocitation_pairs": f"WITH b AS ({BIPARTITE}) SELECT x.cited AS a, y.cited AS b, count(*) AS weight FROM b x JOIN b y ON x.citing = y.citing AND x.cited < y.cited GROUP BY 1, 2 HAVING count(*) >= 2",
    "components": f"""WITH RECURSIVE b AS ({BIPARTITE}), pr AS (SELECT CAST(x.cited AS BIGINT) AS a, CAST(y.cited AS BIGINT) AS b FROM b x JOIN b y ON x.citing = y.citing AND x.cited < y.cited GROUP BY 1, 2 HAVING count(*) >= 3),
        g AS (SELECT a AS u, b AS v FROM pr UNION SELECT b, a FROM pr), r AS (SELECT DISTINCT u AS node, u AS seen FROM g UNION SELECT r.node, g.v FROM r JOIN g ON g.u = r.seen)
        SELECT node, min(seen) AS component FROM r GROUP BY node""",
    "paper_rank": _rank_sql(),
    "top_papers": f"WITH {_P} SELECT doi, title, paper_rank FROM p WHERE NOT is_reference ORDER BY paper_rank DESC, doi LIMIT 25",
    "cluster_keywords": f"""WITH p AS ({PAPERS}), w AS (SELECT cluster, trim(unnest(string_split(kind, ' '))) AS keyword FROM p WHERE cluster > 0), c AS (SELECT cluster, keyword, count(*) AS n FROM w WHERE length(keyword) > 1 GROUP BY 1, 2)
        SELECT cluster, (SELECT count(*) FROM p WHERE p.cluster = c.cluster) AS size, CAST(row_number() OVER (PARTITION BY cluster ORDER BY n DESC, keyword) AS BIGINT) AS nth, keyword, n FROM c QUALIFY nth <= 5""",
    "cluster_peers": f"""WITH p AS ({PAPERS}) SELECT a.doi AS seed, CAST(row_number() OVER (PARTITION BY a.doi ORDER BY b.paper_rank DESC, b.doi) AS BIGINT) AS nth, b.doi FROM p a JOIN p b ON a.cluster = b.cluster AND a.doi <> b.doi
        WHERE a.id % 40 = 3 AND a.cluster > 0 QUALIFY nth <= 5""",
    "facets": f"""WITH p AS ({PAPERS}), x AS (SELECT *, CASE WHEN impact_factor > 0 THEN impact_factor END AS f, CASE WHEN regexp_matches(year, '^[0-9]{{4}}$') THEN TRY_CAST(year AS BIGINT) END AS y FROM p)
        SELECT count(*) AS papers, min(times_cited) AS min_cites, max(times_cited) AS max_cites, floor(avg(times_cited) * 100 + 0.5) / 100.0 AS avg_cites, min(f) AS min_impact, max(f) AS max_impact,
               floor(avg(f) * 1000 + 0.5) / 1000.0 AS avg_impact, min(y) AS min_year, max(y) AS max_year FROM x""",
    "facet_counts": f"""WITH p AS ({PAPERS}) SELECT 'quartile' AS facet, quartile AS value, count(*) AS n FROM p WHERE quartile IN ('Q1','Q2','Q3','Q4') GROUP BY 2
        UNION ALL (SELECT 'cluster', CAST(cluster AS VARCHAR), count(*) FROM p WHERE cluster > 0 GROUP BY cluster ORDER BY 3 DESC, cluster LIMIT 200)""",
    "cleaning_preview": f"WITH p AS ({PAPERS}) SELECT count(*) AS total, count(*) FILTER ({_GONE}) AS to_remove, count(*) FILTER (NOT {_GONE}) AS to_keep, "
    + ", ".join(f"count(*) FILTER (is_reference AND {v}) AS by_{k}" for k, v in _REASONS.items()) + " FROM p",
    "cleaning_samples": f"WITH p AS ({PAPERS}) SELECT doi, substr(title, 1, 60) AS title FROM p WHERE {_GONE} ORDER BY doi LIMIT 20",
    "cleaning_execute_papers": f"WITH p AS ({PAPERS}) SELECT doi FROM p WHERE NOT {_GONE}",
    "cleaning_execute_edges": f"WITH {_P}, g AS (SELECT doi FROM p WHERE {_GONE}) SELECT citing, cited FROM e WHERE citing NOT IN (SELECT doi FROM g) AND cited NOT IN (SELECT doi FROM g)",
    "cleaning_mark": f"WITH p AS ({PAPERS}) SELECT doi, {_GONE} AS is_cleaned FROM p",
    "latest_metric_lookup": f"""WITH m AS ({_METRICS}), l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY upper(journal_name) ORDER BY year DESC, jif DESC) = 1)
        SELECT CAST(s_suppkey AS VARCHAR) AS doi, CAST(s_suppkey AS VARCHAR) AS journal, coalesce(jif, 0.0) AS impact_factor, coalesce(quartile, '') AS quartile FROM supplier LEFT JOIN l ON upper(journal_name) = CAST(s_suppkey AS VARCHAR)""",
    "journal_rename": f"WITH p AS ({PAPERS}) SELECT doi, CASE WHEN journal LIKE '%1%' THEN concat('Journal of ', journal) ELSE journal END AS journal FROM p",
    "distinct_journals": f"WITH p AS ({PAPERS}) SELECT journal, count(*) AS n, min(doi) AS sample FROM p WHERE journal <> '' GROUP BY 1",
}
