"""Citation-graph operators: selection, induced sub-graphs, degrees, ranking, co-citation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import rounded, strict_year
from ..scratch import discard, materialize

SORT_COLUMNS = ("times_cited", "library_citations", "impact_factor", "paper_rank", "year")
DEFAULT_NODES, MOST_NODES = 5_000, 100_000
QUARTILES = ("Q1", "Q2", "Q3", "Q4")


@dataclass(frozen=True)
class NodeFilter:
    """Optional conditions on papers, all of which must hold."""

    year_from: int | None = None
    year_to: int | None = None
    min_library_citations: int | None = None
    min_citations: int | None = None
    min_impact: float | None = None
    quartiles: tuple[str, ...] = ()
    cluster: int | None = None
    exclude_references: bool = False

    def condition(self) -> Column:
        year = strict_year(F.col("year"))
        allowed = [q for q in self.quartiles if q in QUARTILES]
        parts = [
            None if self.year_from is None else year >= self.year_from,
            None if self.year_to is None else year <= self.year_to,
            None if self.min_library_citations is None else F.col("library_citations") >= self.min_library_citations,
            None if self.min_citations is None else F.col("times_cited") >= self.min_citations,
            None if self.min_impact is None else F.col("impact_factor") >= self.min_impact,
            F.col("quartile").isin(allowed) if allowed else None,
            None if self.cluster is None else F.col("cluster") == self.cluster,
            ~F.col("is_reference") if self.exclude_references else None,
        ]
        return reduce(lambda a, b: a & b, [p for p in parts if p is not None], F.lit(True))


def select_nodes(papers: DataFrame, where: NodeFilter, sort_by: str = "times_cited", limit: int = DEFAULT_NODES) -> DataFrame:
    """The top papers that a filter lets pass; unknown sort columns fall back to citations, ties go by doi."""
    column = sort_by if sort_by in SORT_COLUMNS else SORT_COLUMNS[0]
    return papers.where(where.condition()).orderBy(F.desc_nulls_last(column), "doi").limit(max(1, min(limit, MOST_NODES)))


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("doi")
    return edges.join(ids.withColumnRenamed("doi", "citing"), "citing", "left_semi").join(ids.withColumnRenamed("doi", "cited"), "cited", "left_semi").select("citing", "cited")


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("citing").alias("doi")).union(edges.select(F.col("cited").alias("doi"))).distinct()


def build_network(papers: DataFrame, edges: DataFrame, where: NodeFilter, sort_by: str = "times_cited", limit: int = DEFAULT_NODES, drop_isolated: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the induced sub-graph; nodes carry their citations within it."""
    nodes = select_nodes(papers, where, sort_by, limit)
    inner = induced_edges(edges, nodes)
    cited = inner.groupBy(F.col("cited").alias("doi")).agg(F.count(F.lit(1)).alias("filtered_citations"))
    nodes = nodes.join(cited, "doi", "left").withColumn("filtered_citations", F.coalesce("filtered_citations", F.lit(0)).cast("bigint"))
    if drop_isolated:
        nodes = nodes.join(endpoints(inner), "doi", "left_semi")
    return nodes, inner


def network_meta(papers: DataFrame, edges: DataFrame, where: NodeFilter, sort_by: str = "times_cited", limit: int = DEFAULT_NODES) -> DataFrame:
    """One row of counts: matched papers, selected, nodes and edges after isolated ones are gone, and whether the limit cut."""
    matched = papers.where(where.condition()).agg(F.count(F.lit(1)).alias("matched"))
    chosen = select_nodes(papers, where, sort_by, limit)
    inner = induced_edges(edges, chosen)
    counts = matched.crossJoin(chosen.agg(F.count(F.lit(1)).alias("selected"))).crossJoin(inner.agg(F.count(F.lit(1)).alias("edges")))
    counts = counts.crossJoin(endpoints(inner).agg(F.count(F.lit(1)).alias("nodes")))
    return counts.select("matched", "selected", "nodes", "edges", (F.col("matched") > F.col("selected")).alias("truncated"))


def isolated(papers: DataFrame, edges: DataFrame) -> DataFrame:
    return papers.join(endpoints(edges), "doi", "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """In and out degree of every endpoint in one aggregation."""
    ends = edges.select(F.col("citing").alias("doi"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("cited", F.lit(1), F.lit(0)))
    return ends.groupBy("doi").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def neighbours(edges: DataFrame, seeds: DataFrame, cap: int | None = None) -> DataFrame:
    """Distinct neighbours of each seed in both directions; those it cites come first, and `cap` keeps the first of each direction."""
    out = edges.join(seeds.withColumnRenamed("doi", "citing"), "citing", "left_semi").select(F.col("citing").alias("doi"), F.col("cited").alias("neighbour"), F.lit("cites").alias("direction"))
    into = edges.join(seeds.withColumnRenamed("doi", "cited"), "cited", "left_semi").select(F.col("cited").alias("doi"), F.col("citing").alias("neighbour"), F.lit("cited_by").alias("direction"))
    both = out.union(into).distinct()
    if cap is None:
        return both
    w = Window.partitionBy("doi", "direction").orderBy("neighbour")
    return both.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap).drop("n")


def library_citations(papers: DataFrame, edges: DataFrame) -> DataFrame:
    """Citations from within the library, 0 where there are none."""
    counts = edges.groupBy(F.col("cited").alias("doi")).agg(F.count(F.lit(1)).alias("library_citations"))
    return papers.select("doi").join(counts, "doi", "left").select("doi", F.coalesce("library_citations", F.lit(0)).cast("bigint").alias("library_citations"))


def cocitation_pairs(edges: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, weight): pairs a < b cited together by `least` papers or more."""
    one = edges.select("citing", F.col("cited").alias("a")).distinct()
    two = one.withColumnRenamed("a", "b")
    return one.join(two, "citing").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= least)


def facets(papers: DataFrame) -> DataFrame:
    """Ranges of the numeric filters in one pass: impact only above 0, years only of four digits."""
    year, impact = strict_year(F.col("year")), F.when(F.col("impact_factor") > 0, F.col("impact_factor"))
    return papers.agg(
        F.count(F.lit(1)).alias("papers"), F.min("times_cited").alias("min_cites"), F.max("times_cited").alias("max_cites"), rounded(F.avg("times_cited"), 2).alias("avg_cites"),
        F.min(impact).alias("min_impact"), F.max(impact).alias("max_impact"), rounded(F.avg(impact), 3).alias("avg_impact"), F.min(year).alias("min_year"), F.max(year).alias("max_year"),
    )


def facet_counts(papers: DataFrame, top_clusters: int = 200) -> DataFrame:
    """(facet, value, n) for quartiles and the largest clusters."""
    q = papers.where(F.col("quartile").isin(*QUARTILES)).groupBy(F.col("quartile").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("quartile").alias("facet"), "value", "n")
    c = papers.where("cluster > 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cluster").limit(top_clusters)
    return q.union(c.select(F.lit("cluster"), F.col("cluster").cast("string"), "n"))


def cluster_keywords(papers: DataFrame, top: int = 5) -> DataFrame:
    """(cluster, size, nth, keyword, n): the most frequent keywords of each cluster, ties by keyword."""
    size = papers.where("cluster > 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    words = papers.where("cluster > 0").select("cluster", F.explode("keywords").alias("k")).select("cluster", F.trim("k").alias("keyword")).where(F.length("keyword") > 1)
    counts = words.groupBy("cluster", "keyword").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("nth", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "keyword"))).where(F.col("nth") <= top)
    return ranked.join(size, "cluster").select("cluster", "size", F.col("nth").cast("bigint").alias("nth"), "keyword", "n")


def cluster_peers(papers: DataFrame, seeds: DataFrame, k: int = 5) -> DataFrame:
    """The best ranked k papers of each seed's cluster, itself excluded.

    Seeds meet the head of their cluster only: the best 2k rows, of which at most k belong to one paper, leave k others.
    """
    best = (F.desc("paper_rank"), "doi")
    rows = papers.where("cluster > 0").select("doi", "cluster", "paper_rank")
    own = rows.join(seeds, "doi", "left_semi").select(F.col("doi").alias("seed"), "cluster")
    heads = rows
    for keys, most in ((["cluster", "doi"], k), (["cluster"], 2 * k)):
        heads = heads.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("_nth") <= most).drop("_nth")
    peers = own.join(heads, "cluster").where("doi <> seed")
    return peers.withColumn("nth", F.row_number().over(Window.partitionBy("seed").orderBy(*best)).cast("bigint")).where(F.col("nth") <= k).select("seed", "nth", "doi")


def paper_rank(papers: DataFrame, edges: DataFrame, damping: float = 0.85, max_rounds: int = 100, tolerance: float = 1e-6, rounds: int | None = None) -> DataFrame:
    """(doi, rank, in_degree, out_degree) by power iteration with dangling mass spread evenly.

    Stops when the ranks move by less than `tolerance` in sum, or after exactly `rounds`. Edges with an unknown end are
    ignored. Each round is one join and one aggregation on the same key, cut off as a table of the shared folder.
    """
    ids = materialize(papers.select("doi").distinct(), "rank-nodes")
    n = ids.count()
    if not n:
        return ids.select("doi", F.lit(0.0).alias("rank"), F.lit(0).cast("bigint").alias("in_degree"), F.lit(0).cast("bigint").alias("out_degree"))
    inner = induced_edges(edges.distinct(), ids)
    nodes = ids.join(degrees(inner), "doi", "left").select("doi", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("in_degree", "out_degree")))
    nodes = materialize(nodes, "rank-degrees")
    links = materialize(inner, "rank-edges")
    state = materialize(nodes.withColumn("rank", F.lit(1.0 / n)), "ranks")
    dangling = state.where("out_degree = 0").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
    for _ in range(rounds if rounds is not None else max_rounds):
        given = links.join(state.select(F.col("doi").alias("citing"), F.try_divide("rank", "out_degree").alias("share")), "citing").groupBy(F.col("cited").alias("doi")).agg(F.sum("share").alias("got"))
        fixed = (1 - damping) / n + damping * dangling / n
        after = state.select("doi", "in_degree", "out_degree", F.col("rank").alias("old")).join(given, "doi", "left").withColumn("rank", F.lit(fixed) + damping * F.coalesce("got", F.lit(0.0)))
        after = materialize(after.select("doi", "in_degree", "out_degree", "rank", F.abs(F.col("rank") - F.col("old")).alias("moved")), "ranks")
        discard(state)
        state = after
        moved, dangling = state.agg(F.sum("moved"), F.coalesce(F.sum(F.when(F.col("out_degree") == 0, F.col("rank"))), F.lit(0.0))).first()
        if rounds is None and moved < tolerance:
            break
    return state.select("doi", "rank", "in_degree", "out_degree")


#: Where the citations that a network shows come from.
CITATION_SOURCES = {"wos": "times_cited", "library": "library_citations", "filtered": "filtered_citations"}


def with_citations(nodes: DataFrame, source: str = "wos") -> DataFrame:
    """Nodes with cite_count: citations as recorded, from the library, or within the network."""
    return nodes.withColumn("cite_count", F.coalesce(CITATION_SOURCES.get(source, "filtered_citations"), F.lit(0)).cast("bigint"))


def network_preview(papers: DataFrame, edges: DataFrame, where: NodeFilter, sort_by: str = "times_cited", limit: int = DEFAULT_NODES) -> DataFrame:
    """One row of counts without building the network: matched papers, selected ones, and those of them that no edge at all touches."""
    chosen = select_nodes(papers, where, sort_by, limit).select("doi")
    n = F.count(F.lit(1))
    out = papers.where(where.condition()).agg(n.alias("matched")).crossJoin(chosen.agg(n.alias("selected")))  # single rows
    return out.crossJoin(chosen.join(endpoints(edges), "doi", "left_anti").agg(n.alias("isolated")))


def top_ranked(papers: DataFrame, ranks: DataFrame, n: int) -> DataFrame:
    """The n best ranked papers that are no references, by a table of ranks (doi, rank); papers without one come last."""
    joined = papers.where(~F.col("is_reference")).join(ranks.select("doi", "rank"), "doi", "left")
    return joined.orderBy(F.desc_nulls_last("rank"), "doi").limit(n)


def topics(papers: DataFrame, least: int = 3) -> DataFrame:
    """(slug, name, n, avg_cites, avg_rank, covered) of topics (doi, position, keywords, times_cited, paper_rank) of `least` papers or more.

    Keywords that make the same slug are one topic, named as first written; covered are its papers' keys in order.
    """
    from ..functions.text import slug

    each = papers.select("doi", "position", "times_cited", "paper_rank", F.posexplode("keywords").alias("k", "name")).select("*", slug(F.col("name")).alias("slug")).where(F.trim("name") != "")
    one = each.groupBy("slug", "doi", "times_cited", "paper_rank").agg(F.min(F.struct("position", "k", "name")).alias("f"))
    g = one.groupBy("slug").agg(F.min("f").alias("f"), F.count(F.lit(1)).alias("n"), F.avg("times_cited").alias("avg_cites"), F.avg("paper_rank").alias("avg_rank"), F.array_sort(F.collect_list("doi")).alias("covered"))
    return g.where(F.col("n") >= least).select("slug", "f.name", "n", "avg_cites", "avg_rank", "covered")
