"""Journal metrics by a cascade of keys, and matching of names and titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import initials, journal_key, loose_journal_key, surname
from ..scratch import materialize
from .merge import first_by


def with_zones(metrics: DataFrame, zones: DataFrame, year: int | None = None) -> DataFrame:
    """`metrics` with the zone of the journal of the same name key: that of `year` if there is one, else of the latest year.

    zones: journal_name, year, zone.
    """
    asked = F.desc(F.col("year") == year) if year is not None else F.lit(0)
    best = first_by(zones.withColumn("_key", journal_key(F.col("journal_name"))).where("_key <> ''"), ["_key"], [asked, F.desc("year"), "zone"])
    joined = metrics.withColumn("_key", journal_key(F.col("journal_name"))).join(best.select("_key", "zone", F.col("year").alias("zone_year")), "_key", "left")
    return joined.drop("_key")


def lookup(papers: DataFrame, metrics: DataFrame) -> DataFrame:
    """`papers` (journal_override, issn, eissn, journal) with the metrics of their journal: metric_name, jif, metric_quartile, how.

    First the name given by hand, then ISSN, eISSN, the journal's name, and last the name without a place behind it. A name
    is looked up by its key, and only where that finds nothing by the loose key. Of several rows the latest year counts.
    """
    latest = [F.desc("year"), F.desc("jif"), "journal_name"]
    named = metrics.withColumn("_name", journal_key(F.col("journal_name"))).withColumn("_loose", loose_journal_key(F.col("journal_name")))

    def index(key: Column, name: str) -> DataFrame:
        rows = named.select(key.alias(f"_k{name}"), "year", "jif", "journal_name", "quartile").where(f"_k{name} <> ''")
        return first_by(rows, [f"_k{name}"], latest).select(f"_k{name}", F.struct("journal_name", "jif", "quartile").alias(f"_v{name}"))

    code = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    steps = [
        ("override", journal_key(text("journal_override")), F.col("_name")), ("override_loose", loose_journal_key(text("journal_override")), F.col("_loose")), ("issn", code(F.col("issn")), code(F.col("issn"))),
        ("eissn", code(F.col("eissn")), code(F.col("eissn"))), ("name", journal_key(text("journal")), F.col("_name")), ("name_loose", loose_journal_key(text("journal")), F.col("_loose")),
    ]
    named = named.withColumn("issn", code(F.col("issn"))).withColumn("eissn", code(F.col("eissn")))
    out = papers
    for name, mine, theirs in steps:
        out = out.withColumn(f"_k{name}", mine).join(index(theirs, name), f"_k{name}", "left")
    found = F.coalesce(*(F.col(f"_v{n}") for n, _, _ in steps))
    how = F.coalesce(*(F.when(F.col(f"_v{n}").isNotNull(), n) for n, _, _ in steps), F.lit(""))
    out = out.withColumn("_f", found).withColumn("how", how)
    return out.select(*papers.columns, F.col("_f.journal_name").alias("metric_name"), F.col("_f.jif").alias("jif"), F.col("_f.quartile").alias("metric_quartile"), "how")


def match_titles(wanted: DataFrame, known: DataFrame, block: int = 12) -> DataFrame:
    """(query_id, doi): the first known record whose title is that of the query or begins with it, or the other way round.

    Titles are compared in lower case with single blanks, each text once, however many records have it. A title's heads meet whole
    titles by equality: heads of under `block` characters all, longer ones where a title of that length begins with the same
    `block` characters. Of all records with a head only the first goes on, so no title meets all others. known: position, doi, title.
    """
    clean = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    left = lambda c, n: F.expr(f"left({c}, {n})")
    first = lambda df, by: df.groupBy(by).agg(F.min("position").alias("position"), F.min_by("doi", "position").alias("doi"))
    q = wanted.select("query_id", clean(F.col("title")).alias("q")).where("q <> ''")
    k = first(known.select("position", "doi", clean(F.col("title")).alias("t")).where("t <> ''"), "t")
    asked = q.select("q").distinct()

    def heads(rows: DataFrame, c: str, whole: DataFrame, w: str) -> DataFrame:
        lengths = whole.where(F.length(w) >= block).groupBy(left(w, block).alias("_s")).agg(F.collect_set(F.length(w)).alias("_n"))
        short = rows.select("*", F.explode(F.sequence(F.lit(1), F.least(F.length(c), F.lit(block - 1)))).alias("_n"))
        long = rows.where(F.length(c) >= block).withColumn("_s", left(c, block)).join(lengths, "_s").drop("_s")
        long = long.withColumn("_n", F.explode(F.filter("_n", lambda n: n <= F.length(c))))
        return short.unionByName(long).withColumn("head", left(c, "_n")).drop("_n")

    begins = heads(asked, "q", k, "t").join(k.withColumnRenamed("t", "head"), "head").select("q", "position", "doi")
    goes_on = first(heads(k, "t", asked, "q"), "head").join(asked.withColumnRenamed("q", "head"), "head").select(F.col("head").alias("q"), "position", "doi")
    best = first(begins.unionByName(goes_on), "q")
    return q.join(best, "q").groupBy("query_id").agg(F.min_by("doi", "position").alias("doi"))


def match_names(short: DataFrame, full: DataFrame) -> DataFrame:
    """(group, short, full): each abbreviated name with the full name of its group that it stands for, itself if there is none.

    The surname must be equal. Equal initials win, in order of position; else the first whose initials begin with those of the
    other. short: group, short; full: group, position, full.
    """
    a = short.select("group", "short", surname(F.col("short")).alias("s"), initials(F.col("short")).alias("i")).distinct()
    b = full.select("group", "position", "full", surname(F.col("full")).alias("s"), initials(F.col("full")).alias("j"))
    fits = F.when(F.col("i") == F.col("j"), 0).when(F.startswith("j", "i") | F.startswith("i", "j"), 1)
    best = a.join(b, ["group", "s"]).withColumn("_fit", fits).where("_fit is not null").groupBy("group", "short").agg(F.min_by("full", F.struct("_fit", "position")).alias("full"))
    return a.select("group", "short").join(best, ["group", "short"], "left").select("group", "short", F.coalesce("full", "short").alias("full"))


def corresponding_authors(papers: DataFrame) -> DataFrame:
    """(doi, corresponding): the corresponding authors that affiliation blocks mark, by their full names, each once in order.

    papers: doi, affiliations (blocks such as "Zhang, Y; Wang, JH (Corresponding Author), Tsinghua"), authors.
    """
    blocks = papers.select("doi", F.posexplode("affiliations").alias("block", "text"))
    names = blocks.select("doi", "block", F.posexplode(F.split(F.regexp_extract(F.trim("text"), r"(?i)^(.+?)\s*\(Corresponding Author\)", 1), ";")).alias("nth", "name"))
    names = names.select("doi", "block", "nth", F.trim(F.regexp_replace(F.trim("name"), ",+$", "")).alias("short")).where("short <> ''")
    people = papers.select(F.col("doi").alias("group"), F.posexplode("authors").alias("position", "full"))
    matched = names.join(match_names(names.select(F.col("doi").alias("group"), "short"), people).withColumnRenamed("group", "doi"), ["doi", "short"])
    first = matched.groupBy("doi", "full").agg(F.min(F.struct("block", "nth")).alias("at"))
    return first.groupBy("doi").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "full"))), lambda x: x["full"]).alias("corresponding"))


def enrich_hits(hits: DataFrame, items: DataFrame) -> DataFrame:
    """`hits` (rid, doi) with kind and attachments of the item that has this key as its rid, doi or dir; of several the first by position.

    items: position, rid, doi, dir, kind, attachments.
    """
    keys = items.select("position", "kind", "attachments", F.explode(F.array_distinct(F.array_compact(F.array(*(F.nullif(F.col(c), F.lit("")) for c in ("rid", "doi", "dir")))))).alias("_key"))
    first = first_by(keys, ["_key"], [F.col("position")]).select("_key", "kind", "attachments")
    asked = hits.withColumn("_key", F.coalesce(F.nullif("rid", F.lit("")), "doi"))
    return asked.join(first, "_key", "left").drop("_key").withColumn("kind", F.coalesce("kind", F.lit(""))).withColumn("attachments", F.coalesce("attachments", F.lit(0).cast("bigint")))


def shared_concepts(concepts: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, shared): documents a < b and the concepts they share, `least` or more, in order of name.

    For two or more, documents meet by pairs of concepts where these are fewer than the pairs of documents that share a concept: pairs
    then grow with the square of a document's concepts, not of a concept's documents. They meet by a hash, and their concepts are compared.
    """
    each = concepts.where("doi is not null and name is not null").select("doi", "name").distinct()
    if least > 1:
        each = materialize(each, "concepts")
        pairs = F.coalesce(F.sum(F.col("count").cast("decimal(20,0)") * (F.col("count") - 1)), F.lit(0))
        by_name, by_doc = (each.groupBy(c).count().agg(pairs).first()[0] for c in ("name", "doi"))
        if by_doc < by_name:
            return _by_concept_pairs(each, least)
    a, b = (each.withColumnRenamed("doi", k) for k in "ab")
    return a.join(b, "name").where("a < b").groupBy("a", "b").agg(F.array_sort(F.collect_set("name")).alias("shared")).where(F.size("shared") >= least)


def _by_concept_pairs(each: DataFrame, least: int) -> DataFrame:
    """`shared_concepts` of distinct rows (doi, name) for two or more."""
    lists = materialize(each.groupBy("doi").agg(F.array_sort(F.collect_list("name")).alias("names")).where(F.size("names") >= least), "concept-lists")
    one = lists.select("doi", "names", F.posexplode("names").alias("i", "x"))
    two = one.select("doi", F.explode(F.transform(F.slice("names", F.col("i") + 2, F.size("names")), lambda y: F.xxhash64("x", y))).alias("h"))
    a, b = (two.withColumnRenamed("doi", k) for k in "ab")
    met = materialize(a.join(b, "h").where("a < b").select("a", "b").distinct(), "concept-candidates")
    for k in "ab":
        met = met.join(lists.select(F.col("doi").alias(k), F.col("names").alias(f"n{k}")), k)
    return met.select("a", "b", F.array_sort(F.array_intersect("na", "nb")).alias("shared")).where(F.size("shared") >= least)


def canonical_concepts(concepts: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(doi, name, definition) with the longest definition of each name in a document, and (name, papers) of names in `least` documents or more."""
    from ..functions.text import concept

    named = concepts.select("doi", concept(F.col("name")).alias("name"), F.coalesce("definition", F.lit("")).alias("definition"), "position").where("doi <> '' and name <> ''")
    one = named.groupBy("doi", "name").agg(F.min_by("definition", F.struct(-F.length("definition"), "position")).alias("definition"))
    return one, one.groupBy("name").agg(F.count(F.lit(1)).alias("papers")).where(F.col("papers") >= least)


def related(concept_hits: DataFrame, shared: DataFrame, citations: DataFrame, peers: DataFrame, k: int = 10) -> DataFrame:
    """(doi, other, score, connection): the k documents most related to each.

    Concept hits (doi, other, score, name) and shared concepts (doi, other, name; 0.3) count by their maximum; citations (0.4) and
    cluster peers (0.35) only add documents that neither has found, citations first. Ties by channel, then key.
    """
    n = {c: F.col(c) for c in ("doi", "other")}
    ranked = [
        concept_hits.select(*n.values(), "score", F.concat(F.lit("concept:"), "name").alias("connection"), F.lit(0).alias("channel")),
        shared.groupBy("doi", "other").agg(F.min("name").alias("name")).select(*n.values(), F.lit(0.3).alias("score"), F.concat(F.lit("concept:"), "name").alias("connection"), F.lit(1).alias("channel")),
        citations.select(*n.values(), F.lit(0.4).alias("score"), F.lit("citation").alias("connection"), F.lit(2).alias("channel")),
        peers.select(*n.values(), F.lit(0.35).alias("score"), F.lit("cluster").alias("connection"), F.lit(3).alias("channel")),
    ]
    every = ranked[0].unionByName(ranked[1]).unionByName(ranked[2]).unionByName(ranked[3]).where("doi <> other")
    # of the concept channels the maximum, of the others the first; the name comes from the first channel that gave one
    told = every.groupBy("doi", "other").agg(F.max(F.when(F.col("channel") < 2, F.col("score"))).alias("c"), F.min_by("score", "channel").alias("f"), F.min_by("connection", F.struct("channel", (-F.col("score")).alias("s"), "connection")).alias("connection"), F.min("channel").alias("channel"))
    scored = told.select("doi", "other", F.coalesce("c", "f").alias("score"), "connection", "channel")
    w = Window.partitionBy("doi").orderBy(F.desc("score"), "channel", "other")
    return scored.withColumn("nth", F.row_number().over(w).cast("bigint")).where(F.col("nth") <= k).drop("channel")
