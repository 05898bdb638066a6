"""Views of a document library: what is known, on disk and compiled; filters, pages, chips and health."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import dirname, from_dirname, has_no_identifier
from ..schema import strict_year

LEVELS = ("L1", "L2", "L3")
#: Scores from which a document is worth the second and the third level.
SECOND, THIRD = 2.5, 4.0
#: Kinds in the order in which chips show them; others follow by name.
KINDS = ("paper", "thesis", "book", "chapter", "patent", "standard", "report", "note")
MOST_PER_PAGE = 200


def job_state(jobs: DataFrame) -> DataFrame:
    """(key, compiled, queued, stale, error) of jobs (key, level, status, error, started_at, artifact).

    A finished level counts only while its product is there, else it is stale; the error is that of the latest failure.
    """
    levels = lambda c: F.array_sort(F.collect_set(F.when(c & F.col("level").isin(*LEVELS), F.col("level"))))
    done = F.col("status") == "done"
    failure = F.when((F.col("status") == "failed") & (F.col("error") != ""), F.col("started_at"))
    return jobs.where("key <> ''").groupBy("key").agg(
        levels(done & F.col("artifact")).alias("compiled"), levels(F.col("status").isin("queued", "compiling", "pending")).alias("queued"), levels(done & ~F.col("artifact")).alias("stale"),
        F.coalesce(F.max_by("error", failure), F.lit("")).alias("error"),
    )


def library_view(meta: DataFrame, scores: DataFrame, disk: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row per document that has metadata or a folder: the metadata where there are any, else what the folder tells.

    meta: rid, doi, title, journal, journal_override, year, quartile, impact_factor, kind; scores: key, score, level, ai;
    disk: key, dir, levels, dir_title; jobs as in `job_state`. The key of a document is its doi, else its rid. A folder
    without metadata has the levels whose products it holds.
    """
    none = F.array().cast("array<string>")
    known = meta.withColumn("key", F.when(F.coalesce("doi", F.lit("")) != "", F.trim("doi")).otherwise(F.col("rid"))).withColumn("source", F.lit("meta"))
    only = disk.join(known.select("key"), "key", "left_anti").select(
        "key", F.when(F.col("key").rlike(r"^10\.[0-9]{4,9}/\S+$"), F.col("key")).otherwise("").alias("doi"), F.col("key").alias("rid"), F.coalesce(F.nullif("dir_title", F.lit("")), "dir").alias("title"),
        *(F.lit("").alias(c) for c in ("journal", "journal_override", "year", "quartile")), F.lit(0.0).alias("impact_factor"), F.lit("paper").alias("kind"), F.lit("disk").alias("source"),
    )
    rows = known.select(only.columns).unionByName(only)
    joined = rows.join(scores, "key", "left").join(disk.select("key", "dir", F.col("levels").alias("_disk")), "key", "left").join(job_state(jobs), "key", "left")
    alone = F.col("source") == "disk"
    compiled = F.when(alone, F.col("_disk")).otherwise(F.coalesce("compiled", none))
    score = F.coalesce("score", F.lit(0.0))
    out = joined.withColumn("compiled", compiled).withColumn("queued", F.when(alone, none).otherwise(F.coalesce("queued", none))).withColumn("stale", F.coalesce("stale", none))
    out = out.withColumn("score", score).withColumn("level", F.coalesce("level", F.lit("L1"))).withColumn("error", F.coalesce("error", F.lit(""))).withColumn("on_disk", F.col("dir").isNotNull())
    ripe = F.array_contains("compiled", "L2") & ~F.array_contains("compiled", "L3") & (F.col("score") >= THIRD) & F.coalesce("ai", F.lit(False))
    return out.withColumn("third_level_next", ripe).drop("_disk", "ai")


@dataclass(frozen=True)
class LibraryFilter:
    """Conditions on the library view, all of which must hold; '' and 0 ask for nothing."""

    journal: str = ""
    status: str = ""
    score_min: float = 0.0
    quartiles: tuple[str, ...] = ()
    year_from: int = 0
    year_to: int = 0
    min_impact: float = 0.0
    on_disk_only: bool = True

    def condition(self) -> Column:
        year = F.coalesce(F.when(F.col("year").rlike("^[0-9]+$"), F.col("year").try_cast("bigint")), F.lit(0))
        # journal, quartile, year and impact are known of metadata only, so folders pass them
        told = lambda c: (F.col("source") == "disk") | c
        has = lambda level: F.array_contains("compiled", level)
        status = self.status.lower()
        kinds = {"done": F.size("compiled") > 0, "none": F.size("compiled") == 0, "failed": F.col("error") != "", "l1": has("L1"), "l2": F.col("third_level_next"), "l3": has("L3")}
        out = F.col("score") >= self.score_min
        if self.journal:
            name = self.journal.strip().lower()
            out &= told(F.contains(F.lower("journal"), F.lit(name)) | F.contains(F.lower("journal_override"), F.lit(name)))
        if status in kinds:
            out &= kinds[status]
        if self.quartiles:
            out &= told(F.col("quartile").isin(*self.quartiles))
        if self.year_from:
            out &= told(year >= self.year_from)
        if self.year_to:
            out &= told(year <= self.year_to)
        if self.min_impact:
            out &= told(F.col("impact_factor") >= self.min_impact)
        return out & F.col("on_disk") if self.on_disk_only else out


def of_kind(items: DataFrame, kind: str = "", has_attachment: bool = False) -> DataFrame:
    """'' and all: everything; none: documents without an identifier; else that kind."""
    kind = kind.strip().lower()
    if kind == "none":
        items = items.where(has_no_identifier(F.col("rid")))
    elif kind not in ("", "all"):
        items = items.where(F.coalesce(F.nullif("kind", F.lit("")), F.lit("paper")) == kind)
    return items.where(F.col("attachments") > 0) if has_attachment else items


def without_trash(items: DataFrame, trash: DataFrame) -> DataFrame:
    """Items whose rid and doi are both not among the keys of the bin."""
    keys = trash.select(F.col("key").alias("_key")).distinct()
    return items.join(keys, F.col("rid") == F.col("_key"), "left_anti").join(keys, F.col("doi") == F.col("_key"), "left_anti")


def library_order(sort: str = "value") -> list[Column]:
    """By falling score, by falling year, or by title; unknown names sort by score."""
    year = F.coalesce(F.col("year").try_cast("bigint"), F.lit(0))
    title = F.lower("title")
    return {"year": [F.desc(year), title], "title": [title]}.get(sort, [F.desc("score"), F.desc(year), title]) + [F.col("key")]


def page_of(df: DataFrame, order: list[Column], page: int = 1, size: int = 50) -> DataFrame:
    """A page of 1 to 200 rows; pages count from 1."""
    size = min(MOST_PER_PAGE, max(1, size))
    return df.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)


def newest(papers: DataFrame, offset: int = 0, limit: int = 20, is_reference: bool | None = None) -> DataFrame:
    rows = papers if is_reference is None else papers.where(F.col("is_reference") == is_reference)
    return rows.orderBy(F.desc("imported_at"), "doi").offset(offset).limit(limit)


def store_counts(papers: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts of papers, references, edges, and papers enriched, ranked and with an impact factor."""
    counts = papers.agg(
        F.count(F.lit(1)).alias("total_papers"), F.count_if(~F.col("is_reference")).alias("main_papers"), F.count_if("is_reference").alias("reference_papers"), F.count_if("is_enriched").alias("enriched"),
        F.count_if(F.col("paper_rank") > 0).alias("ranked"), F.count_if(F.col("impact_factor") > 0).alias("with_impact"),
    )
    return counts.crossJoin(edges.agg(F.count(F.lit(1)).alias("citations")))  # one row by one row


def to_enrich(papers: DataFrame, limit: int = 100) -> DataFrame:
    return papers.where("doi <> '' and not is_enriched").orderBy(F.desc("paper_rank"), "doi").limit(limit).select("doi")


def pending(papers: DataFrame, include_non_wos: bool = True, limit: int = 100_000) -> DataFrame:
    """Papers still to be enriched, or to be enriched anew from the most trusted source."""
    open_ = ~F.col("is_enriched") | (~F.col("source_main").ilike("wos%") if include_non_wos else F.lit(False))
    return papers.where((F.col("doi") != "") & open_).orderBy(F.desc("paper_rank"), F.desc("times_cited"), "doi").limit(limit).select("doi")


def all_keys(papers: DataFrame) -> DataFrame:
    return papers.where("doi <> ''").orderBy(F.desc("paper_rank"), F.desc("times_cited"), "doi").select("doi")


def years_between(papers: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Papers of the years asked for, and those whose year is missing."""
    year = strict_year(F.col("year"))
    inside = (year >= first if first is not None else F.lit(True)) & (year <= last if last is not None else F.lit(True))
    return papers.where(year.isNull() | inside)


def kind_chips(items: DataFrame, attachments: DataFrame) -> DataFrame:
    """(place, kind, n): all, the kinds that occur, none (no identifier) if there are any, and has_attachment (documents with any).

    `items` has rid and kind, `attachments` rid and files.
    """
    kind = F.coalesce(F.nullif("kind", F.lit("")), F.lit("paper"))
    kinds = items.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    nth = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    rows = kinds.select(F.when(nth > 0, nth).otherwise(50).cast("bigint").alias("place"), "kind", "n")
    whole = items.agg(F.count(F.lit(1)).alias("n"), F.count_if(has_no_identifier(F.col("rid"))).alias("m"))
    rows = rows.union(whole.select(F.lit(0).cast("bigint"), F.lit("all"), "n")).union(whole.where("m > 0").select(F.lit(98).cast("bigint"), F.lit("none"), "m"))
    return rows.union(attachments.where("files > 0").agg(F.count_distinct("rid").alias("n")).select(F.lit(99).cast("bigint"), F.lit("has_attachment"), "n"))


def library_stats(meta: DataFrame, library: DataFrame, disk: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: how many documents there are, how many have each level's product, the queue's states, and what is missing where."""
    has = lambda level: F.count_if(F.array_contains("levels", level))
    compiled = disk.agg(F.count(F.lit(1)).alias("kb_papers"), *(has(x).alias(f"{x.lower()}_done") for x in LEVELS), F.count_if(~F.array_contains("levels", "L1")).alias("uncompiled"))
    queue = jobs.agg(F.count_if(F.col("status").isin("queued", "pending")).alias("queued"), F.count_if(F.col("status") == "compiling").alias("processing"), F.count_if(F.col("status") == "failed").alias("failed"))
    n = F.count(F.lit(1))
    out = meta.agg(n.alias("meta_count")).crossJoin(library.agg(n.alias("library_papers"))).crossJoin(compiled).crossJoin(queue)  # single rows all
    absent = library.select("key").distinct().join(disk.select("key"), "key", "left_anti").agg(n.alias("not_in_kb"))
    bare = disk.select("key").join(meta.select("key"), "key", "left_anti").agg(n.alias("missing_meta"))
    return out.crossJoin(absent).crossJoin(bare)


def index_health(segments: DataFrame, passages: DataFrame, failures: DataFrame) -> DataFrame:
    """One row: rows in segments, live passages, garbage between them, documents, and failures not resolved yet."""
    rows = segments.agg(F.count(F.lit(1)).alias("segments"), F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("segment_rows"))
    live = passages.agg(F.count(F.lit(1)).alias("live_passages"), F.count_distinct(F.nullif("doi", F.lit(""))).alias("papers"))
    out = rows.crossJoin(live).crossJoin(failures.agg(F.count_if(F.col("resolved") == 0).alias("dead_letters")))  # single rows
    return out.withColumn("garbage_rows", F.greatest(F.lit(0), F.col("segment_rows") - F.col("live_passages")).cast("bigint"))


def passages_per_document(passages: DataFrame) -> DataFrame:
    return passages.where("doi <> ''").groupBy("doi").agg(F.count(F.lit(1)).alias("passages"))


def table_years(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("year").alias("years"))


def by_source(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def learnt(mapping: DataFrame, batch: DataFrame, key: str = "short", value: str = "full", position: str = "position") -> DataFrame:
    """The mapping with what a batch teaches: what is there stays, the first of a batch wins."""
    first = batch.where((F.col(key) != "") & (F.col(value) != "")).groupBy(key).agg(F.min_by(value, position).alias(value))
    return mapping.select(key, value).unionByName(first.join(mapping.select(key), key, "left_anti"))


def with_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    return rows.where(F.startswith(F.col(column), F.lit(prefix)))


def paragraphs(rows: DataFrame, ids: list | None = None, section: str = "", language: str = "en", longest: int = 2000, most: int = 50) -> DataFrame:
    """(idx, para_id, section, text) of the first `most` chosen paragraphs in order, longer ones cut with a mark; language: en, zh or both."""
    for on, c in ((ids, F.col("para_id").isin(*(ids or []))), (section, F.col("section") == section)):
        rows = rows.where(c) if on else rows
    parts = {"en": ["text_en"], "zh": ["text_zh"]}.get(language, ["text_en", "text_zh"])
    text = F.trim(F.concat_ws("\n", *(F.nullif(F.col(p), F.lit("")) for p in parts)))
    cut = F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit("…(截断)"))).otherwise(text)
    return rows.orderBy("idx").limit(most).select("idx", "para_id", "section", cut.alias("text"))


def matching(rows: DataFrame, **wanted) -> DataFrame:
    """Rows equal to every value that is asked for; None and '' ask for nothing."""
    for column, value in wanted.items():
        rows = rows.where(F.col(column) == value) if value not in (None, "") else rows
    return rows


def shared_keys(left: DataFrame, right: DataFrame, key: str = "doi") -> DataFrame:
    """One row: the number of keys on both sides."""
    return left.select(key).distinct().join(right.select(key), key, "left_semi").agg(F.count(F.lit(1)).alias("n"))


def ordered_union(*lists: Column) -> Column:
    """All items of arrays in order, each once."""
    return F.array_distinct(F.concat(*lists))


def key_aliases(key: Column) -> Column:
    """The ways in which a resource key is written: as it is, without doi-, as a directory name, and as the DOI of one."""
    bare = F.when(F.startswith(key, F.lit("doi-")), F.substring(key, 5, 1_000_000))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(key, bare, dirname(key), F.nullif(from_dirname(key), F.lit(""))))))


def list_scores(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.desc("score"), "key")


def third_level(scores: DataFrame, jobs: DataFrame) -> DataFrame:
    """Documents to compile to the third level: score and assessment suffice, and it is not done with its product there."""
    ready = jobs.where("level = 'L3' and status = 'done' and artifact").select("key").distinct()
    return scores.where((F.col("ai") > 0) & (F.col("score") >= THIRD)).join(ready, "key", "left_anti")


def drop_by_alias(rows: DataFrame, gone: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows without those whose key, or any alias of it, is to go."""
    every = gone.select("key").union(gone.join(aliases, "key").select(F.explode("aliases"))).distinct()
    return rows.join(every, "key", "left_anti")


def add_new(index: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """An index with the rows of a batch that it lacks; the least row of a repeated key is taken."""
    return index.unionByName(more.dropDuplicates([key]).join(index.select(key), key, "left_anti"))


def recent_in_order(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The newest n rows of each group, in their own order (nth from 1)."""
    newest_ = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))).where(F.col("_n") <= n)
    return newest_.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(order)).cast("bigint")).drop("_n")


#: Fixed values of the drawn sizes: what each scale adds and its factor.
NODE_SCALES = {"pow06": (1.2, 1.8), "log2": (2.0, 1.5), "sqrt": (1.5, 2.0), "linear": (1.2, 0.5)}


def node_size(cites: Column, base: float = 1.0, scale: str = "pow06") -> Column:
    """The drawn size of a node by its citations, at least 1.2; unknown scales are powers of 0.6."""
    v = F.coalesce(cites.cast("double"), F.lit(0.0))
    shift, factor = NODE_SCALES.get(scale, NODE_SCALES["pow06"])
    grown = {"log2": F.log2(1 + v), "sqrt": F.sqrt(v), "linear": v}.get(scale, F.pow(v, F.lit(0.6)))
    return F.greatest(F.lit(1.2), (shift + grown * factor) * base)


def cluster_papers(papers: DataFrame, cluster: int) -> DataFrame:
    """The papers of a cluster, references left out, highest rank first."""
    return papers.where((F.col("cluster") == cluster) & ~F.col("is_reference")).orderBy(F.desc("paper_rank"), "doi")
