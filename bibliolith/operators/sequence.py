"""Operators on ordered rows: cuts, batches, columns and reading order, stitching, anchors, regions, references."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: How closing matter begins. The second list counts in the first half of a text, too, if the paragraph is short.
FIGURE_REFERENCE = r"(?!\s*(?:fig|figure|table|appendix|section|movie|note|scheme|dataset|data set|ref)\b)"
DATA_REFERENCE = r"(?!\s*(?:fig|figure|table|appendix|section|movie)\b)"
CLOSING_STRONG = (
    "references", "bibliography", "literature cited", "works cited", "acknowledg(?:e)?ments?", "conflict of interest", "declarations? of (?:competing|conflicting) interest", "competing interests?",
    "author contributions?", "authors'? contributions?", f"supporting information{FIGURE_REFERENCE}", f"supplementary (?:material|information|data){DATA_REFERENCE}", "associated content",
    "author information", "ethics statement", "this article references",
)
CLOSING = (*CLOSING_STRONG, "credit authorship", "additional information", "funding", r"notes\b", "orcid")
CLOSING_FROM, CLOSING_CHARS = 0.5, 200
REFERENCE_SECTIONS = ("references", "bibliography", "参考文献")


def is_closing(text: Column, idx: Column, total: Column, section: Column, is_heading: Column) -> Column:
    """Does closing matter start here: acknowledgements, declarations, references and the like?

    The text (without heading marks) or the section begins like it, and it is a heading, or stands in the second half of a
    text of more than four paragraphs, or is a short paragraph of the strong kind.
    """
    t, s = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^#+\s*", "")), F.trim(F.coalesce(section, F.lit("")))
    begins = lambda words: t.rlike(rf"(?i)^\s*(?:{'|'.join(words)})") | s.rlike(rf"(?i)^\s*(?:{'|'.join(words)})")
    late = (total > 4) & (idx >= total * CLOSING_FROM)
    return begins(CLOSING) & (is_heading | late | ((F.length(t) <= CLOSING_CHARS) & begins(CLOSING_STRONG)))


def is_references(section: Column) -> Column:
    low = F.lower(F.coalesce(section, F.lit("")))
    return F.contains(low, F.lit(REFERENCE_SECTIONS[0])) | F.contains(low, F.lit(REFERENCE_SECTIONS[1])) | F.contains(low, F.lit(REFERENCE_SECTIONS[2]))


def before_closing(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs (doc_id, idx from 0, text, section, is_heading) before the first closing one, those of reference sections left out."""
    total = paragraphs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_total"))
    marked = paragraphs.join(total, "doc_id").withColumn("_closing", is_closing(F.col("text"), F.col("idx"), F.col("_total"), F.col("section"), F.col("is_heading")))
    cut = marked.where("_closing").groupBy("doc_id").agg(F.min("idx").alias("_cut"))
    kept = marked.join(cut, "doc_id", "left").where(F.col("_cut").isNull() | (F.col("idx") < F.col("_cut")))
    return kept.where(~(is_references(F.col("section")) | (F.col("is_heading") & is_references(F.col("text"))))).select(*paragraphs.columns)


def batches(rows: DataFrame, group: str, order: str, size: str, most_rows: int, most_size: int) -> DataFrame:
    """(group, order, batch): rows in order, a new batch where one more would make it too many or too large; a larger row has its own."""
    import pandas as pd

    def run(batches_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches_:
            out = []
            for key, orders, sizes in zip(pdf[group], pdf["_o"], pdf["_s"], strict=True):
                nth, n, held = 0, 0, 0
                for o, s in zip(orders, sizes, strict=True):
                    if n and (n >= most_rows or held + s > most_size):
                        nth, n, held = nth + 1, 0, 0
                    n, held = n + 1, held + s
                    out.append((key, o, nth))
            yield pd.DataFrame(out, columns=[group, order, "batch"])

    kinds = dict(rows.dtypes)
    items = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).alias("s")))).alias("i"))
    lists = items.select(group, F.transform("i", lambda x: x["o"]).alias("_o"), F.transform("i", lambda x: x["s"]).alias("_s"))
    return lists.mapInPandas(run, f"`{group}` {kinds[group]}, `{order}` {kinds[order]}, batch long")


#: Fixed values of page layout, as parts of a page: header, footer, the gap between columns; and what counts as short.
HEADER, FOOTER, GAP, SHORT, FEW_ROWS = 0.08, 0.955, 0.12, 120, 6


def is_page_furniture(text: Column, y0: Column, y1: Column, height: Column, page: Column) -> Column:
    """Page numbers at the bottom of any page; short text at the top or bottom of all but the first."""
    t = F.trim(F.coalesce(text, F.lit("")))
    bottom = y1 > height * FOOTER
    edge = (page != 1) & (F.length(t) < SHORT) & ((y0 < height * HEADER) | bottom)
    return (t != "") & ((t.rlike("^[0-9]+$") & bottom) | edge)


def page_columns(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, columns, threshold) of blocks (doc_id, page, block, x0, y0, x1, y1, width: that of the page).

    Narrow blocks, under half of the page, tell: with six or more of them, the widest gap between their centres makes two
    columns if it is more than 12 % of the page; the threshold is its middle.
    """
    narrow = blocks.where(F.col("x1") - F.col("x0") < F.col("width") * 0.5).withColumn("c", (F.col("x0") + F.col("x1")) / 2)
    w = Window.partitionBy("doc_id", "page").orderBy("c", "block")
    gaps = narrow.withColumn("next", F.lead("c").over(w)).withColumn("gap", F.col("next") - F.col("c"))
    widest = F.max_by(F.struct("gap", ((F.col("c") + F.col("next")) / 2).alias("middle")), F.struct("gap", -F.col("c")))
    found = gaps.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"), F.max("width").alias("width"), widest.alias("g"))
    two = (F.col("n") >= FEW_ROWS) & (F.col("g.gap") > F.col("width") * GAP)
    pages = blocks.select("doc_id", "page").distinct().join(found, ["doc_id", "page"], "left")
    return pages.select("doc_id", "page", F.when(two, 2).otherwise(1).cast("bigint").alias("columns"), F.when(two, F.col("g.middle")).alias("threshold"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """`blocks` with nth, their place in the document: page, column, top, left; wide blocks come before the first narrow one below them.

    A document has two columns if at least half of its pages do; columns are told by left edges.
    """
    columns = page_columns(blocks)
    share = columns.groupBy("doc_id").agg((F.count_if(F.col("columns") == 2) >= F.greatest(F.lit(1.0), F.count(F.lit(1)) * 0.5)).alias("_two"))
    placed = blocks.join(columns.select("doc_id", "page", "threshold"), ["doc_id", "page"]).join(share, "doc_id")
    column = F.when(F.col("_two") & F.col("threshold").isNotNull() & (F.col("x0") >= F.col("threshold")), 1).otherwise(0)
    placed = placed.withColumn("_wide", F.col("x1") - F.col("x0") >= F.col("width") * 0.5).withColumn("_column", column)
    narrow = placed.where("not _wide").withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("_column", "y0", "x0", "block")))
    below = narrow.select("doc_id", "page", F.col("y0").alias("_y"), F.col("_n").alias("_m"))
    wide = placed.where("_wide").join(below, ["doc_id", "page"], "left").groupBy(*blocks.columns).agg(F.min(F.when(F.col("_y") > F.col("y0"), F.col("_m"))).alias("_n"))
    last = F.lit(1 << 30)
    rows = narrow.select(*blocks.columns, F.col("_n").alias("_k"), F.lit(1).alias("_narrow")).unionByName(wide.select(*blocks.columns, F.coalesce("_n", last).alias("_k"), F.lit(0).alias("_narrow")))
    w = Window.partitionBy("doc_id").orderBy("page", "_k", "_narrow", "y0", "x0", "block")
    return rows.withColumn("nth", (F.row_number().over(w) - 1).cast("bigint")).drop("_k", "_narrow")


def stitched(paragraphs: DataFrame, group: str = "doc_id", order: str = "idx", text: str = "text") -> DataFrame:
    """(group, first, n, text): paragraphs joined with those that go on from them: the last has no end mark and the next starts in lower case.

    A hyphen at the seam goes when a letter is on both sides. Runs are told by counting the breaks before each row.
    """
    w = Window.partitionBy(group).orderBy(order)
    before = F.lag(text).over(w)
    goes_on = ~before.rlike(r"[.!?:;。！？][\"')\]]*\s*$") & F.col(text).rlike(r"^\s*[a-z]")
    runs = paragraphs.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = runs.groupBy(group, "_run").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: F.trim(x[text])), " ").alias("text"))
    return joined.select(group, "first", "n", F.regexp_replace("text", r"(?<=[A-Za-z])- (?=[a-z])", "").alias("text"))


def regions(path: DataFrame) -> DataFrame:
    """(id, first, kind, left_from, left_to, right_from, right_to): runs of steps of an alignment that match nothing.

    path: id, step, i, j, of which one is null where a side is skipped. kind: shift if both sides skip within the run, extra if
    only the left has rows, missing if only the right.
    """
    w = Window.partitionBy("id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    matched = F.col("i").isNotNull() & F.col("j").isNotNull()
    islands = path.withColumn("_m", matched).withColumn("_run", F.sum(F.when(matched, 1).otherwise(0)).over(w)).where("not _m")
    kind = F.when(F.min("i").isNotNull() & F.min("j").isNotNull(), "shift").when(F.min("i").isNotNull(), "extra").otherwise("missing")
    ends = [F.min("i").alias("left_from"), F.max("i").alias("left_to"), F.min("j").alias("right_from"), F.max("j").alias("right_to")]
    return islands.groupBy("id", "_run").agg(F.min("step").alias("first"), kind.alias("kind"), *ends).drop("_run")


#: Lines of publishers that are no part of a reference.
BOILERPLATE = ("wiley-vch", "downloaded from", "www.advancedsciencenews")


def references(blocks: DataFrame) -> DataFrame:
    """(doc_id, number, text): the references of blocks (doc_id, nth, text) of a reference zone, split at [n]; pieces run on over blocks."""
    low = F.lower("text")
    kept = blocks.where((F.trim("text") != "") & ~(F.contains(low, F.lit(BOILERPLATE[0])) | F.contains(low, F.lit(BOILERPLATE[1])) | F.contains(low, F.lit(BOILERPLATE[2]))))
    whole = kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: F.trim(x["text"])), " ").alias("t"))
    parts = whole.select("doc_id", F.explode(F.split("t", r"(?=\[[0-9]+\])")).alias("p")).select("doc_id", F.trim("p").alias("text")).where(F.col("text").rlike(r"^\[[0-9]+\]"))
    return parts.select("doc_id", F.regexp_extract("text", r"^\[([0-9]+)\]", 1).try_cast("bigint").alias("number"), "text")


def head_and_tail(rows: DataFrame, order: list[str], value: str, share: int = 10) -> DataFrame:
    """One row: the mean of the first and of the last tenth of rows in order, and the drift from one to the other."""
    from .ledger import numbered

    n = rows.count()
    size = max(1, n // share)
    placed = numbered(rows, order, "_rn")
    means = placed.agg(F.avg(F.when(F.col("_rn") <= size, F.col(value))).alias("head"), F.avg(F.when(F.col("_rn") > n - size, F.col(value))).alias("tail"))
    return means.withColumn("drift", F.when(F.col("head") != 0, F.col("tail") / F.col("head")))


_WORDS = re.compile(r"[a-z][a-z'-]*|[\u4e00-\u9fff]")


def _agreement(a: list[str], b: list[str]) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _dice(a: str, b: str) -> float:
    x, y = set(_WORDS.findall(a)), set(_WORDS.findall(b))
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else float(a == b and not (x or y))


def _anchored(paragraphs: list[str], lines: list[str]) -> list[tuple[int, int, int, float]]:
    """Line ranges of paragraphs, one behind the other: see `anchor`."""
    split = [x.split() for x in lines]
    found, at = [], 0
    for k, text in enumerate(paragraphs):
        words = text.split()
        if len(words) < 4:
            continue
        first = next((i for i in range(at, len(lines)) if _agreement(split[i], words[:8]) >= 3), None)
        if first is None:
            continue
        reach = range(first, min(first + 80, len(lines)))
        last = next((i for i in reach if max((_agreement(split[i][s:], words[-8:]) for s in range(len(split[i]))), default=0) >= 3), None)
        need = 0.45
        if last is None:  # no line holds the end: lines are added as long as they help
            need, last, held, best, idle = 0.5, first, lines[first], _dice(text, lines[first]), 0
            for i in reach[1:]:
                now = _dice(text, f"{held} {lines[i]}")
                if now >= best - 0.005:
                    held, best, last, idle = f"{held} {lines[i]}", now, i, 0
                elif idle:
                    break
                else:
                    idle = 1
        score = _dice(text, " ".join(lines[first : last + 1]))
        if score >= need:
            found.append((k, first, last, score))
            at = last + 1
    return found


def anchor(pairs: DataFrame) -> DataFrame:
    """(id, paragraph, first_line, last_line, score): where paragraphs stand among the lines of a page text (id, paragraphs, lines).

    A paragraph starts at the first line, behind the last paragraph found, that begins with three of its first eight words in
    order; it ends at the next line that holds three of its last eight. Ranges whose words differ too much are dropped.
    """
    import pandas as pd

    def run(batches_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches_:
            rows = [(key, *r) for key, p, x in zip(pdf["id"], pdf["paragraphs"], pdf["lines"], strict=True) for r in _anchored(list(p), list(x))]
            yield pd.DataFrame(rows, columns=["id", "paragraph", "first_line", "last_line", "score"])

    clean = lambda c: F.transform(c, lambda t: F.trim(F.regexp_replace(F.lower(t), r"\s+", " ")))
    rows = pairs.select("id", clean("paragraphs").alias("paragraphs"), clean("lines").alias("lines"))
    return rows.mapInPandas(run, f"id {dict(pairs.dtypes)['id']}, paragraph long, first_line long, last_line long, score double")


def covered(ranges: DataFrame, others: DataFrame, bucket: int = 64) -> DataFrame:
    """(id, paragraph, others): the ranges of `others` (id, name, first_line, last_line) that each range overlaps, where there is more than one.

    Both sides are dealt to buckets of lines, so only ranges near each other meet.
    """
    dealt = lambda df: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col("first_line") / bucket), F.floor(F.col("last_line") / bucket))))
    a, b = dealt(ranges).alias("a"), dealt(others).alias("b")
    meet = (F.col("a.id") == F.col("b.id")) & (F.col("a._b") == F.col("b._b")) & (F.col("a.first_line") <= F.col("b.last_line")) & (F.col("b.first_line") <= F.col("a.last_line"))
    return a.join(b, meet).groupBy("a.id", "a.paragraph").agg(F.array_sort(F.collect_set("b.name")).alias("others")).where(F.size("others") > 1)
