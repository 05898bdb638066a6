"""Line, JSON, Markdown, spreadsheet and directory sources, and sinks that match them."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines; blank lines and those that begin with # are skipped, lines that do not parse are dropped."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')")
    return lines.select(F.from_json("value", schema).alias("r")).where("r is not null").select("r.*")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_documents(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One nested JSON document per file; unknown fields are ignored."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def directory_listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, length, modified) of files under a path, contents unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def markdown_blocks(files: DataFrame) -> DataFrame:
    """(path, position, section, kind, text, in_references) of Markdown texts (path, text): blocks between blank lines, headings carried forward."""
    blocks = files.select("path", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), r"\n[ \t]*\n+")).alias("position", "raw")).select("path", "position", F.regexp_replace("raw", r"^\s+|\s+$", "").alias("text")).where("text <> ''")
    heading = F.when(F.col("text").rlike(r"^#{1,6}\s"), F.trim(F.regexp_replace(F.substring_index("text", "\n", 1), r"^#{1,6}\s+|\s*#*$", "")))
    w = Window.partitionBy("path").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    section = F.coalesce(F.last(heading, ignorenulls=True).over(w), F.lit(""))
    kind = F.when(heading.isNotNull(), "heading").when(F.col("text").rlike(r"(?i)^(?:\*\*)?(?:fig(?:ure)?|table|scheme)\.?\s*[0-9s]"), "caption").when(F.col("text").rlike(r"^!\["), "image").when(F.col("text").rlike(r"^\|"), "table").otherwise("paragraph")
    zone = F.max(F.coalesce(heading.rlike(r"(?i)^(?:references|bibliography|literature cited)\b"), F.lit(False))).over(w)
    return blocks.select("path", F.col("position").cast("bigint").alias("position"), section.alias("section"), kind.alias("kind"), "text", zone.alias("in_references"))


def cards(files: DataFrame) -> DataFrame:
    """(path, meta, body) of Markdown cards (path, text): the pairs of their front matter, and what follows it."""
    front = F.regexp_extract("text", r"(?s)^\s*---\s*\n(.*?)\n---", 1)
    lines = F.filter(F.split(front, "\n"), lambda line: line.rlike(r"^\s*[A-Za-z_][\w-]*\s*:"))
    keys = F.transform(lines, lambda line: F.lower(F.trim(F.substring_index(line, ":", 1))))
    values = F.transform(lines, lambda line: F.regexp_replace(F.trim(F.regexp_replace(line, "^[^:]*:", "")), r"^[\"'](.*)[\"']$", "$1"))
    pairs = F.map_from_entries(F.array_distinct(F.arrays_zip(keys.alias("k"), values.alias("v"))))
    return files.select("path", pairs.alias("meta"), F.regexp_replace(F.regexp_replace("text", r"(?s)^\s*---\s*\n.*?\n---[ \t]*\n?", ""), r"^\s+|\s+$", "").alias("body"))


_CELL = re.compile(r"([A-Z]+)")
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for c in _CELL.match(ref)[1]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(file) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row, cells) of a workbook, by the standard library alone."""
    with zipfile.ZipFile(file) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet"):
            target = rels[sheet.get(_REL)].lstrip("/")
            for n, row in enumerate(ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_NS}row")):
                cells: list[str] = []
                for c in row.iter(f"{_NS}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (at - len(cells) + 1)
                    v = c.find(f"{_NS}v")
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if c.get("t") == "inlineStr" else shared[int(v.text)] if c.get("t") == "s" and v is not None else (v.text or "") if v is not None else ""
                yield sheet.get("name"), n, cells


#: Header words of the columns of a journal-metric sheet.
HEADERS = {"journal_name": ("journal name", "journal", "name", "title"), "issn": ("issn",), "eissn": ("eissn", "e-issn"), "jif": ("jif", "impact factor", "if"), "quartile": ("quartile", "jif quartile", "q")}


def journal_metrics(file, look: int = 3) -> list[tuple]:
    """(journal_name, jif, quartile, year, issn, eissn) of all sheets; the header is sought in the first rows, the year in the sheet's name."""
    out, header = [], {}
    current = None
    for sheet, n, cells in sheet_rows(file):
        if sheet != current:
            current, header = sheet, {}
        low = [c.strip().lower() for c in cells]
        if not header and n < look:
            found = {k: next((low.index(w) for w in words if w in low), None) for k, words in HEADERS.items()}
            header = found if found["journal_name"] is not None else {}
            continue
        name = header and header["journal_name"] < len(cells) and cells[header["journal_name"]].strip()
        if name:
            get = lambda k: cells[header[k]].strip() if header[k] is not None and header[k] < len(cells) else ""  # noqa: B023, E731
            year = re.search(r"20\d\d", sheet)
            try:
                jif = float(get("jif").replace(",", ""))
            except ValueError:
                jif = 0.0
            out.append((name, jif, get("quartile"), int(year[0]) if year else 0, get("issn"), get("eissn")))
    return out


def read_journal_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Journal-metric workbooks under a path, parsed on the executors."""

    def run(batches):
        import io

        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([r for b in pdf["content"] for r in journal_metrics(io.BytesIO(bytes(b)))], columns=["journal_name", "jif", "quartile", "year", "issn", "eissn"])

    from ..schema import JOURNAL_METRIC

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("content").mapInPandas(run, JOURNAL_METRIC)


def openalex(works: DataFrame) -> DataFrame:
    """Uniform records of fetched works (doi, title, publication_year, cited_by_count, abstract_inverted_index, authorships, primary_location)."""
    from ..functions import text as fn

    return works.select(
        fn.doi(F.coalesce("doi", F.lit(""))).alias("doi"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.col("publication_year").cast("string"), F.lit("")).alias("year"),
        F.coalesce("cited_by_count", F.lit(0)).cast("bigint").alias("times_cited"), F.coalesce(fn.from_inverted_index(F.col("abstract_inverted_index")), F.lit("")).alias("abstract"),
        F.transform("authorships", lambda a: a["author"]["display_name"]).alias("authors"), F.coalesce("primary_location.source.display_name", F.lit("")).alias("journal"),
    )


def crossref(works: DataFrame) -> DataFrame:
    """Uniform records of fetched works (doi, title, container_title, issn: arrays; year: of the first date given; cited_by, abstract, author, type)."""
    from ..functions import text as fn

    nth = lambda c, k: F.coalesce(F.try_element_at(F.col(c), F.lit(k)), F.lit(""))
    full = F.transform("author", lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"])))
    date = F.coalesce(*(F.try_element_at(F.try_element_at(F.col(c), F.lit(1)), F.lit(1)) for c in ("published_print", "published_online", "issued")))
    return works.select(
        fn.doi(F.col("doi")).alias("doi"), F.trim(nth("title", 1)).alias("title"), F.trim(nth("container_title", 1)).alias("journal"), nth("issn", 1).alias("issn"), nth("issn", 2).alias("eissn"),
        F.coalesce(date.cast("string"), F.lit("")).alias("year"), F.coalesce("cited_by", F.lit(0)).cast("bigint").alias("times_cited"), fn.without_tags(F.coalesce("abstract", F.lit(""))).alias("abstract"),
        F.filter(F.coalesce(full, F.array().cast("array<string>")), lambda a: a != "").alias("authors"), F.coalesce("type", F.lit("")).alias("type"), F.lit("crossref").alias("source"),
    )


def semantic_scholar(papers: DataFrame) -> DataFrame:
    """Uniform records of fetched papers (doi, title, abstract, tldr, authors: array of name and affiliations, venue, journal, year, citation_count, paper_id)."""
    people = F.coalesce("authors", F.array().cast("array<struct<name:string,affiliations:array<string>>>"))
    names = F.filter(F.transform(people, lambda a: F.trim(F.coalesce(a["name"], F.lit("")))), lambda n: n != "")
    places = F.flatten(F.transform(people, lambda a: F.coalesce(a["affiliations"], F.array().cast("array<string>"))))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return papers.where(text("title") != "").select(
        text("doi").alias("doi"), F.trim(text("title")).alias("title"), F.substring(text("abstract"), 1, 4000).alias("abstract"), text("tldr").alias("tldr"), names.alias("authors"),
        F.slice(F.array_distinct(F.filter(places, lambda p: p != "")), 1, 12).alias("affiliations"), F.trim(F.coalesce(F.nullif("journal", F.lit("")), text("venue"))).alias("journal"),
        F.coalesce(F.col("year").cast("string"), F.lit("")).alias("year"), F.coalesce("citation_count", F.lit(0)).cast("bigint").alias("times_cited"), F.lit("semantic_scholar").alias("source"), text("paper_id").alias("ss_id"),
    )


LAYOUT_ITEM = "type string, text string, bbox array<double>, page_idx int, text_level int"


def layout_items(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, page, x0, y0, x1, y1, type, text_level, text) of content lists: JSON arrays of layout items, one to a file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", f"array<struct<{LAYOUT_ITEM.replace(' ', ':').replace(',:', ',')}>>").alias("items"))
    each = files.select("path", F.posexplode("items").alias("idx", "i"))
    text, kind = (F.coalesce(F.col(f"i.{c}"), F.lit("")) for c in ("text", "type"))
    corner = lambda k: F.coalesce(F.try_element_at(F.col("i.bbox"), F.lit(k)), F.lit(0.0))
    rows = each.where((text != "") | (kind != ""))
    return rows.select(
        "path", F.col("idx").cast("bigint").alias("idx"), (F.coalesce("i.page_idx", F.lit(0)) + 1).cast("bigint").alias("page"), *(corner(k).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"), 1)),
        kind.alias("type"), F.coalesce("i.text_level", F.lit(0)).alias("text_level"), text.alias("text"),
    )


#: Header words that mark a sheet of zones, and those of its columns.
ZONE_MARKS = ("top", "open access")
ZONE_HEADERS = {"journal_name": ("期刊名称", "journal name", "journal", "name"), "zone": ("分区", "大类分区", "zone"), "top": ("top",), "issn": ("issn",)}


def journal_zones(file, look: int = 3) -> list[tuple]:
    """(journal_name, zone, top, year, issn) of the zone sheets of a workbook; the header is sought in the first rows, the year in the sheet's name."""
    out, header, current = [], {}, None
    for sheet, n, cells in sheet_rows(file):
        if sheet != current:
            current, header = sheet, {}
        low = [c.strip().lower() for c in cells]
        if not header and n < look:
            if any(m in low for m in ZONE_MARKS):
                header = {k: next((i for i, c in enumerate(low) for w in words if c == w or (k == "zone" and c.endswith(w))), None) for k, words in ZONE_HEADERS.items()}
            continue
        get = lambda k: cells[header[k]].strip() if header.get(k) is not None and header[k] < len(cells) else ""  # noqa: B023, E731
        if header and get("journal_name"):
            year, zone = re.search(r"20\d\d", sheet), re.search(r"[1-4]", get("zone"))
            out.append((get("journal_name"), zone[0] if zone else "", get("top"), int(year[0]) if year else 0, get("issn")))
    return out


def import_counts(records: DataFrame, known: DataFrame) -> DataFrame:
    """One row, nothing written: records read, without doi and title, already known, and new, each doi once."""
    usable = (F.col("doi") != "") | (F.col("title") != "")
    tagged = records.join(known.select("doi").where("doi <> ''").distinct().withColumn("_known", F.lit(True)), "doi", "left")
    new = F.count_distinct(F.when(usable & F.col("_known").isNull() & (F.col("doi") != ""), F.col("doi"))) + F.count_if(usable & (F.col("doi") == ""))
    return tagged.agg(F.count(F.lit(1)).alias("records"), F.count_if(~usable).alias("unusable"), F.count_if(F.col("_known")).alias("known"), new.alias("new"))


RULE = "rule_id string, category string, level string, pattern_type string, pattern string, replacement string, confidence double, version int, enabled boolean, hits bigint, evidence array<string>"


def write_rules(rules: DataFrame, path: str, schema_version: int = 1) -> None:
    """Rules as JSON lines with the version of their form."""
    rules.withColumn("schema_version", F.lit(schema_version)).write.mode("overwrite").json(path)


def read_rules(spark: SparkSession, path: str, known: DataFrame, schema_version: int = 1) -> tuple[DataFrame, DataFrame]:
    """(imported, rejected with a reason): rules of another form, without an id, or of an id that exists are not taken; none is overwritten."""
    rows = spark.read.schema(f"{RULE}, schema_version int").json(path)
    taken = rows.join(known.select("rule_id").distinct().withColumn("_known", F.lit(True)), "rule_id", "left")
    reason = F.when(~F.col("schema_version").eqNullSafe(F.lit(schema_version)), "schema").when(F.coalesce("rule_id", F.lit("")) == "", "no id").when(F.col("_known"), "exists")
    told = taken.withColumn("reason", reason).drop("_known")
    return told.where("reason is null").drop("reason", "schema_version"), told.where("reason is not null").select("rule_id", "reason")


def render_markdown(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, markdown) of paragraphs (doc_id, idx, text, level: 0 for text, else of a heading), blank lines between them."""
    line = F.when(F.col("level") > 0, F.concat(F.repeat(F.lit("#"), F.col("level").cast("int")), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    rows = paragraphs.where("text <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", line.alias("t")))).alias("l"))
    return rows.select("doc_id", F.array_join(F.transform("l", lambda x: x["t"]), "\n\n").alias("markdown"))


def diary(activity: DataFrame) -> DataFrame:
    """(day, text): a day of activity (period, kind, n) as lines, kinds in order of name."""
    rows = activity.groupBy(F.to_date("period").alias("day")).agg(F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("k"))
    return rows.select("day", F.concat(F.lit("## "), F.col("day").cast("string"), F.lit("\n"), F.array_join(F.transform("k", lambda x: F.concat(F.lit("- "), x["kind"], F.lit(": "), x["n"].cast("string"))), "\n")).alias("text"))
