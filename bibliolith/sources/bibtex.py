"""BibTeX files as a DataFrame."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn

_ENTRY = re.compile(r"@\s*([A-Za-z]+)\s*[{(]")
_NAME = re.compile(r"\s*([A-Za-z][\w-]*)\s*=\s*")
_SPACE = re.compile(r"\s+")
SKIPPED = frozenset(("comment", "preamble", "string"))


def _value(source: str, at: int, escapes: bool) -> tuple[str, int]:
    """A braced, quoted or bare value that begins at `at`, and where it ends."""
    if at >= len(source):
        return "", at
    if source[at] not in '{"':
        m = re.compile(r"[^,}\s]*").match(source, at)
        return m[0], m.end()
    quoted, depth, start, at = source[at] == '"', 0, at + 1, at + 1
    while at < len(source):
        c = source[at]
        if escapes and c == "\\":
            at += 2
            continue
        if c == "{":
            depth += 1
        elif c == "}" and (depth or not quoted):
            if not depth:
                break
            depth -= 1
        elif c == '"' and quoted and not depth:
            break
        at += 1
    return source[start:at], at + 1


def parse(source: str, escapes: bool = True) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(type, key, fields) of each entry; broken entries give the fields read so far. `escapes` keeps an escaped brace from counting."""
    at = 0
    while m := _ENTRY.search(source, at):
        kind, at = m[1].lower(), m.end()
        if kind in SKIPPED:
            _, at = _value(source, m.end() - 1, escapes) if source[m.end() - 1] == "{" else ("", at)
            continue
        comma = re.compile(r"[^,{}]*").match(source, at)
        key, at = comma[0].strip(), comma.end()
        fields: dict[str, str] = {}
        while at < len(source) and source[at] not in "})":
            if source[at] in ", \t\r\n":
                at += 1
                continue
            name = _NAME.match(source, at)
            if not name:
                at = next((k for k in (source.find(",", at), source.find("}", at)) if k >= 0), len(source))
                if at < len(source) and source[at] == ",":
                    at += 1
                continue
            value, at = _value(source, name.end(), escapes)
            fields.setdefault(name[1].lower(), _SPACE.sub(" ", value).strip())
        yield kind, key, fields
        at += 1


def read_bibtex(spark: SparkSession, path: str, escapes: bool = True) -> DataFrame:
    """(file, position, type, key, fields) of every entry under a path. Files are read whole, one row each, and parsed on the executors."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(f, i, *e) for f, b in zip(pdf["path"], pdf["content"], strict=True) for i, e in enumerate(parse(bytes(b).decode("utf-8", "replace"), escapes))]
            yield pd.DataFrame(rows, columns=["file", "position", "type", "key", "fields"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bib").load(path)
    return files.select("path", "content").mapInPandas(run, "file string, position long, type string, key string, fields map<string,string>")


def papers(entries: DataFrame) -> DataFrame:
    """Bibliographic records of parsed entries; those with neither doi nor title are left out."""
    f = lambda n: F.coalesce(F.try_element_at("fields", F.lit(n)), F.lit(""))
    split = lambda c: F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")
    rows = entries.select(
        "file", "position", fn.first_doi(f("doi")).alias("doi"), F.regexp_replace(f("title"), "[{}]", "").alias("title"), f("abstract").alias("abstract"), fn.authors(f("author")).alias("authors"), f("journal").alias("journal"),
        f("year").alias("year"), split(f("keywords")).alias("keywords"), F.coalesce(F.regexp_extract(f("times-cited"), "([0-9]+)", 1).try_cast("bigint"), F.lit(0).cast("bigint")).alias("times_cited"),
        F.filter(F.split(f("cited-references"), r"(?<=\.)\s+(?=[A-Z])"), lambda r: r != "").alias("references"),
    )
    return rows.where("doi <> '' or title <> ''")


def reference_edges(rows: DataFrame) -> DataFrame:
    """(citing, cited, brief): an edge for every cited reference that names a DOI, once per pair."""
    refs = rows.where("doi <> ''").select(F.col("doi").alias("citing"), F.explode("references").alias("brief"))
    return refs.select("citing", fn.first_doi(F.regexp_replace("brief", r"(?i)^.*?\bdoi\b[:\s]*", "")).alias("cited"), "brief").where("cited <> '' and cited <> citing").dropDuplicates(["citing", "cited"])


def reference_stubs(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Cited papers that are not among the records: (doi, title = the least brief, is_reference)."""
    return edges.groupBy(F.col("cited").alias("doi")).agg(F.min("brief").alias("title")).join(rows.select("doi"), "doi", "left_anti").withColumn("is_reference", F.lit(True))
