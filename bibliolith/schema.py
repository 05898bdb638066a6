"""Record schemas (DDL, as readers take them), loaders that read missing text as '', and lax casts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAPER = (
    "doi string, title string, abstract string, authors array<string>, journal string, year string, keywords array<string>, times_cited bigint, source_main string, "
    "is_reference boolean, impact_factor double, quartile string, library_citations bigint, paper_rank double, cluster bigint"
)
CITATION = "citing_doi string, cited_doi string, source string, cited_brief string"
JOURNAL_METRIC = "journal_name string, jif double, quartile string, year int, issn string, eissn string"
USAGE = "id bigint, context string, provider string, model string, prompt_tokens bigint, completion_tokens bigint, cache_hit_tokens bigint, cost double, created_at timestamp"
DEAD_LETTER = "id bigint, doi string, op string, error string, tries int, next_try double, created double, resolved int"


def blank_missing(df: DataFrame) -> DataFrame:
    """Text columns with null as '': the stores behind these records have no null text."""
    return df.select(*(F.coalesce(c, F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))


def filled(column: Column | str) -> Column:
    """'' and null as null, for coalesce chains of first non-empty values."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column != "", column)


def lax_int(text: Column) -> Column:
    """The integer a text starts with, 0 if none."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def strict_year(text: Column) -> Column:
    """A four-digit year, null for any other text."""
    return F.when(text.rlike("^[0-9]{4}$"), text.try_cast("bigint"))


def rounded(x: Column, places: int) -> Column:
    """Half-up rounding by floor, the same in every engine that computes in doubles."""
    return F.floor(x * 10**places + 0.5) / float(10**places)
