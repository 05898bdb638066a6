"""Scalar normalisers as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Latin letters with marks and what remains of them.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def unaccented(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def doi(c: Column) -> Column:
    """Lower case, without URL or doi: in front and dots behind."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", ""), r"\.+$", "")


def is_doi(c: Column) -> Column:
    return c.rlike(r"^10\.[0-9]{4,9}/\S+$")


def first_doi(c: Column) -> Column:
    """The first DOI in a text, without brackets and stops behind."""
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(c, r"[\[\]{}]", ""), r"(10\.[0-9]{4,9}/[^\s,;\"<>]+)", 1), r"[.)]+$", "")


def dirname(c: Column) -> Column:
    """A directory name that tells identifiers apart.

    Where there is a separator, _ is doubled, / becomes _ and : becomes ~. Any other character outside names becomes a dash;
    an identifier that holds one is told from others by six hex digits of its MD5 behind two dashes.
    """
    raw = F.trim(c)
    doubled = F.replace(F.replace(F.replace(raw, F.lit("_"), F.lit("__")), F.lit("/"), F.lit("_")), F.lit(":"), F.lit("~"))
    name = F.regexp_replace(F.when(raw.rlike("[/:]"), doubled).otherwise(raw), r"(?U)[^\w.~-]", "-")
    told = F.when(raw.rlike("[^A-Za-z0-9._/:-]"), F.concat(F.substring(name, 1, 110), F.lit("--"), F.substring(F.md5(raw.cast("binary")), 1, 6))).otherwise(name)
    return F.when(told == "", "paper").otherwise(F.substring(told, 1, 120))


def from_dirname(c: Column) -> Column:
    """The DOI that a directory name stands for; '' for names with a hash, reserved names and what is no DOI."""
    plain = F.replace(F.regexp_replace(F.replace(c, F.lit("~"), F.lit(":")), "(?<!_)_(?!_)", "/"), F.lit("__"), F.lit("_"))
    return F.when(is_doi(plain) & ~F.startswith(c, F.lit("_")) & ~c.rlike("--[0-9a-f]{6}$"), plain).otherwise("")


def plain_doi(c: Column) -> Column:
    """Blanks and quotes around it gone, its case kept; null as ''."""
    return F.coalesce(F.regexp_replace(F.trim(c), "^[\"']+|[\"']+$", ""), F.lit(""))


def doi_in_text(c: Column) -> Column:
    """The first DOI of a text, the punctuation behind it dropped; '' if there is none."""
    return plain_doi(F.regexp_replace(F.regexp_extract(c, r"\b(10\.[0-9]{4,9}/[^\s,;()]+)", 1), r"[.,;:()!?\"']+$", ""))


#: How resource keys of parts and special kinds begin.
KIND_PREFIXES = {"si": "si__", "review": "review__", "note": "note__", "thesis": "thesis__", "book": "book__", "chapter": "chapter__", "patent": "patent__", "standard": "std__"}


def _safe(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(c), "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")


def resource_key(kind: Column, doi: Column, isbn: Column, cnki: Column, cstr: Column, arxiv: Column, report: Column, fingerprint: Column, parent: Column) -> Column:
    """The key of a resource: by its parent for parts, else by the first identifier it has, else by a fingerprint of its content."""
    k = F.lower(F.trim(F.coalesce(kind, F.lit("paper"))))
    prefix = F.lit("")
    for name, begin in KIND_PREFIXES.items():
        prefix = F.when(k == name, begin).otherwise(prefix)
    d = plain_doi(doi)
    named = [F.when(is_doi(d), F.concat(F.lit("doi-"), dirname(d)))]
    named += [F.when(c != "", F.concat(F.lit(f"{n}-"), _safe(c))) for n, c in (("isbn", isbn), ("cnki", cnki), ("cstr", cstr), ("arxiv", arxiv), ("rep", report))]
    named.append(F.when(fingerprint != "", F.concat(F.lit("nd-"), F.substring(F.lower(_safe(fingerprint)), 1, 12))))
    own = F.regexp_replace(F.substring(F.concat(prefix, F.coalesce(*named, F.lit("nd-untitled"))), 1, 150), "^[-_]+|[-_]+$", "")
    return F.when((prefix != "") & (parent != ""), F.substring(F.concat(prefix, parent), 1, 150)).when(own == "", "nd-untitled").otherwise(own)


def has_no_identifier(key: Column) -> Column:
    """Keys made from content: nd-... or the MD5 names of older stores."""
    return F.startswith(F.trim(key), F.lit("nd-")) | F.trim(key).rlike("^[0-9A-Fa-f]{32}$")


def slug(c: Column, longest: int = 80) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "unknown").otherwise(F.substring(s, 1, longest))


def title_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(unaccented(c)), "[^a-z0-9\u4e00-\u9fff\\s]", ""), r"\s+", " "))


def journal_key(c: Column) -> Column:
    """Upper case, & as AND, white space and punctuation dropped; letters of every script stay."""
    return F.regexp_replace(F.replace(F.upper(c), F.lit("&"), F.lit(" AND ")), r"(?U)[\s_.,;:'\"()/-]+", "")


#: Places that metric tables put behind a name to tell journals apart.
JOURNAL_PLACES = (
    "BASEL", "AMSTERDAM", "LONDON", "OXFORD", "BERLIN", "NEW YORK", "PARIS", "TOKYO", "SINGAPORE", "DORDRECHT", "HOBOKEN", "HOBOKEN NJ", "CHICHESTER", "WEINHEIM", "BRISTOL",
    "CAMBRIDGE", "BEIJING", "HACKENSACK", "BINGHAMTON", "THOUSAND OAKS", "LOS ANGELES", "WASHINGTON",
)


def loose_journal_key(c: Column) -> Column:
    """The key without a place behind the name; the same as `journal_key` for names without one."""
    return journal_key(F.regexp_replace(F.upper(c), rf"[- ](?:{'|'.join(JOURNAL_PLACES)})$", ""))


def concept(c: Column) -> Column:
    """Lower case without qualifiers in brackets; punctuation but the slash as blanks."""
    bare = F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", " "), r"(?U)[^\w\s/]", " ")
    return F.lower(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")))


def surname(author: Column) -> Column:
    """Lower case, the part before a comma, else the last word."""
    return F.lower(F.when(F.contains(author, F.lit(",")), F.trim(F.substring_index(author, ",", 1))).otherwise(F.substring_index(F.trim(author), " ", -1)))


def initials(author: Column) -> Column:
    """Capital initials of the given names; a run of capitals counts as initials already. '' for a single word."""
    name = F.trim(author)
    given = F.when(F.contains(name, F.lit(",")), F.regexp_replace(name, "^[^,]*,", "")).when(name.rlike(r"\s"), F.regexp_replace(name, r"\s+\S+$", "")).otherwise("")
    words = F.regexp_extract_all(given, F.lit("[A-Za-z]+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike("^[A-Z]{2,}$"), w).otherwise(F.upper(F.substring(w, 1, 1)))), "")


def authors(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\s+and\s+"), lambda a: F.trim(a)), lambda a: a != "")


def lax_number(c: Column) -> Column:
    """'<0.1', '-' and the like as 0, separators of thousands dropped."""
    return F.coalesce(F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0))


def lax_whole(c: Column) -> Column:
    """The same cut to a whole number."""
    return lax_number(c).cast("bigint")


def without_tags(c: Column, longest: int = 4000) -> Column:
    plain = F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))
    return F.substring(F.regexp_replace(plain, r"^(?i)abstract[:.\s]*", ""), 1, longest)


def from_inverted_index(index: Column) -> Column:
    """A text from a map of words to positions."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 2)).cast("bigint")


def script_tags_to_tex(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?i)<sub>([^<]*)</sub>", r"\$_{$1}\$"), r"(?i)<sup>([^<]*)</sup>", r"\$^{$1}\$")


def citation_superscripts(c: Column) -> Column:
    """$^{1,2}$ of digits, commas and dashes as [1,2]; applying it twice changes nothing more."""
    return F.regexp_replace(c, r"\$\s*\^\s*\{\s*([0-9][0-9,\s–-]*?)\s*\}\s*\$", "[$1]")


def without_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def latex_flags(c: Column) -> Column:
    """What is wrong with the mathematics of a text: an odd number of dollars, braces that do not pair up in number, environments likewise."""
    n = lambda p: F.regexp_count(c, F.lit(p))
    return F.array_compact(
        F.array(
            F.when(n(r"(?<!\\)\$") % 2 == 1, "odd_dollar"), F.when(n(r"(?<!\\)\{") != n(r"(?<!\\)\}"), "braces"), F.when(n(r"\\begin\{") != n(r"\\end\{"), "environments"),
        )
    )


def block_flags(c: Column) -> Column:
    """Signs of a broken paragraph: under eight words, no end mark, a lower-case start."""
    return F.array_compact(F.array(F.when(F.regexp_count(c, F.lit(r"\S+")) < 8, "short"), F.when(~c.rlike(r"[.!?:;。！？][\"')\]]*\s*$"), "open_end"), F.when(c.rlike(r"^\s*[a-z]"), "lower_start")))


#: Function words that a lost blank hides inside a word.
HIDDEN_WORDS = ("and", "the", "for", "with", "in", "on", "to", "by", "at", "from", "into", "onto", "upon", "through", "between", "within", "without")


def joined_words(c: Column) -> Column:
    """Distinct lower-case words of six letters or more whose first occurrence of some function word has two letters on either side."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{6,}"), F.lit(0)))
    inside = lambda w: reduce(lambda a, b: a | b, (F.instr(w, s).between(3, F.length(w) - len(s) - 1) for s in HIDDEN_WORDS))
    return F.filter(words, inside)


#: Signs of misread text, and how much of it is shown around one.
ANOMALY_PATTERNS = ("\ufffd", r"[\\]?Nu\s*_\s*\{?\s*2\s*\}?")
ANOMALY_CONTEXT, MOST_ANOMALIES = 60, 50


def anomalies(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, para, anomaly, sentence): the first match of each pattern in each paragraph with its context, the first 50 of a document.

    `paragraphs` has doc_id, para (its place), text and is_heading; headings are not looked at.
    """
    found = F.array_compact(
        F.array(
            *(
                F.when(F.col("text").rlike(p), F.struct(F.lit(k).alias("nth"), F.lit(p).alias("anomaly"), F.regexp_instr("text", F.lit(p)).alias("at"), F.length(F.regexp_extract("text", p, 0)).alias("n")))
                for k, p in enumerate(ANOMALY_PATTERNS)
            )
        )
    )
    each = paragraphs.where(~F.col("is_heading")).select("doc_id", "para", "text", F.explode(found).alias("f"))
    start = F.greatest(F.col("f.at") - ANOMALY_CONTEXT, F.lit(1))
    sentence = F.trim(F.col("text").substr(start, F.col("f.at") + F.col("f.n") + ANOMALY_CONTEXT - start))
    w = Window.partitionBy("doc_id").orderBy("para", "f.nth")
    return each.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= MOST_ANOMALIES).select("doc_id", "para", "f.anomaly", sentence.alias("sentence"))


def known_fixes(c: Column, fixes: list[tuple[str, str]]) -> Column:
    """Confirmed replacements (pattern, literal text) in order."""
    for pattern, text in fixes:
        c = F.regexp_replace(c, pattern, re.sub(r"([\\$])", r"\\\1", text))
    return c


#: Words that say nothing in a query.
STOP_WORDS = tuple(
    "the a an of to in on for and or with is are was were be this that these those what how why does do did can could about from by at as it its their our your we you they not no than "
    "then so if has have had paper article study work research please".split()
)


def query_words(c: Column) -> Column:
    """English words of two letters or more that are no stop words, then the CJK characters, each in order."""
    return F.concat(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{2,}"), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS)), F.regexp_extract_all(c, F.lit("[\u4e00-\u9fff]"), F.lit(0)))


def passage(title: Column, authors: Column, journal: Column, year: Column, abstract: Column) -> Column:
    """The text of a record for reranking: its non-empty parts, three authors, 500 characters of the abstract."""
    parts = (title, F.array_join(F.slice(authors, 1, 3), " "), journal, year, F.substring(abstract, 1, 500))
    return F.concat_ws(" | ", *(F.when(p != "", p) for p in parts))


def text_to_embed(title: Column, abstract: Column) -> Column:
    return F.when(F.coalesce(abstract, F.lit("")) != "", F.concat(title, F.lit(". "), abstract)).otherwise(title)


def embed_prefix(*parts: Column) -> Column:
    """[title | label | section] and a line break, of the parts that are not blank."""
    joined = F.concat_ws(" | ", *(F.when(F.trim(p) != "", F.trim(p)) for p in parts))
    return F.when(joined == "", "").otherwise(F.concat(F.lit("["), joined, F.lit("]\n")))


def without_frontmatter(c: Column) -> Column:
    """Without YAML between a first line of --- and the next one; unclosed front matter stays."""
    return F.regexp_replace(c, r"^---\r?\n(?s:.*?)\r?\n---\r?\n?", "")
