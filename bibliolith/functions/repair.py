"""Repair and checks of mathematics in texts, and the forms in which texts are compared."""

from __future__ import annotations

import re
from unicodedata import normalize

from pyspark.sql import Column
from pyspark.sql import functions as F

MATH_SPAN = r"\$\$[^$]*\$\$|\$[^$]*\$"
BARE_SCRIPT = r"(?<![$\{])([\^_])\{([^}]+)\}(?![$\}])"


def _outside(text: Column, change) -> Column:
    """A text whose parts outside of mathematics went through `change`."""
    spans, gaps = F.regexp_extract_all(text, F.lit(MATH_SPAN), F.lit(0)), F.split(text, MATH_SPAN, -1)
    return F.array_join(F.zip_with(F.transform(gaps, change), spans, lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")


def wrap_bare_scripts(text: Column) -> Column:
    """^{...} and _{...} outside of mathematics put between dollars; applying it twice changes nothing more."""
    return _outside(text, lambda g: F.regexp_replace(g, BARE_SCRIPT, r"\$$1{$2}\$"))


def count_bare_scripts(text: Column) -> Column:
    """How many scripts `wrap_bare_scripts` wraps."""
    return F.aggregate(F.split(text, MATH_SPAN, -1), F.lit(0), lambda n, g: n + F.regexp_count(g, F.lit(BARE_SCRIPT))).cast("bigint")


_SPAN = re.compile(MATH_SPAN)
_LOOKS_MATHEMATICAL = re.compile(r"\\[A-Za-z]|\^\{|_\{|\^\\|_\\")


def _braces(body: str) -> tuple[list[int], int]:
    """Places of closing braces that close nothing, and how many opening ones stay open; escaped ones do not count."""
    open_, surplus = 0, []
    for m in re.finditer(r"\\.|[{}]", body, re.S):
        if m[0] == "{":
            open_ += 1
        elif m[0] == "}" and open_:
            open_ -= 1
        elif m[0] == "}":
            surplus.append(m.start())
    return surplus, open_


def balanced(text: str) -> str:
    """Mathematics with a wrong number of braces mended: surplus closing ones go, missing ones are put at its end. Other text between dollars stays."""

    def mend(m: re.Match) -> str:
        mark = "$$" if m[0].startswith("$$") else "$"
        body = m[0][len(mark) : len(m[0]) - len(mark)]
        surplus, missing = _braces(body)
        if not (surplus or missing) or not _LOOKS_MATHEMATICAL.search(body):
            return m[0]
        return mark + "".join(c for k, c in enumerate(body) if k not in surplus) + "}" * missing + mark

    return _SPAN.sub(mend, text)


def unbalanced(text: str) -> list[str]:
    """The mathematics of a text whose braces do not pair."""
    bodies = (m[0].strip("$") for m in _SPAN.finditer(text))
    return [b for b in bodies if _braces(b) != ([], 0)]


def syntax_errors(text: str, known: frozenset[str] | None = None) -> list[tuple[str, str]]:
    """(kind, detail): unknown commands (if the known ones are given), unpaired dollars, braces and environments."""
    if "$" not in text and "\\" not in text:
        return []
    out = [("unknown_command", m[0]) for m in re.finditer(r"\\([A-Za-z]+)", text) if known is not None and m[1] not in known]
    if len(re.findall(r"(?<!\\)\$", text)) % 2:
        out.append(("unclosed_math", "$"))
    depth = 0
    for c in re.findall("[{}]", text):
        depth += 1 if c == "{" else -1
        if depth < 0:
            out.append(("unmatched_brace", "}"))
            depth = 0
    if depth:
        out.append(("unmatched_brace", "{" * depth))
    stack: list[str] = []
    for kind, name in re.findall(r"\\(begin|end)\{([a-zA-Z*]+)\}", text):
        if kind == "begin":
            stack.append(name)
            continue
        if not stack or stack[-1] != name:
            out.append(("unmatched_env", name))
        if stack:
            stack.pop()
    return out + ([("unmatched_env", stack[-1])] if stack else [])


def _udf(function, kind: str):
    import pandas as pd

    def run(texts):
        return texts.map(lambda t: function(t or ""))

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


def balance_math_braces(text: Column) -> Column:
    return _udf(balanced, "string")(text)


def unbalanced_math(text: Column) -> Column:
    return _udf(unbalanced, "array<string>")(text)


def latex_errors(text: Column, known: frozenset[str] | None = None) -> Column:
    return _udf(lambda t: [f"{kind}: {detail}" for kind, detail in syntax_errors(t, known)], "array<string>")(text)


#: Letters that stand for several.
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st"}
#: Latin letters with marks are decomposed by this table; the marks themselves fall away.
_MARKED = {chr(c): normalize("NFKD", chr(c))[0] for c in range(0xC0, 0x180) if normalize("NFKD", chr(c))[0].isascii()}
_TABLE = _MARKED | {"²": "2", "³": "3", "¹": "1", **{chr(0x2080 + k): str(k) for k in range(10)}, "⁰": "0", **{chr(0x2070 + k): str(k) for k in range(4, 10)}}


def _unwrapped(text: Column) -> Column:
    for mark, letters in LIGATURES.items():
        text = F.replace(text, F.lit(mark), F.lit(letters))
    text = F.regexp_replace(F.translate(text, "\u00ad\ufffd", ""), r"\$", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\\[a-zA-Z]+\s*", ""), r"[{}\\]", "")
    return F.lower(F.translate(text, "".join(_TABLE), "".join(_TABLE.values())))


def normalized(text: Column) -> Column:
    """Letters and digits only, for comparing what two readings say: without mathematics' marks and commands, ligatures and accents undone."""
    return F.regexp_replace(_unwrapped(text), "[^0-9a-z]+", "")


def normalized_words(text: Column) -> Column:
    """The same with single blanks between words; blanks between digits go."""
    spaced = F.trim(F.regexp_replace(_unwrapped(text), "[^0-9a-z]+", " "))
    return F.regexp_replace(spaced, "(?<=[0-9]) (?=[0-9])", "")


def orphan_latex(text: Column) -> Column:
    """Commands with braces outside of mathematics put between dollars."""
    return _outside(text, lambda g: F.regexp_replace(g, r"(\\[A-Za-z]+\{[^{}]*\})", r"\$$1\$"))


def domain_fixes(text: Column, forms: dict[str, str]) -> Column:
    """Whole words replaced by their proper forms (chemical formulae, units), longest first; case counts."""
    for wrong in sorted(forms, key=lambda w: (-len(w), w)):
        text = F.regexp_replace(text, rf"(?<![A-Za-z0-9])\Q{wrong}\E(?![A-Za-z0-9])", re.sub(r"([\\$])", r"\\\1", forms[wrong]))
    return text


def line_kind(text: Column, page: Column, font: Column, median_font: Column) -> Column:
    """meta, caption, heading, title or body, by what a line looks like, in that order of precedence; '' is other."""
    t = F.trim(F.coalesce(text, F.lit("")))
    short = F.length(t) < 200
    capitals = (F.length(t) <= 40) & t.rlike(r"^[A-Z][A-Z\s&-]*$")
    meta = t.rlike(r"[\w.+-]+@[\w-]+\.\w+|orcid\.org|(?i)creative commons|^(?:©|\(c\)|copyright)") | t.rlike(r"(?i)^(?:received|accepted|revised|published|available online|doi|https?://doi)\b")
    meta |= t.rlike(r"(?i)contents lists available at|^journal homepage\s*:|^\d+ of \d+$|^\d{1,2} [A-Z][a-z]+ \d{4}$") | (t.rlike(r"(?i)\b(?:university|institute|department|laborator(?:y|ies)|college|school of)\b") & (F.length(t) < 400) & ~t.rlike(r"[.!?]$")) | capitals
    caption = t.rlike(r"(?i)^(?:fig(?:ure)?|table|scheme)\.?\s*S?\d+\s*[.:|]") | t.rlike(r"^(?i:fig(?:ure)?|table|scheme)\.?\s*S?\d+\s+[A-Z]")
    heading = t.rlike(r"^\d+(?:\.\d+)*\.?\s+[A-Z]") & short & ~t.rlike(r"[.;]$")
    title = (page == 1) & (font >= median_font * 1.35) & (F.length(t) < 300)
    large = (font >= median_font * 1.2) & (F.length(t) < 60)
    return F.when(t == "", "other").when(meta, "meta").when(caption, "caption").when(heading, "heading").when(title, "title").when(large, "heading").otherwise("body")


def spacing_hits(text: Column) -> Column:
    """Words of seven letters or more that begin with a function word and its lost blank, as "ofconductivity"; real words are left out."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z]{7,}"), F.lit(0))
    return F.filter(words, lambda w: F.lower(w).rlike("^of[bcdghjklmnpqrsvwxyz][a-z]{4,}$"))


def math_segments(text: Column) -> Column:
    """The mathematics of a text without blanks."""
    return F.transform(F.regexp_extract_all(text, F.lit(MATH_SPAN), F.lit(0)), lambda s: F.regexp_replace(s, r"[$\s]+", ""))


def headings(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*#{1,6}\s+\S")), lambda x: F.trim(F.regexp_replace(x, r"^\s*#+\s*", "")))


def structure(text: Column) -> dict[str, Column]:
    """Images, publisher's lines in the text, headings that begin in lower case, and whether the abstract comes before the first numbered heading."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    h = headings(text)
    front = F.array_position(F.transform(h, lambda x: F.lower(x).rlike("^(?:abstract|article info|keywords)")), True)
    numbered = F.array_position(F.transform(h, lambda x: x.rlike("^[0-9]")), True)
    noise = lambda x: ~x.rlike("^[#!]") & x.rlike(r"(?i)contents lists available at|^journal homepage\s*[:：]|^available online\b|^\d{2,4}\s*\(\d{4}\)\s+\d{3,6}$")
    return {
        "images": F.size(F.filter(lines, lambda x: x.rlike(r"^!\[[^\]]*\]\([^)]*\)$"))).cast("bigint"), "publisher_noise": F.size(F.filter(lines, noise)).cast("bigint"),
        "suspicious_headings": F.size(F.filter(h, lambda x: x.rlike("^[a-z]"))).cast("bigint"), "abstract_position_ok": (front == 0) | (numbered == 0) | (front < numbered),
    }


def front_matter(text: Column) -> dict[str, Column]:
    """Guesses from the opening of a Markdown text: title, authors, affiliations and keywords ('' or none where nothing looks like them)."""
    lines = F.filter(F.transform(F.split(F.substring(text, 1, 6000), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    title = F.regexp_replace(F.coalesce(F.try_element_at(F.filter(lines, lambda x: x.rlike(r"^#\s+\S")), F.lit(1)), F.lit("")), r"^#\s+", "")
    people = F.filter(lines, lambda x: x.rlike(r"^[A-Z][\w.'-]+(?: [A-Z][\w.'-]*)+(?:, (?:and )?[A-Z][\w.'-]+(?: [A-Z][\w.'-]*)+){1,14}$"))
    names = F.transform(F.split(F.coalesce(F.try_element_at(people, F.lit(1)), F.lit("")), ","), lambda x: F.regexp_replace(F.trim(x), "^and ", ""))
    places = F.filter(lines, lambda x: x.rlike(r"(?i)\b(?:university|institute|department|laborator(?:y|ies)|college)\b") & (F.length(x) < 400) & ~x.rlike(r"[.!?]$"))
    words = F.regexp_extract(text, r"(?im)^\W*key\s?words?\W+(.+)$", 1)
    return {"title": title, "authors": F.filter(names, lambda x: x != ""), "affiliations": places, "keywords": F.filter(F.transform(F.split(words, "[;,]"), lambda x: F.trim(x)), lambda x: x != "")}
