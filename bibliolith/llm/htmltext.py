"""Main text of web pages by equivalence-class template deduction.

Pages of one host come from few templates. A token is the path of a container element, or of an inline element in it; its occurrence vector over the
host's pages is summed up in a fingerprint (counts times page hashes, a sum that can be pre-aggregated, so a host's
vectors need no place that grows with its pages). Tokens of one fingerprint form an equivalence class; classes with
several tokens on enough pages make up the template, nested by their paths. The slots of the template whose text never
changes, is links only, or (outside articles) is one of few that take turns, such as adverts and notices, are furniture; what remains are data slots. Texts at a path are tokens, too: one whose occurrence vector is that of a class
belongs to the template, though other texts at its path change. Elements that HTML itself or their names mark as furniture
are left out on every host. The template decides on every page, inside articles and outside; a
marked article is only preferred where no data slot has text.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")

#: Elements of HTML by what they mean for text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template iframe svg select".split())
FURNITURE = frozenset("nav footer aside form head button dialog menu label fieldset audio video canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend "
    "li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Classes, ids and roles that name furniture, as whole names.
NAMES = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disclaimer disqus footer gdpr "
    "header masthead menu modal navbar navigation nav newsletter notice notices notification pagination popup promo promoted promotion related respond share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: What a class needs: tokens, pages, and the part of the host's pages.
LEAST_TOKENS, LEAST_PAGES, LEAST_SHARE = 2, 3, 0.3
#: The part of the host's pages that a text of the template must be on, so that a few copies of a page make none.
TEXT_SHARE = 0.5
#: The part of a slot's texts that other pages show, too, and how often each is shown on average, from which on it is furniture.
SHARED_TEXTS, TURNS = 0.8, 4
#: Longer paths are named by a hash of the whole path.
LONGEST_PATH = 240
#: Marks a path of texts that take turns, which is furniture outside articles only.
_TURNING = "\r"
#: Marks an inline element of a path: a token of classes, but no slot.
_INLINE = "\x1f"
_CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


class _Element:
    __slots__ = ("articles", "link", "named", "out", "path", "tag")

    def __init__(self, tag: str, path: str, out: bool, named: tuple[int, ...], articles: tuple[tuple[int, tuple[int, ...]], ...], link: bool):
        self.tag, self.path, self.out, self.named, self.articles, self.link = tag, path, out, named, articles, link


def _marked(tag: str, attributes: str, article: bool) -> tuple[bool, bool, str]:
    """Is the element furniture by its kind, is it by its name, and its label in paths."""
    names = " ".join(a or b or c for _, a, b, c in _ATTRIBUTE.findall(attributes)).lower().split() if attributes else []
    out = tag in FURNITURE or (tag == "header" and not article)
    known = NAMES.intersection(names)
    named = bool(known - {"header"} if tag in ("article", "p") else known) and tag not in HEADINGS and tag not in ("html", "body", "main")
    return out, named, f"{tag}.{names[0]}" if names else tag


def blocks(page: str, names: bool = True) -> list[tuple[str, str, bool, bool, tuple[str, ...], bool]]:
    """(path, text, inside an article, inside furniture, inline elements in it, a link's text) of every block of text, in page order. Without `names` no name makes furniture.

    A name makes no furniture of an element that holds the article (of several the one with most text) or more than half of the page's text.
    """
    found = list(_blocks(page))
    held: Counter[int] = Counter()
    articles: Counter[tuple[int, tuple[int, ...]]] = Counter()
    total = 0
    for _, text, within, out, named, _, _ in found:
        if not out:
            total += len(text)
            held.update(dict.fromkeys(named, len(text)))
            articles.update(dict.fromkeys(within, len(text)))
    void = {k for k, n in held.items() if 2 * n > total or not names}
    if articles:
        void.update(max(articles, key=lambda a: (articles[a], -a[0]))[1])
    return [(path, text, bool(within), out or not void.issuperset(named), tags, link) for path, text, within, out, named, tags, link in found]


def _blocks(page: str) -> Iterator[tuple[str, str, tuple, bool, tuple[int, ...], tuple[str, ...], bool]]:
    """Of every block: path, text, articles around it (place, names around that), is it inside furniture by kind, elements with furniture's names around it (places), inline elements in it, is it a link's text."""
    stack = [_Element("", "", False, (), (), False)]
    parts: list[str] = []
    tags: set[str] = set()
    links = 0
    at, size = 0, len(page)
    owner = stack[0]

    def flush():
        nonlocal links
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip() if parts else ""
        linked = bool(text) and links * 2 > len(text)
        inline = tuple(sorted(tags))
        parts.clear()
        tags.clear()
        links = 0
        return (owner.path, text, owner.articles, owner.out, owner.named, inline, linked) if text else None

    while at < size:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            if not parts:
                owner = stack[-1]
            parts.append(text)
            if stack[-1].link:
                links += len(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if not m[1]:
            if tag == "svg" and m[3].rstrip().endswith("/"):
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                close = page.find(">", end.start()) if end else -1
                at = close + 1 if close >= 0 else size
                if tag not in BLOCK:
                    parts.append(" ")
                continue
            if tag in BLOCK:
                if found := flush():
                    yield found
                closes = _CLOSES.get(tag)
                if closes or tag in BLOCK:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag in (closes or ()) or (stack[k].tag == "p"):
                            del stack[k:]
                            break
                        if stack[k].tag in BLOCK:
                            break
            elif tag == "br":
                parts.append(" ")
            if tag not in BLOCK:
                tags.add(tag)
            if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCK:
                continue
            top = stack[-1]
            out, named, label = _marked(tag, m[3], bool(top.articles))
            articles = (*top.articles, (at, top.named)) if tag in ("article", "main") else top.articles
            path = _path(f"{top.path}/{label}") if tag in BLOCK else top.path
            stack.append(_Element(tag, path, top.out or out, (*top.named, at) if named else top.named, articles, top.link or tag == "a"))
        else:
            if tag in BLOCK and (found := flush()):
                yield found
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                    break
    if found := flush():
        yield found


def _path(path: str) -> str:
    return path if len(path) <= LONGEST_PATH else "~" + hashlib.blake2b(path.encode("utf-8", "replace"), digest_size=12).hexdigest()


def _text_token(path: str, text: str) -> str:
    """The token of a text at a path; a path holds no line break, so the two kinds of tokens differ."""
    return "\n" + hashlib.blake2b(f"{path}\n{text}".encode("utf-8", "replace"), digest_size=10).hexdigest()


def main_text(page: str, furniture: frozenset[str], names: bool = True) -> str:
    """The blocks that stand in no slot of `furniture` and are no text of it; if none has text those of the article, and if none is marked all."""
    kept = [(article, path, text) for path, text, article, out, _, _ in blocks(page, names) if not out]
    data = [t for a, path, t in kept if not furniture or not (path in furniture or (not a and _TURNING + path in furniture) or _text_token(path, t) in furniture)]
    return "\n\n".join(data or [t for a, _, t in kept if a] or [t for *_, t in kept])


def _page_hash(page_id: int, page: int, salt: int) -> int:
    return zlib.crc32(f"{salt}:{page_id}:{page}".encode()) & 0x7FFFFFFF


def _token_stats(batches: Iterator) -> Iterator:
    import pandas as pd

    slots: dict[str, int] = {}
    for pdf in batches:
        seen: dict[tuple[str, str], list] = {}
        if len(slots) > 100_000:
            slots.clear()
        for page_id, host, page in zip(pdf["page_id"], pdf["host"], pdf["html"], strict=True):
            own: dict[str, list] = {}
            texts: dict[str, list] = {}
            whole = 0
            inner: dict[str, list] = {}
            for path, text, *_, tags, link in blocks(page or ""):
                whole = zlib.crc32(text.encode("utf-8", "replace"), whole)
                token = _text_token(path, text)
                if path not in slots:
                    slots[path] = int.from_bytes(hashlib.blake2b(path.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
                texts.setdefault(token, [0, slots[path]])[0] += 1
                for tag in tags:
                    inner.setdefault(f"{_INLINE}{path} {tag}", [0, slots[path]])[0] += 1
                row = own.setdefault(path, [0, 0, 0, 0])
                row[0] += 1
                row[1] += len(text)
                row[2] += len(text) if link else 0
                row[3] = zlib.crc32(text.encode("utf-8", "replace"), row[3])
            own.update((token, [n, 0, 0, whole]) for token, (n, _) in texts.items())
            own.update((token, [n, 0, 0, 0]) for token, (n, _) in inner.items())
            page_crc = zlib.crc32((page or "").encode("utf-8", "replace"))
            h1, h2 = _page_hash(page_id, page_crc, 1), _page_hash(page_id, page_crc, 2)
            for path, (n, chars, linked, crc) in own.items():
                s = seen.get((host, path))
                if s is None:
                    seen[host, path] = [1, n * h1, n * h2, chars, linked, crc, crc, (texts.get(path) or inner.get(path) or (0, slots.get(path)))[1]]
                else:
                    s[0] += 1
                    s[1] += n * h1
                    s[2] += n * h2
                    s[3] += chars
                    s[4] += linked
                    s[5], s[6] = min(s[5], crc), max(s[6], crc)
        yield pd.DataFrame([(*k, *v) for k, v in seen.items()], columns=["host", "path", "pages", "v1", "v2", "chars", "linked", "low", "high", "slot"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, furniture): the paths of each host's template slots whose text never changes or is links only, and the tokens of its constant texts.

    A row of a path has its least and greatest text hash; a row of a text those of the pages it is on, which must differ.
    """
    schema = "host string, path string, pages long, v1 long, v2 long, chars long, linked long, low long, high long, slot long"
    partial_rows = pages.select("page_id", "host", "html").mapInPandas(_token_stats, schema)
    tokens = partial_rows.groupBy("host", "path").agg(*(F.sum(c).alias(c) for c in ("pages", "v1", "v2", "chars", "linked")), F.min("low").alias("low"), F.max("high").alias("high"), F.min("slot").alias("slot"))
    every = materialize(tokens.withColumn("is_text", F.startswith("path", F.lit("\n"))), "page-tokens")
    tokens = every.where(F.col("pages") >= LEAST_PAGES)
    shared = every.where("is_text").groupBy("host", "slot").agg((F.sum(F.when((F.col("pages") > 1) & (F.col("low") < F.col("high")), F.col("pages")).otherwise(0)) / F.sum("pages")).alias("shared"), (F.sum("pages") / F.count(F.lit(1))).alias("turns"))
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    classes = tokens.where("not is_text").groupBy("host", "v1", "v2").agg(F.count(F.lit(1)).alias("tokens"), F.max("pages").alias("on"))
    valid = classes.join(hosts, "host").where((F.col("tokens") >= LEAST_TOKENS) & (F.col("on") >= LEAST_SHARE * F.col("host_pages"))).select("host", "v1", "v2", "host_pages")
    slots = tokens.where(~F.startswith("path", F.lit(_INLINE))).join(valid, ["host", "v1", "v2"]).join(shared, ["host", "slot"])
    still = (F.col("low") == F.col("high")) | (F.col("linked") >= 0.9 * F.col("chars"))
    turning = (F.col("shared") >= SHARED_TEXTS) & (F.col("turns") >= TURNS)
    constant = (F.col("low") < F.col("high")) & (F.col("pages") > TEXT_SHARE * F.col("host_pages"))
    named = F.when(F.when(F.col("is_text"), constant).otherwise(still), F.col("path")).when(~F.col("is_text") & turning, F.concat(F.lit(_TURNING), "path"))
    return slots.select("host", named.alias("path")).where("path is not null").groupBy("host").agg(F.array_sort(F.collect_list("path")).alias("furniture"))


def _extract(batches: Iterator) -> Iterator:
    import pandas as pd

    for pdf in batches:
        texts = [main_text(p or "", frozenset(f) if f is not None else frozenset()) for p, f in zip(pdf["html"], pdf["furniture"], strict=True)]
        yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": np.array([len(t) for t in texts], np.int64)})


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of `pages` (page_id, url, html, ...).

    Null or empty html gives an empty text; a null url belongs to the host "". Repeated rows give a row each, and count
    as pages of their own in the template. A class needs three pages, so smaller hosts have no deduced template. Other columns are
    ignored; no pages give no rows.
    """
    small_batches(pages.sparkSession)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("host", host_of(F.col("url")))
    found = materialize(templates(base), "templates")
    joined = base.join(found, "host", "left").select("page_id", "url", "html", "furniture")
    return joined.mapInPandas(_extract, "page_id long, url string, text string, n_chars long")
