"""Personal data by fixed patterns and by bootstrapped contexts, in SQL functions only.

The fixed patterns (e-mail, IPv4, card, phone) give the base spans. They are also the seeds of the bootstrap: every
base span and every identifier-like token or run of digit groups is an *instance*, the words around it make its lexical
*patterns*: the two words before it; the word before and the word after, with the kind of instance; the word before alone,
with the kind of instance. The distinct pairs form a bipartite graph. Patterns are scored by the part of their instances that
is known, instances by the patterns they occur in, in turn. Patterns that end with high confidence mark their unseen
instances; one word alone needs more seeds and more confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")

#: Same matches as the base patterns, in forms that take linear time and constant stack on any text: possessive where
#: giving back can't help, started only where a run starts (or where the last match ended inside one), and for cards with
#: the count of digits in the pattern, which is sound as a match always spans its whole maximal chain of digits.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: An instance: groups of digits with blanks between, or a token with a digit or an at sign.
_INSTANCE = r"(?:[(\"'\[]?+\+?+[(]?+[0-9][0-9().-]*+(?:\x20[(]?+[0-9][0-9().-]*+)++[^\s0-9\p{L}]*+(?!\S)|(?=[^\s0-9@]*+[0-9@])\S{5,}+)"
#: Two words without digits, or one that starts a line, then an instance.
_WORDS = r"(?:(?<!\S)[^\s0-9@]++[\x20\t]{1,3}+|(?m:^))[^\s0-9@]++[\x20\t]{1,3}+"
MENTION = rf"{_WORDS}{_INSTANCE}"
#: Its words, its instance, and the instance without the marks around it.
CUE, TOKEN = r"^([^0-9@]*[^\s0-9@])[\x20\t]+[^\s0-9@]*[0-9@]", r"^[^0-9@]*[\x20\t]([^\s0-9@]*[0-9@][\s\S]*)$"
#: The word after an instance.
AFTER = r"^[\x20\t]{1,3}([^\s0-9@]+)"
#: How patterns begin, by what they are made of, and how many times the support, and what share of the missing confidence, each needs.
PAIR, AROUND, SINGLE = "2 ", "a ", "1 "
DEMANDS = {PAIR: (1, 1.0), AROUND: (1, 1.0), SINGLE: (4, 0.5)}
IDENT = r"^[^\p{L}\p{N}+]*+([\s\S]*?)[^\p{L}\p{N}]*$"


def _runs(text: Column, pattern: str, when: Column) -> tuple[Column, Column]:
    """The non-overlapping matches of a pattern, and the lengths of the gaps before, between and after them."""
    none = F.array().cast("array<string>")
    return F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), F.when(when, F.transform(F.split(text, pattern, -1), lambda g: F.length(g)))


def _spans(values: str, gaps: str) -> Column:
    """An array of (start, end, value) in code points from the columns of `_runs`."""
    v = F.col(values)
    steps = F.zip_with(F.slice(F.col(gaps), 1, F.size(v)), v, lambda g, x: g + F.length(x))
    ends = F.aggregate(steps, F.array().cast("array<int>"), lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))
    spans = F.zip_with(ends, v, lambda e, x: F.struct((e - F.length(x)).alias("start"), e.alias("end"), x.alias("value")))
    return F.when(F.size(v) > 0, spans).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _luhn(value: Column) -> Column:
    digits = F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), "")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, "[.]"), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


#: What a text must hold for a pattern to match at all, tested before the pattern runs.
_NEEDS = {"email": "@", "phone": "+"}


def _kept(kind: str) -> Column:
    """The valid matches of a kind; a match that fails its test is dropped and not tried again elsewhere."""
    return F.filter(_spans(f"{kind}_values", f"{kind}_gaps"), lambda m: _valid(kind, m["value"]))


def _tagged(kind: str) -> Column:
    return F.transform(_kept(kind), lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def bootstrap_patterns(mentions: DataFrame, rounds: int = 3, support: int = 5, confidence: float = 0.8) -> DataFrame:
    """Lexical patterns (column cue) that mark personal data.

    `mentions` has cue, ident and seed (is the instance a base entity somewhere). A pattern's score is the mean belief in
    its distinct instances; with `support` distinct seeds or discovered instances and a score of `confidence` it is
    accepted (a single word needs four times the support and half of the doubt), and an instance in accepted patterns is believed by noisy-or of their scores. Counts are pre-aggregated over
    distinct pairs, so frequent patterns and instances don't gather their rows in one task.
    """
    pairs = materialize(mentions.groupBy("cue", "ident").agg(F.max("seed").alias("seed")), "pii-pairs")
    seeds = pairs.where("seed > 0").select("ident").distinct().withColumn("known", F.lit(1.0))
    belief = materialize(seeds, "pii-belief")
    accepted = None
    for _ in range(rounds):
        scored = pairs.join(belief, "ident", "left").groupBy("cue").agg(F.avg(F.coalesce("known", F.lit(0.0))).alias("score"), F.count_if(F.col("known") >= confidence).alias("n"))
        single = F.startswith("cue", F.lit(SINGLE))
        times, doubt = (F.when(single, DEMANDS[SINGLE][k]).otherwise(DEMANDS[PAIR][k]) for k in (0, 1))
        accepted = materialize(scored.where((F.col("n") >= support * times) & (F.col("score") >= 1 - (1 - confidence) * doubt)).select("cue", F.least("score", F.lit(0.999)).alias("score")), "pii-patterns")
        marked = pairs.join(accepted, "cue").groupBy("ident").agg((1 - F.exp(F.sum(F.ln(1 - F.col("score"))))).alias("known"))
        belief = materialize(seeds.unionByName(marked).groupBy("ident").agg(F.max("known").alias("known")), "pii-belief")
    return accepted


def _cues(words: Column, after: Column, ident: Column) -> Column:
    """The patterns of an instance from the words before it, the word after it, and what it is made of."""
    last = F.substring_index(words, " ", -1)
    kind = F.when(F.contains(ident, F.lit("@")), "@").when(ident.rlike(r"\p{L}"), "a").otherwise("9")
    around = F.when(after != "", F.concat(F.lit(AROUND), last, F.lit(" "), kind, F.lit(" "), after))
    return F.array_compact(F.array(F.when(F.contains(words, F.lit(" ")), F.concat(F.lit(PAIR), words)), around, F.concat(F.lit(SINGLE), last, F.lit(" "), kind)))


def find_pii(docs: DataFrame, rounds: int = 3, support: int = 5, confidence: float = 0.8) -> DataFrame:
    """One row per document: counts of base spans by kind, base_sha256, spans, and n_contextual for those that contexts add.

    Null texts are empty. Spans are kind:start:end in code points, joined by commas in order of start, then kind;
    contextual ones have kind "context" and never overlap a base span. Repeated rows and ids give a row each, each by its own
    text. No documents, no rows. Other columns are ignored.
    """
    return _detected(docs, rounds, support, confidence).drop("_text")


def _detected(docs: DataFrame, rounds: int, support: int, confidence: float) -> DataFrame:
    """The rows of `find_pii` and a hash of the text of each, _text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    runs = []
    for kind, pattern in {**PATTERNS, "mention": MENTION}.items():
        values, gaps = _runs(text, pattern, F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else text.rlike("[0-9@]"))
        runs += [values.alias(f"{kind}_values"), gaps.alias(f"{kind}_gaps")]
    follow = F.when(text.rlike("[0-9@]"), F.transform(F.split(text, MENTION, -1), lambda g: F.regexp_extract(g, r"^[\x20\t]*+(?:[^\s0-9@]++(?:\s|$))?+", 0)))
    found = docs.select("doc_id", F.xxhash64("text").alias("_text"), *runs, follow.alias("mention_follow"))
    flat = F.concat(*map(_tagged, KINDS))
    token = lambda m: F.regexp_extract(m["value"], TOKEN, 1)
    # what follows an instance is the gap behind it or, where that is empty, the words of the next one
    v = F.col("mention_values")
    after = F.transform(v, lambda _, i: F.lower(F.regexp_extract(F.concat(F.col("mention_follow")[i + 1], F.coalesce(F.try_element_at(v, i + 2), F.lit(""))), AFTER, 1)))
    words = lambda m: F.lower(F.regexp_replace(F.regexp_extract(m["value"], CUE, 1), r"[\x20\t]+", " "))
    ident = lambda m: F.regexp_extract(token(m), IDENT, 1)
    marks = F.zip_with(
        _spans("mention_values", "mention_gaps"), after,
        lambda m, a: F.struct(
            _cues(words(m), a, ident(m)).alias("cues"), ident(m).alias("ident"),
            (m["end"] - F.length(token(m)) + F.length(F.regexp_extract(token(m), r"^([^\p{L}\p{N}+]*+)", 1))).alias("start"),
        ),
    )
    marks = F.filter(marks, lambda m: F.length(m["ident"]) >= 5)
    rows = found.select("doc_id", "_text", F.monotonically_increasing_id().alias("_row"), F.array_sort(flat).alias("base"), marks.alias("marks"))
    rows = materialize(rows, "pii-base")

    values = rows.select(F.explode("base.value").alias("ident")).distinct().withColumn("seed", F.lit(1))
    mentions = rows.select(F.explode("marks").alias("m")).select(F.explode("m.cues").alias("cue"), "m.ident").groupBy("cue", "ident").agg(F.count(F.lit(1)).alias("n"))
    mentions = mentions.join(values, "ident", "left").withColumn("seed", F.coalesce("seed", F.lit(0)))
    accepted = bootstrap_patterns(mentions, rounds, support, confidence)

    # the discovered (cue, instance) pairs go back to their rows, not to all rows of an id or a pattern
    cued = rows.where(F.size("marks") > 0).select("_row", F.explode("marks").alias("m")).select("_row", F.explode("m.cues").alias("cue"), "m.ident", "m.start").join(accepted.select("cue"), "cue")
    extra = cued.groupBy("_row").agg(F.collect_set(F.struct(F.col("start").cast("int").alias("start"), F.lit(len(KINDS)).alias("rank"), F.lit("context").alias("kind"), (F.col("start") + F.length("ident")).cast("int").alias("end"), F.col("ident").alias("value"))).alias("extra"))
    joined = rows.join(extra, "_row", "left")
    new = F.filter(F.coalesce("extra", F.array()), lambda e: ~F.exists("base", lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])))
    joined = joined.withColumn("new", new)
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return joined.select("doc_id", "_text", *map(_count, KINDS), F.sha2(line(F.col("base")).cast("binary"), 256).alias("base_sha256"), line(F.array_sort(F.concat("base", "new"))).alias("spans"), F.size("new").cast("long").alias("n_contextual"))


def redact(docs: DataFrame, rounds: int = 3, support: int = 5, confidence: float = 0.8) -> DataFrame:
    """The rows of `docs` with every span of personal data in `text` replaced by its kind, as in <EMAIL>.

    Overlapping spans are replaced as one, by the kind of the one that starts first (then the longer). n_chars, where there is one, is set
    anew for changed texts. Null texts stay null. Rows that repeat a doc_id are each redacted by their own text.
    """
    found = _detected(docs.select("doc_id", "text"), rounds, support, confidence).where("spans <> ''").groupBy("doc_id", "_text").agg(F.min("spans").alias("_spans"))
    spans = F.transform(F.split("_spans", ","), lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("start"), (-F.split(s, ":")[2].cast("int")).alias("end"), F.upper(F.split(s, ":")[0]).alias("kind")))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    step = lambda acc, s: F.when(
        s["start"] >= acc["at"],
        F.struct(F.concat(acc["text"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">")).alias("text"), (-s["end"]).alias("at")),
    ).otherwise(F.struct(acc["text"].alias("text"), F.greatest(acc["at"], -s["end"]).alias("at")))
    keyed = found.withColumnRenamed("doc_id", "_id")
    marked = docs.join(keyed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_text")), "left").withColumn("_done", F.when(F.col("_spans").isNotNull(), F.aggregate(F.array_sort(spans), start, step)))
    text = F.when(F.col("_done").isNotNull(), F.concat("_done.text", F.substring(F.col("text"), F.col("_done.at") + 1, F.length("text")))).otherwise(F.col("text"))
    changed = {"text": text} | ({"n_chars": F.when(F.col("_done").isNotNull(), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return marked.select(*(changed[c].alias(c) if c in changed else c for c in docs.columns))
