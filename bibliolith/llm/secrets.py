"""Secret scan: a random forest sorts false positives out of pattern findings, in SQL functions and Spark ML only.

Every token of 16 characters or more with a digit, a capital after a small letter or 16 capitals in a row is a candidate, and so
is every token of 6 or more after a cue; the key of an assignment and a full stop behind are no part of its value. The forest sees its length, its character transitions, how much of it a
dictionary covers, the path it was found under and the words beside it, and is trained on labelled findings. Its trees
run as one column expression.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize
from .pii import _runs, _spans

#: A token of 16 characters or more of keys, tokens and hashes: with a digit, with mixed case, or capitals only. An equals sign ends it, but for padding.
_END = r"(?:={1,2}+(?![A-Za-z0-9_+/.-]))?+"
CANDIDATE = rf"(?<![A-Za-z0-9_+/.-])(?=[A-Za-z_+/.-]*+[0-9]|[A-Z_+/.-]*+[a-z_+/.-]++[A-Z]|[A-Z]{{16}})[A-Za-z0-9_+/.-]{{16,}}+{_END}"
#: Characters of context on each side.
NEAR = 48
#: Formats of known issuers.
ISSUED = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*|glpat-[A-Za-z0-9_-]{20,})"
CUES = r"(?i)(?:token|secret|passw(?:or)?d|passwd|api[ _-]?key|apikey|access[ _-]?key|private[ _-]?key|bearer|credential|auth(?:orization)?|client[ _-]?secret)(?:\W{1,3}(?:is|was))?\W*$"
HASH_CUES = r"(?i)(?:commit|sha-?[0-9]*|md5|checksum|digest|etag|revision|uuid|guid|hash|build|version|isbn|doi|id)\W*$"
#: The same or, after a cue, a token of 6 characters or more, with digits or without.
_CUED = r"(?i:token|secret|passw(?:or)?d|api[ _-]?key|access[ _-]?key|private[ _-]?key|bearer|credential|auth|authorization)"
CUED_CANDIDATE = rf"{CANDIDATE}|(?<![A-Za-z0-9_+/.-])(?<={_CUED}[\"'`\s]{{0,3}}(?:[=:\s]|\sis\s|\swas\s)[\"'`\s]{{0,3}})[A-Za-z0-9_+/.-]{{6,}}+{_END}"
ASSIGNED = r"[=:]\s*[\"'`]?$"
PLACES = r"(?i)(?:test|example|sample|fixture|mock|doc|demo|vendor|lock)"
#: Words that placeholders and identifiers are made of.
DICTIONARY = tuple(
    "about account action admin alpha and application array author backup base beta book button cache change channel chapter check class client close code color column common "
    "config content copy count create data date debug default delete demo details device document download dummy edit email enable error event example export field figure file "
    "filter first folder font format from function global group header height home host html http https image import index info input insert item json key language last layout "
    "level library license limit line link list local location login logo main manager menu message method mode model module name network number object option order output "
    "package page panel parent part password path placeholder plugin point position post print profile project property public query random read record release remove report "
    "request reset response result role route row sample save schema script search section select server service session setting size source start state status stop string "
    "style submit summary support sync system table target task template test text theme this time title toggle token tool total type update upload user value version video "
    "view volume web widget width window word world write xxxx your zone".split()
)

FEATURES = ("length", "digits", "upper", "switches", "repeats", "runs", "letters_common", "covered", "distinct", "cue", "hash_cue", "assigned", "issued", "place", "depth")


def features(value: Column, before: Column, path: Column) -> dict[str, Column]:
    """Numbers about a candidate, the text before it, and its path (null as none)."""
    n = F.greatest(F.length(value), F.lit(1))
    low, path = F.lower(value), F.coalesce(path, F.lit(""))
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    words = F.filter(F.array(*map(F.lit, DICTIONARY)), lambda w: F.contains(low, w))
    return {
        "length": n.cast("double"),
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "switches": share("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])"),
        "repeats": share(r"(.)(?=\1)"),
        "runs": share("[A-Za-z]{4,}+|[0-9]{5,}+"),
        "letters_common": share("(?i)(?:th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng)"),
        "covered": F.least(F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)) / n, F.lit(1.0)),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(62)),
        "cue": before.rlike(CUES).cast("double"),
        "hash_cue": (before.rlike(HASH_CUES) & ~before.rlike(CUES)).cast("double"),
        "assigned": before.rlike(ASSIGNED).cast("double"),
        "issued": value.rlike(ISSUED).cast("double"),
        "place": path.rlike(PLACES).cast("double"),
        "depth": F.regexp_count(path, F.lit("/")).cast("double"),
    }


def labelled_findings(spark: SparkSession, size: int = 6_000) -> DataFrame:
    """(value, before, path, label): findings with known labels, made by rule from `size` numbers.

    Secrets: random strings in hex, base 62 or issued formats after a cue. False positives: the same shapes after the names of
    hashes and ids, random strings in test folders without a cue, identifiers made of words, dates, paths, and placeholders.
    """
    h = F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")).cast("binary"), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(h)), "[+/=]", "")
    pick = lambda salt, options: F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(options))) + 1).cast("int"))
    length = (F.lit(20) + F.pmod(F.xxhash64("id", F.lit(3)), F.lit(21))).cast("int")
    random = F.when(F.col("id") % 2 == 0, F.substring(h, 1, 40)).otherwise(b64.substr(F.lit(1), length))
    cue = F.concat(pick(4, ("the ", "set ", "export ", "your ", "in ")), pick(5, ("token", "secret", "password", "api_key", "API_KEY", "TOKEN", "access_key", "bearer", "client_secret")), pick(6, (' = "', " = ", ": ", "=", ': "', " ")))
    plain = F.concat(pick(7, ("see ", "in ", "of ", "the ")), pick(8, ("commit ", "sha256:", "checksum ", "md5 ", "build ", "id=", "uuid ", "revision ")))
    words = F.concat_ws("_", pick(9, DICTIONARY), pick(10, DICTIONARY), pick(11, DICTIONARY), F.pmod(F.col("id"), F.lit(100)).cast("string"))
    holder = pick(12, ("your_token_here_0123", "xxxxxxxxxxxxxxxx0000", "example-password-123", "0000000000000000", "2024-01-01T00.00.00", "1234567890123456", "path/to/file/v2/index1", "aaaaaaaaaaaaaaaa1111"))
    issued = F.concat(pick(13, ("ghp_", "sk_live_", "glpat-")), F.substring(b64, 1, 36))
    dull = pick(16, ("and the ", "of ", "was ", "see "))
    kind = F.col("id") % 8
    label = (kind < 4).cast("double")
    value = F.when(kind < 3, random).when(kind == 3, issued).when(kind == 4, random).when(kind == 5, words).when(kind == 6, holder).otherwise(random)
    before = F.when(kind < 3, cue).when(kind == 3, F.when(F.col("id") % 16 < 8, cue).otherwise(dull)).when(kind == 4, plain).when(kind == 5, F.when(F.col("id") % 16 < 8, cue).otherwise(dull)).when(kind == 6, cue).otherwise(dull)
    path = F.when(kind == 7, pick(14, ("test/data", "docs/example", "fixtures/a"))).otherwise(pick(15, ("src/app", "src3", "etc/conf.d", "docs/a", "")))
    return spark.range(size).select(value.alias("value"), before.alias("before"), path.alias("path"), label.alias("label"))


def fit(findings: DataFrame, trees: int = 24, depth: int = 6):
    """A random forest of Spark ML over labelled findings (value, before, path, label), as a list of its root nodes."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = findings.where("value is not null and label is not null").select("label", *(c.cast("double").alias(k) for k, c in features(F.col("value"), F.coalesce("before", F.lit("")), F.col("path")).items()))
    rows = materialize(rows.coalesce(4), "labelled-findings")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("label", "features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11).fit(vectors)
    trees_ = [_node(t.rootNode()) for t in forest._java_obj.trees()]
    discard(rows)
    return trees_


def _node(node):
    """A tree as nested tuples (feature, threshold, left, right), its leaves the share of secrets."""
    if node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        return FEATURES[split.featureIndex()], float(split.threshold()), _node(node.leftChild()), _node(node.rightChild())
    stats = list(node.impurityStats().stats())
    return stats[1] / sum(stats)


def _vote(node) -> Column:
    if not isinstance(node, tuple):
        return F.lit(float(node))
    return F.when(F.col(node[0]) <= node[1], _vote(node[2])).otherwise(_vote(node[3]))


def probability(trees: list) -> Column:
    return reduce(lambda a, b: a + b, map(_vote, trees)) / len(trees)


def scan(docs: DataFrame, trees: list | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per candidate of `docs` (doc_id, text, source): doc_id, start, end (code points), value_sha256, probability, secret.

    `source` is the path and may be null; null and empty texts have no candidates. Repeated rows give repeated findings.
    The value itself is not returned, only its hash. Other columns are ignored. An empty table gives no rows.
    """
    trees = trees if trees is not None else fit(labelled_findings(docs.sparkSession))
    text = F.coalesce("text", F.lit(""))
    cued = text.rlike(_CUED)
    plain, near_cues = _runs(text, CANDIDATE, ~cued), _runs(text, CUED_CANDIDATE, cued)
    values, gaps = (F.when(cued, b).otherwise(a) for a, b in zip(plain, near_cues, strict=True))
    found = docs.select("doc_id", "source", "text", values.alias("c_values"), gaps.alias("c_gaps")).where(F.size("c_values") > 0)
    each = found.select("doc_id", "source", "text", F.explode(_spans("c_values", "c_gaps")).alias("m"))
    begin = F.greatest(F.col("m.start") - NEAR, F.lit(0))
    value = F.rtrim(F.col("m.value"), F.lit("."))
    near = each.select("doc_id", "source", "m.start", (F.col("m.start") + F.length(value)).alias("end"), value.alias("value"), F.col("text").substr(begin + 1, F.col("m.start") - begin).alias("before"))
    near = near.where(F.length("value") >= 6)
    scored = near.select("doc_id", "start", "end", "value", *(c.cast("double").alias(k) for k, c in features(F.col("value"), F.col("before"), F.col("source")).items()))
    scored = scored.withColumn("probability", probability(trees))
    return scored.select(
        "doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"),
        "probability", (F.col("probability") >= threshold).alias("secret"),
    )
