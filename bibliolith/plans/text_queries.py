"""Search, vector, text and similarity queries over documents, conversations, embeddings and part names."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import segment, text
from ..operators import rules, search, similar, vector
from ..schema import rounded
from .standins import table, view

_ASCII = "[x FOR x IN regexp_split_to_array(lower({}), '[^a-z0-9]+') IF x <> '']"
_QUERY = "SELECT item_id AS query_id, text AS query FROM benchmark WHERE item_id % 4 = 0"


def _ascii(c):
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")


def bm25_search(spark, sf):
    r = search.bm25(table(spark, sf, "documents"), view(spark, sf, _QUERY), k=5)
    return r.select("query_id", "doc_id", "hits", rounded(F.col("score"), 6).alias("score"))


def staged_fallback(spark, sf):
    return search.staged(table(spark, sf, "documents"), view(spark, sf, _QUERY)).groupBy("query_id", "stage").agg(F.count(F.lit(1)).alias("n"))


def phrase_search(spark, sf):
    return search.phrase(table(spark, sf, "documents"), "And the")


def trigram_index(spark, sf):
    return view(spark, sf, "SELECT p_name FROM part").select(F.explode(search.trigrams(F.col("p_name"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def match_window(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.length(search.match_window(F.col("text"), F.array(F.lit(" the "), F.lit(" de ")), 400, 100, 50)).cast("bigint").alias("n"))


def knn_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    return vector.nearest(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10).select("query_id", "vec_id", "nth", rounded(F.col("score"), 5).alias("score"))


def concept_knn(spark, sf):
    e = table(spark, sf, "embeddings").where("label = 1")
    return vector.nearest(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5).select("query_id", "vec_id", "nth")


def best_per_label(spark, sf):
    e = table(spark, sf, "embeddings")
    hits = vector.nearest(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 50).join(e.select("vec_id", "label"), "vec_id")
    return vector.best_per_document(hits, "label", "score", "vec_id").select("query_id", "label", "vec_id")


def vector_norms(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x * F.col("vec_id").cast("float")))
    return vector.build(e, 64).select("vec_id", rounded(F.sqrt(vector.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"))


def slugs(spark, sf):
    return view(spark, sf, "SELECT DISTINCT p_type FROM part").select("p_type", text.slug(F.col("p_type")).alias("slug"))


def dois(spark, sf):
    d = view(spark, sf, "SELECT p_partkey AS id, concat(CASE p_partkey % 4 WHEN 0 THEN 'https://doi.org/' WHEN 1 THEN 'doi: ' WHEN 2 THEN ' ' ELSE '' END, '10.1234/', p_brand, '.', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 2 = 0 THEN '..' ELSE '' END) AS raw FROM part")
    n = text.doi(F.col("raw"))
    return d.select("id", n.alias("doi"), text.is_doi(n).alias("valid"))


def journal_keys(spark, sf):
    return view(spark, sf, "SELECT p_partkey AS id, concat(p_brand, ' & ', p_type, ', (', p_name, ')') AS j FROM part").select("id", text.journal_key(F.col("j")).alias("key"))


def concept_keys(spark, sf):
    return view(spark, sf, "SELECT DISTINCT concat(p_brand, ' (', p_name, ') ', p_type, 's / x-y') AS s FROM part").select("s", text.concept(F.col("s")).alias("concept"))


def title_keys(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", text.title_key(F.translate("text", "\n\t", "  ")).alias("key"))


def token_estimates(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.token_estimate(F.col("text")).alias("tokens"))


def block_flags(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(text.block_flags(F.col("text")), ",").alias("flags"))


def page_abstracts(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(text.without_tags(F.regexp_extract("html", r"(?s)<nav>(.*?)</nav>", 1)).cast("binary")).alias("md5"))


def topic_compile(spark, sf):
    p = view(spark, sf, "SELECT p_partkey AS id, p_type, CAST(p_size AS BIGINT) AS cites FROM part").select("id", "cites", F.explode(F.split("p_type", " ")).alias("topic"))
    return p.groupBy(text.slug(F.col("topic")).alias("slug")).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("cites"), 4).alias("avg_cites")).where("n >= 3")


def token_dice_pairs(spark, sf):
    return similar.dice_pairs(table(spark, sf, "documents"), _ascii(F.col("text")), 0.9).select("a", "b", rounded(F.col("dice"), 9).alias("dice"))


def ngram_dice(spark, sf):
    n = view(spark, sf, "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
    g = lambda c: similar.ngrams(F.lower(c), 3)
    return n.select("a", "b", rounded(similar.dice(g("a"), g("b")), 9).alias("dice"))


def exact_duplicates(spark, sf):
    d = table(spark, sf, "documents")
    return similar.exact_duplicates(d, F.regexp_replace(F.lower("text"), "[ \n]+", " "))


def section_chunks(spark, sf):
    return segment.chunk_documents(table(spark, sf, "documents").select("doc_id", "text"), 900, 120)


def paragraph_alignment(spark, sf):
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("left"))
    return similar.align(c.withColumn("right", F.slice("left", F.lit(2), F.size("left"))))


def lcs_ratios(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("left"), F.reverse("text").alias("right"))
    return similar.lcs_ratio(b).select("item_id", "lcs_ratio")


def rule_candidates(spark, sf):
    return rules.mine_pairs(table(spark, sf, "documents").select(F.col("lang").alias("context"), "text"), least=5)


def rule_statistics(spark, sf):
    return rules.statistics(view(spark, sf, "SELECT p_partkey AS rule_id, p_brand AS category, p_type AS level, p_partkey % 2 = 0 AS enabled, p_partkey % 3 = 0 AS auto_apply FROM part"))


def document_fingerprint(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"), F.sum(F.size(F.split("text", "\n"))).alias("lines"), F.max("n_chars").alias("longest"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_search, staged_fallback, phrase_search, trigram_index, match_window, knn_topk, concept_knn, best_per_label, vector_norms, slugs, dois, journal_keys, concept_keys, title_keys, token_estimates,
        block_flags, page_abstracts, topic_compile, token_dice_pairs, ngram_dice, exact_duplicates, section_chunks, paragraph_alignment, lcs_ratios, rule_candidates, rule_statistics, document_fingerprint,
    )
}

_BM = f"""q AS ({_QUERY}), qt AS (SELECT query_id, unnest(list_distinct(list_slice([x FOR x IN regexp_split_to_array(lower(replace(query, '"', ' ')), '[^\\p{{L}}\\p{{N}}]+') IF x <> ''], 1, 8))) AS term FROM q),
    t AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+') IF x <> ''] AS w FROM documents), n AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
    u AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t), h AS (SELECT doc_id, dl, term, count(*) AS tf FROM u WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2, 3),
    f AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
    s AS (SELECT query_id, doc_id, count(*) AS hits, sum(greatest(CAST(1e-6 AS DOUBLE), ln((n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE)))) * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl))) AS score
          FROM h JOIN f USING (term) JOIN qt USING (term), n GROUP BY 1, 2)"""
_BM_WHOLE = re.sub(r"list_slice\((.*), 1, 8\)", r"\1", _BM)
_NORM = "list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN {}.embedding])"
_COS = f"list_sum([CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE) FOR i IN range(1, 65)]) / (sqrt({_NORM.format('a')}) * sqrt({_NORM.format('b')}))"
ORACLE_SQL = {
    "bm25_search": f"WITH {_BM_WHOLE} SELECT query_id, doc_id, hits, floor(score * 1000000 + 0.5) / 1000000.0 AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 5",
    "staged_fallback": f"""WITH {_BM}, k AS (SELECT query_id, count(*) AS terms FROM qt GROUP BY 1), e AS (SELECT query_id, doc_id, CASE WHEN hits = terms THEN 1 ELSE 2 END AS stage FROM s JOIN k USING (query_id) UNION ALL SELECT query_id, doc_id, 3 FROM q, documents d WHERE contains(lower(d.text), lower(trim(query)))),
        m AS (SELECT query_id, doc_id, min(stage) AS stage FROM e GROUP BY 1, 2) SELECT query_id, CAST(stage AS BIGINT) AS stage, count(*) AS n FROM m WHERE stage = (SELECT min(stage) FROM m x WHERE x.query_id = m.query_id) GROUP BY 1, 2""",
    "phrase_search": "SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'and the', ''))) // 7 AS BIGINT) AS n FROM documents WHERE contains(lower(text), 'and the')",
    "trigram_index": "SELECT gram, count(*) AS n FROM (SELECT unnest([substr(lower(p_name), i, 3) FOR i IN range(1, length(p_name) - 1)]) AS gram FROM part) GROUP BY 1",
    "knn_topk": f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
        SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS BIGINT) AS nth, floor(score * 100000 + 0.5) / 100000.0 AS score FROM s QUALIFY nth <= 10""",
    "concept_knn": f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND a.label = 1 AND b.label = 1)
        SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS BIGINT) AS nth FROM s QUALIFY nth <= 5""",
    "best_per_label": f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 50)
        SELECT query_id, label, vec_id FROM t QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) = 1""",
    "vector_norms": "SELECT vec_id, CASE WHEN vec_id = 0 THEN 0.0e0 ELSE 1.0e0 END AS norm FROM embeddings",
    "slugs": "SELECT DISTINCT p_type, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part",
    "dois": "SELECT p_partkey AS id, concat('10.1234/', lower(p_brand), '.', CAST(p_partkey AS VARCHAR)) AS doi, regexp_matches(concat('10.1234/', lower(p_brand), '.', CAST(p_partkey AS VARCHAR)), '^10\\.[0-9]{4,9}/\\S+$') AS valid FROM part",
    "journal_keys": "SELECT p_partkey AS id, regexp_replace(upper(concat(p_brand, 'and', p_type, p_name)), ' ', '', 'g') AS key FROM part",
    "concept_keys": "SELECT DISTINCT concat(p_brand, ' (', p_name, ') ', p_type, 's / x-y') AS s, concat(lower(replace(p_brand, '#', ' ')), ' ', lower(p_type), 's / x y') AS concept FROM part",
    "title_keys": "SELECT item_id, trim(regexp_replace(regexp_replace(lower(translate(translate(text, chr(10) || chr(9), '  '), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY')), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS key FROM benchmark",
    "token_estimates": "SELECT conv_id, turn, CAST(greatest(1, length(text) // 2) AS BIGINT) AS tokens FROM conversations",
    "block_flags": """SELECT conv_id, turn, concat_ws(',', CASE WHEN len(regexp_extract_all(text, '\\S+')) < 8 THEN 'short' END, CASE WHEN NOT regexp_matches(text, '[.!?:;。！？]["'')\\]]*\\s*$') THEN 'open_end' END, CASE WHEN regexp_matches(text, '^\\s*[a-z]') THEN 'lower_start' END) AS flags FROM conversations""",
    "page_abstracts": "SELECT page_id, md5(substr(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), 1, 4000)) AS md5 FROM pages",
    "topic_compile": "SELECT lower(t) AS slug, count(*) AS n, floor(avg(p_size) * 10000 + 0.5) / 10000.0 AS avg_cites FROM (SELECT p_size, unnest(string_split(p_type, ' ')) AS t FROM part) GROUP BY 1 HAVING count(*) >= 3",
    "ngram_dice": """WITH g AS (SELECT n_nationkey AS k, n_name, list_distinct([substr(lower(n_name), i, 3) FOR i IN range(1, length(n_name) - 1)]) AS w FROM nation)
        SELECT a.n_name AS a, b.n_name AS b, floor(2.0e0 * len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w)) * 1000000000 + 0.5) / 1000000000.0 AS dice FROM g a JOIN g b ON a.k < b.k""",
    "exact_duplicates": "SELECT doc_id, min(doc_id) OVER (PARTITION BY regexp_replace(lower(text), '[ \\n]+', ' ', 'g')) AS first FROM documents",
    "rule_statistics": "SELECT p_brand AS category, count(*) AS rules, count(*) FILTER (p_partkey % 2 = 0) AS enabled, count(*) FILTER (p_partkey % 3 = 0) AS automatic, count(DISTINCT p_type) AS levels FROM part GROUP BY 1",
    "document_fingerprint": "SELECT lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines, max(n_chars) AS longest FROM documents GROUP BY 1",
    "rule_candidates": """WITH w AS (SELECT lang AS context, unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS word FROM documents), c AS (SELECT context, word, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(*) >= 5)
        SELECT context, word, n FROM c""",
}
