"""Empty tables, missing values, very long texts and repeated rows, for operators and pipeline stages."""

import os
from pathlib import Path

import pytest

import corpus_pipeline
from bibliolith.llm import decontam, hamming, htmltext, neardup, packing, pii, quality, sharding, suffix

DATA = Path(os.environ.get("TESTDATA", "/root/testdata")) / "sf0.001"
LONG = "word and word of words. " * 60_000
ODD = [(1, None, "en", None, None), (1, "One text, twice the id.", "en", "s", 23), (1, "One text, twice the id.", "en", "s", 23), (None, "A text without an id that is kept.", None, "s", 35), (2, "", "en", "s", 0), (3, LONG, "en", "s", len(LONG)), (4, "퟿\U0001f600 é", "en", "s", 4)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_top_k_of_no_codes(spark):
    none = spark.createDataFrame([], "vec_id long, code long")
    asked = spark.createDataFrame([(1, 5)], "query_id long, code long")
    assert hamming.top_k(none, asked).count() == 0
    assert hamming.top_k(spark.createDataFrame([(1, 5), (None, 6), (2, None)], "vec_id long, code long"), asked.limit(0)).count() == 0
    assert [tuple(r) for r in hamming.top_k(spark.createDataFrame([(1, 5), (1, 5), (None, 6), (2, None)], "vec_id long, code long"), asked).collect()] == [(1, 1, 1, 0)]


def test_quality_of_nothing_and_of_odd_rows(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert model.weights == () and quality.score_documents(docs, model).count() == 0
    odd = spark.createDataFrame(ODD, SCHEMA)
    scored = quality.score_documents(odd, quality.fit(odd, spark.createDataFrame([(1, 1), (3, 0), (4, None), (None, 1)], "doc_id long, quality int"))).collect()
    assert len(scored) == len(ODD) and all(0 <= r.score <= 1 for r in scored)


def test_very_long_texts(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).where("doc_id is not null")
    assert sharding.shard_documents(docs, 3).count() == 6
    assert sum(r.length for r in packing.pack_documents(docs.where("doc_id = 3")).collect()) > 300_000
    assert {r.doc_id: r.n_shingles for r in neardup.near_duplicates(docs.where("doc_id > 1")).collect()}[3] == 5
    assert [r.n_bytes for r in suffix.remove_repeats(docs.where("doc_id = 3")).collect()] == [len(LONG)]
    assert [r.spans for r in pii.find_pii(docs.where("doc_id = 3")).collect()] == [""]
    assert decontam.contaminated(docs, spark.createDataFrame([(1, "no such item in any of these texts at all")], "item_id long, text string")).count() == 0
    page = spark.createDataFrame([(1, "http://a.example/", f"<article><p>{LONG}</p></article>")], "page_id long, url string, html string")
    assert [r.n_chars for r in htmltext.extract_text(page).collect()] == [len(LONG) - 1]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_stages_on_empty_and_odd_tables(spark):
    for _, stage in corpus_pipeline.STAGES[:4]:
        empty = stage(spark, spark.createDataFrame([], SCHEMA), str(DATA))
        assert empty.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ") and empty.count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, spark.createDataFrame([], SCHEMA), str(DATA)).count() == 0
    odd = spark.createDataFrame(ODD, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        kept = [(r.doc_id, r.text) for r in stage(spark, odd, str(DATA)).collect()]
        assert sorted(kept, key=str) == sorted([(r[0], r[1]) for r in ODD], key=str), name
    assert {r.doc_id for r in corpus_pipeline.STAGES[4][1](spark, odd, str(DATA)).collect()} == {None, 1, 2, 3, 4}
