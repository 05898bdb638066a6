import corpus_pipeline
from bibliolith.llm import pii


def test_documents_without_an_id_stay(spark):
    long = " ".join(f"w{k}" for k in range(80))
    rows = [(1, long), (2, long), (3, "another one " + long[::-1]), (None, "no id " + " ".join(f"v{k}" for k in range(60)))]
    out = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(str(r.doc_id) for r in out) in (["1", "3", "None"], ["2", "3", "None"])


def test_overlapping_spans_leave_no_tail(spark):
    text = "see 10.1.2.41 1111 1111 1111 11 now"
    rows = [(1, text), (2, "at 1.2.3.41 1111 1111 1111 11 end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s] for r in pii.find_pii(docs).collect()}
    assert any(a[1] > b[0] for s in spans.values() for a, b in zip(s, s[1:]))
    for r in pii.redact(docs).collect():
        hidden = {k for a, b in spans[r.doc_id] for k in range(a, b)}
        left = "".join(c for k, c in enumerate(dict(rows)[r.doc_id]) if k not in hidden)
        assert "".join(r.text.replace("<IP>", "").replace("<CARD>", "").split()) == "".join(left.split())
