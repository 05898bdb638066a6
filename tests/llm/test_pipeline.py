"""The pipeline against plain Python: everything but the learnt score is done again by brute force."""

import os
import re
import zlib
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from bibliolith.llm import decontam, packing, quality
from tests.llm.test_neardup import brute
from tests.llm.test_pii import KINDS, base

DATA = Path(os.environ.get("TESTDATA", "/root/testdata")) / "sf0.001"
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def redacted(text):
    out, at = "", 0
    for start, kind, end in base(text):
        if start >= at:
            out, at = out + text[at:start] + f"<{KINDS[kind].upper()}>", end
    return out + text[at:]


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in quality.score_documents(docs, model).where("predicted = 1").collect()]
    kept = {d for d, (_, c) in brute(rows).items() if d == c}
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    items = [words(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]

    def leaks(text):
        own = words(text)
        for item in items:
            for shift in range(-len(item) + 1, len(own)):
                best, score, start = (0, 0, 0), 0.0, 0
                lo, hi = max(0, -shift), min(len(item), len(own) - shift)
                matched = 0
                for k in range(lo, hi):
                    if score <= 0:
                        score, start, matched = 0.0, k, 0
                    same = item[k] == own[k + shift]
                    matched += same
                    score += 1 if same else -1.5
                    if score > best[0]:
                        best = (score, matched, k + 1 - start)
                if best[1] >= min(decontam.LEAST_WORDS, len(item)) and best[1] >= decontam.LEAST_SHARE * best[2]:
                    return True
        return False

    t = packing._tokenizer(packing.default_tokenizer())
    want = []
    for d, text in rows:
        if d in kept and not leaks(text):
            ids = np.array([*t.encode(redacted(text), add_special_tokens=False).ids, 0], "<u4")
            want += [(d, p, zlib.crc32(ids[s : s + 2048].tobytes())) for p, s in enumerate(range(0, len(ids), 2048))]
    out = corpus_pipeline.run(spark, str(DATA)).toPandas()
    assert sorted(out[["doc_id", "piece", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g["length"].sum() <= 2048


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, str(DATA)).columns == docs.columns
