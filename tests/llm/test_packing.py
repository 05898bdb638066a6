import random
import zlib

import numpy as np
import pytest

from bibliolith.llm import packing

DOCS = "doc_id long, text string, length string"


def test_histogram_packing_places_everything():
    rnd = random.Random(2)
    for _ in range(300):
        capacity = rnd.choice([10, 50, 2048])
        counts = {rnd.randint(1, capacity): rnd.randint(1, 30) for _ in range(rnd.randint(0, 40))}
        used: dict[int, int] = {}
        for n, content in packing.pack_histogram(counts, capacity):
            assert n > 0 and sum(length * per for length, per in content) <= capacity
            for length, per in content:
                used[length] = used.get(length, 0) + n * per
        assert used == counts


def best(sizes, capacity):
    """The least number of bins by trying everything."""
    sizes = sorted(sizes, reverse=True)
    least = len(sizes)

    def go(k, bins):
        nonlocal least
        if len(bins) >= least:
            return
        if k == len(sizes):
            least = len(bins)
            return
        for i in sorted({b: i for i, b in enumerate(bins)}.values()):
            if bins[i] + sizes[k] <= capacity:
                go(k + 1, [*bins[:i], bins[i] + sizes[k], *bins[i + 1 :]])
        go(k + 1, [*bins, sizes[k]])

    go(0, [])
    return least


def test_reduction_keeps_an_optimum():
    rnd = random.Random(4)
    over = 0
    for _ in range(120):
        sizes = [rnd.randint(1, 20) for _ in range(rnd.randint(1, 9))]
        counts = {s: sizes.count(s) for s in sizes}
        over += sum(n for n, _ in packing.pack_histogram(counts, 20)) - best(sizes, 20)
    assert over <= 2


def test_words_encode_like_whole_texts():
    t = packing._tokenizer(packing.default_tokenizer())
    rnd = random.Random(1)
    texts = ["it's we'LL I'M 'sx", "é café", "a b c", "Σας İ, ǅ", "<|endoftext|> x", "", "a\x1cb", "½ Ⅷ 12,5"]
    texts += ["".join(rnd.choice("aB.,'’s é̀Σ́<|>1²\n\tİ한") for _ in range(rnd.randint(1, 25))) for _ in range(3000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    assert list(packing.encode_words([x.encode() for x in texts], packing.default_tokenizer())) == want


def test_pieces_round_trip(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma."]) for _ in range(rnd.choice([0, 3, 40, 300]))), "x") for i in range(60)] + [(60, None, None), (60, "twice", "x"), (61, "", "")]
    out = packing.pack_documents(spark.createDataFrame(rows, DOCS), capacity=64).toPandas()
    t = packing._tokenizer(packing.default_tokenizer())
    want = []
    for i, text, _ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, p, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for p, s in enumerate(range(0, len(ids), 64))]
    assert sorted(out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 64
    assert out["sequence_id"].nunique() <= -(-out["length"].sum() // 64) + 2


def test_no_documents(spark):
    assert packing.pack_documents(spark.createDataFrame([], DOCS)).count() == 0
