import hashlib
import random

import numpy as np

from bibliolith.llm import suffix

DOCS = "doc_id long, text string, n_bytes string, a string"


def test_suffix_array_and_copies():
    rnd = random.Random(5)
    for _ in range(200):
        n, k = rnd.randint(1, 250), rnd.choice([1, 2, 3, 20])
        x = np.array([rnd.randint(0 if rnd.random() < 0.2 else 1, k) for _ in range(n)], np.uint8)
        b = bytes(x)
        order = [b[i:].split(b"\0")[0] for i in suffix.suffix_array(x, 400)]
        assert order == sorted(order) and len(order) == int((x > 0).sum())
        length, seen = rnd.choice([8, 9, 16, 20]), set()
        later = suffix.later_copies(x, length)
        for i in range(n):
            w = b[i : i + length]
            good = len(w) == length and 0 not in w
            assert bool(later[i]) == (good and w in seen)
            if good:
                seen.add(w)


def brute(rows, length):
    seen, out = set(), {}
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone[:-1]], strict=True)) if len(b) else 0
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def made():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(2, 8)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(80):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 60)))]
        if rnd.random() < 0.7:
            a = rnd.randrange(100)
            parts.insert(rnd.randrange(2), passage[a : a + rnd.randint(90, 300)])
        rows.append((i, " ".join(parts), "", ""))
    rows += [(80, rows[3][1], "", ""), (81, rows[3][1], "", ""), (82, "ab" * 300, "", ""), (83, None, None, None), (84, "", "", ""), (85, "x" * 99, "", ""), (86, "x" * 99, "", ""), (87, "x" * 5000, "", "")]
    return rows


def check(spark, rows):
    out = suffix.remove_repeats(spark.createDataFrame(rows, DOCS), with_text=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == brute(rows, 100)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in out) and len(out) == len(rows)


def test_removal_equals_brute_force(spark):
    check(spark, made())


def test_hot_anchors_and_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 5)
    check(spark, made())


def test_no_documents(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
