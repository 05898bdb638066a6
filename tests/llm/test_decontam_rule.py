import random

import numpy as np

from bibliolith.llm import decontam


def holds(same):
    """Some stretch has 12 matches and a share of three quarters, by trying all."""
    m = np.concatenate(([0], np.cumsum(same)))
    return any(m[b] - m[a] >= 12 and 4 * (m[b] - m[a]) >= 3 * (b - a) for a in range(len(same)) for b in range(a + 1, len(same) + 1))


def test_any_stretch_of_the_rule_is_found(spark):
    rnd = random.Random(5)
    same = [[1] * 12 + [0] * 7 + [1] * 12 + [0] * 7 + [1] * 12, [1, 1, 1, 0] * 4, [1] * 9 + [0] * 20, [1] * 8 + [0, 0, 1, 1, 0, 1, 0, 1, 1]]
    same += [[int(rnd.random() < rnd.choice((0.6, 0.7, 0.8))) for _ in range(rnd.randint(14, 60))] for _ in range(300)]
    items = [(i, " ".join(f"i{i}w{k}" for k in range(len(s)))) for i, s in enumerate(same)]
    docs = [(i, "before this " + " ".join(f"i{i}w{k}" if m else f"d{i}w{k}" for k, m in enumerate(s)) + " after") for i, s in enumerate(same)]
    out = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = [i for i, s in enumerate(same) if holds(s)]
    assert {0, 1, 3} <= set(want) and 2 not in want and 50 < len(want) < 290
    assert sorted(r.doc_id for r in out) == want and all(r.item_id == r.doc_id for r in out)
    for r in out:
        s = same[r.doc_id][r.first_word - 2 : r.first_word - 2 + r.overlap_words]
        assert len(s) == r.overlap_words and sum(s) == r.matched_words >= 12 and 4 * sum(s) >= 3 * len(s)


def test_short_items_are_found_whole(spark):
    items = [(1, "Forty two"), (2, "Paris"), (3, "one two three four five"), (4, ""), (5, None), (6, "forty two is it")]
    docs = [(1, "The answer: forty, two!"), (2, "forty and two"), (3, "In paris one two three four six"), (4, "zero One two, three four five six"), (5, None), (6, "forty two is")]
    out = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.matched_words, r.first_word, r.item_words) for r in out) == [(1, 1, 2, 2, 2), (3, 2, 1, 1, 1), (4, 3, 5, 1, 5), (6, 1, 2, 0, 2)]


def test_a_seed_of_many_items_is_held_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontam, "AT_ONCE", 50)
    prefix = "please answer the following question in one word"
    items = [(i, f"{prefix} " + " ".join(f"i{i}w{k}" for k in range(9))) for i in range(120)]
    docs = [(i, f"{prefix} x{i} {prefix}") for i in range(20)] + [(100, "so " + items[7][1]), (101, items[9][1].replace("i9w3", "other")), (100, "nothing")]
    out = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.matched_words) for r in out) == [(100, 7, 17), (101, 9, 16)]
