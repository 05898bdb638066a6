import random

from bibliolith.llm import sharding

DOCS = "doc_id long, text string, size string"


def least_capacity(sizes, shards):
    for c in range(max(1, -(-sum(sizes) // shards)), sum(sizes) + 1):
        n, used = 1, 0
        for s in sizes:
            if s > c:
                n = shards + 1
            if used + s > c:
                n, used = n + 1, 0
            used += s
        if n <= shards:
            return c


def test_shards_are_minimax_and_keep_groups(spark):
    rnd = random.Random(7)
    texts = ["t%d " % i * rnd.randint(1, 30) for i in range(400)]
    rows = [(i, rnd.choice(texts[: rnd.choice([3, 400])]), "x") for i in range(900)] + [(900, None, "x"), (901, "", "x"), (900, None, "x")]
    out = sharding.shard_documents(spark.createDataFrame(rows, DOCS), 8).toPandas()
    assert len(out) == len(rows) and set(out["law"]) == {"bytes"}
    by_id = dict((i, t) for i, t, _ in rows)
    homes = {}
    for r in out.itertuples():
        assert r.size == len((by_id[r.doc_id] or "").encode()) + 1
        assert homes.setdefault(by_id[r.doc_id], r.shard) == r.shard
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    import hashlib

    sizes = {}
    for _, t, _ in rows:
        k = hashlib.sha256(t.encode()).hexdigest() if t is not None else "0" * 64
        sizes[k] = sizes.get(k, 0) + len((t or "").encode()) + 1
    assert out.groupby("shard")["size"].sum().max() == least_capacity([sizes[k] for k in sorted(sizes)], 8)


def test_few_and_no_documents(spark):
    one = sharding.shard_documents(spark.createDataFrame([(1, "a", "")], DOCS)).collect()
    assert [(r.shard, r.slot) for r in one] == [(0, 0)]
    assert sharding.shard_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_a_group_of_a_third_of_all_bytes_costs_no_long_lists(spark, monkeypatch):
    """The heavy groups are segments of their own, so few rows come to the driver, and the capacity is still the least."""
    rnd = random.Random(5)
    rows = [(i, "y" * rnd.randint(1, 90) + str(i), "") for i in range(3000)] + [(3000 + i, "long " * 300, "") for i in range(60)] + [(4000, "z" * 70_000, "")]
    keyed = spark.createDataFrame(rows, DOCS)
    held = []
    real = sharding.Segment
    monkeypatch.setattr(sharding, "Segment", lambda *a: held.append(1) or real(*a))
    out = sharding.shard_documents(keyed, 4).toPandas()
    import hashlib

    sizes = {}
    for _, t, _ in rows:
        k = hashlib.sha256(t.encode()).hexdigest()
        sizes[k] = sizes.get(k, 0) + len(t) + 1
    assert out.groupby("shard")["size"].sum().max() == least_capacity([sizes[k] for k in sorted(sizes)], 4)
    assert len(held) < 2500 + 4 * 16 * 3
