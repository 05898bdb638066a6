"""Results that must hold whole and the same at any size or order of rows."""

import os
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bibliolith.operators import audit, graph, journals, search, similar, vector
from bibliolith.plans import sequence_queries

DATA = Path(os.environ.get("TESTDATA", "/root/testdata")) / "sf0.01"


def most_rows(plan):
    """The most rows that an operator of a plan that has run put out."""
    nodes, most = [plan], 0
    while nodes:
        p = nodes.pop()
        if p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        kind = p.getClass().getSimpleName()
        nodes += [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else []
        nodes += [p.children().apply(i) for i in range(p.children().size())]
    return most


def test_bm25_adds_up_the_same_in_any_order(spark, tmp_path):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(8)]
    same = " ".join(w for i, w in enumerate(words) for _ in range(i + 1))
    docs = [(i, same) for i in range(300)] + [(1000 + i, " ".join(rnd.choice([*words, *(f"v{j}" for j in range(20))]) for _ in range(12))) for i in range(900)]
    q = spark.createDataFrame([(1, " ".join(words))], "query_id long, query string")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    q.write.parquet(f"{tmp_path}/q")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = search.bm25(spark.read.parquet(f"{tmp_path}/d"), spark.read.parquet(f"{tmp_path}/q"), k=None).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len({r.score for r in got if r.doc_id < 300}) == 1


def test_bm25_takes_every_word_of_a_query(spark):
    docs = spark.createDataFrame([(1, "zebra"), (2, "one two"), (3, "other"), (4, "words"), (5, "more")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "one two three four five six seven eight nine zebra")], "query_id long, query string")
    assert {r.doc_id: r.hits for r in search.bm25(docs, q).collect()} == {1: 1, 2: 2}
    assert {r.doc_id for r in search.staged(docs, q).collect()} == {2}


def test_cluster_peers_meet_the_head_of_a_cluster_only(spark):
    rows = [(str(i), i % 3, float(i % 40)) for i in range(600)] + [("597", 0, 99.0)] * 7
    p = spark.createDataFrame(rows, "doi string, cluster long, paper_rank double")
    seeds = p.where("doi % 2 = 1").select("doi").distinct()
    r = graph.cluster_peers(p, seeds, 5)
    want = []
    for seed in sorted({(d, c) for d, c, _ in rows if c > 0 and int(d) % 2}):
        best = sorted((-x, d) for d, c, x in rows if c == seed[1] and d != seed[0])[:5]
        want += [(seed[0], n, d) for n, (_, d) in enumerate(best, 1)]
    assert sorted(map(tuple, r.collect())) == sorted(want)
    assert "WindowGroupLimit" in r._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[-1]


def test_titles_of_many_copies_meet_once(spark):
    rnd = random.Random(5)
    names = ["".join(rnd.choice("ab ") for _ in range(rnd.randrange(1, 22))) for _ in range(150)]
    known = [(i, f"d{i}", rnd.choice(names).upper() if i % 3 else "a common beginning " + rnd.choice(names)) for i in range(400)] + [(1000 + i, f"c{i}", "Same  title") for i in range(3000)]
    wanted = [(i, rnd.choice(names)[: rnd.randrange(1, 22)] if i % 2 else "a common beginning " + rnd.choice(names)) for i in range(200)] + [(1000 + i, "same title, revisited") for i in range(3000)]
    clean = lambda t: " ".join(t.lower().split())
    want = {}
    for i, t in wanted[:201]:
        fit = [(p, d) for p, d, n in known if clean(t) and clean(n) and (clean(t).startswith(clean(n)) or clean(n).startswith(clean(t)))]
        want.update({i: min(fit)[1]} if fit else {})
    want.update({i: want[1000] for i, _ in wanted[200:]})
    r = journals.match_titles(spark.createDataFrame(wanted, "query_id long, title string"), spark.createDataFrame(known, "position long, doi string, title string"))
    assert {x.query_id: x.doi for x in r.collect()} == want
    plan = r._jdf.queryExecution().executedPlan()
    assert most_rows(plan) < 100_000


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_community_weights_are_counted_before_the_join(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(sequence_queries.communities, "cluster", lambda pairs, **k: seen.append(pairs) or (spark.range(1).withColumnRenamed("id", "community"), ""))
    sequence_queries.community_sizes(spark, str(DATA))
    got = sorted(map(tuple, seen[0].collect()))
    want = duckdb.sql(f"SELECT c_nationkey, s_nationkey, count(*) FROM '{DATA}/customer.parquet' JOIN '{DATA}/supplier.parquet' ON c_custkey % 25 = s_suppkey % 25 GROUP BY 1, 2").fetchall()
    assert got == sorted(want) and dict(seen[0].dtypes)["weight"] == "bigint"
    assert most_rows(seen[0]._jdf.queryExecution().executedPlan()) < sum(n for _, _, n in want)


def test_nearest_sifts_by_products_and_scores_exactly(spark):
    rnd = random.Random(6)
    rows = [(i, [rnd.choice([-1.0, 0.5, 2.0]) for _ in range(6)]) for i in range(700)] + [(1000 + i, [1.0, 2.0, 0.5, 0.5, 2.0, 1.0]) for i in range(300)] + [(2000, [1.0]), (2001, None), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    e = v.select("vec_id", vector.normalised(F.col("embedding")).alias("v"))
    pairs = e.join(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", vector.dot(F.col("v"), F.col("q")).alias("score"))
    want = pairs.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where("nth <= 9")
    r = vector.nearest(v, q, 9, most_queries=4)
    order = ["query_id", "nth", "vec_id", "score"]
    assert sorted(map(tuple, r.select(*order).collect()), key=repr) == sorted(map(tuple, want.select(*order).collect()), key=repr)
    assert most_rows(r._jdf.queryExecution().executedPlan()) < 5 * 1003


def test_a_vectors_length_is_added_up_once(spark):
    v = spark.createDataFrame([(1, [3.0, None, 4.0]), (2, [3.0, 4.0]), (3, [0.0, 0.0]), (4, []), (5, None)], "i int, v array<float>").select("i", vector.normalised(F.col("v")).alias("v"))
    assert [r.v for r in v.orderBy("i").collect()] == [[3.0, None, 4.0], [0.6, 0.8], [0.0, 0.0], [], None]
    assert v._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_nearest_with_copies_near_copies_and_nan(spark):
    rnd = random.Random(7)
    base = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(6)] + [[0.0] * 8]
    rows = [(i, rnd.choice(base)) for i in range(900)] + [(i, [x + rnd.choice([0, 1e-7, -1e-7, 1e-6]) for x in base[i % 6]]) for i in range(900, 1200)] + [(i, [float("nan")] * 8) for i in (350, 1201, 1202)]
    v = spark.createDataFrame(dict(rows).items(), "vec_id long, embedding array<double>").repartition(5)
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    e = v.select("vec_id", vector.normalised(F.col("embedding")).alias("v"))
    pairs = e.join(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", vector.dot(F.col("v"), F.col("q")).alias("score"))
    order = ["query_id", "nth", "vec_id", "score"]
    for k in (2, 9):
        want = pairs.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("nth") <= k)
        assert sorted(map(repr, map(tuple, vector.nearest(v, q, k).select(*order).collect()))) == sorted(map(repr, map(tuple, want.select(*order).collect())))


def test_nearest_looks_at_few_rows_of_equal_vectors():
    keys, vectors = np.arange(5_000)[::-1], np.array([[1.0, 0.0], [0.0, 1.0]] * 2_500)
    stay, some = vector._few_copies(keys, vectors, 3)
    assert sorted(stay.tolist()) == list(range(8)) and sorted(some.tolist()) == [[0.0, 1.0]] * 4 + [[1.0, 0.0]] * 4


def test_dice_pairs_lose_no_link_and_expand_no_copies(spark):
    rnd = random.Random(8)
    docs = []
    for i in range(60):
        words = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([5, 12, 30, 80]))]
        for _ in range(rnd.randrange(1, 5)):
            docs.append((len(docs), " ".join(w if rnd.random() > 0.04 else f"x{rnd.randrange(99)}" for w in words)))
    docs += [(len(docs) + i, "the same words here") for i in range(200)] + [(5000, "")]
    sets = {i: frozenset(t.split()) for i, t in docs}
    first = {}
    for i, s in sorted(sets.items()):
        first.setdefault(s, i)
    value = lambda s, t: 2 * len(s & t) / (len(s) + len(t))
    for least in (0.9, 0.6):
        want = {(a, b): value(s, t) for s, a in first.items() for t, b in first.items() if s and t and a < b and value(s, t) >= least}
        want |= {(first[s], i): 1.0 for i, s in sets.items() if s and first[s] < i}
        got = similar.dice_pairs(spark.createDataFrame(docs, "doc_id long, text string"), F.filter(F.split("text", " "), lambda w: w != ""), least)
        assert {(r.a, r.b): r.dice for r in got.collect()} == want and len(want) > 250


def test_near_paragraphs_compare_alike_ones_only(spark, monkeypatch):
    rnd = random.Random(9)
    rows = []
    for i in range(240):
        t = rows[-rnd.randrange(1, 1 + min(9, len(rows)))][2].split(" ") if rows and rnd.random() < 0.7 else [f"word{rnd.randrange(900)}" for _ in range(45)]
        t = [w if rnd.random() > 0.02 else f"x{rnd.randrange(99)}" for w in t] if rnd.random() < 0.6 else t
        rows.append((f"d{i % 2}", i, " ".join(t), rnd.choice(["Abstract", "", "Body"]), False))
    want, seen = {}, []
    for doc in ("d0", "d1"):
        kept, gone = [], {}
        for _, i, t, section, _ in (r for r in rows if r[0] == doc):
            words = set(t.split())
            at = next((k for k, (o, _) in enumerate(kept) if o == t), None)
            alike = next((j for o, j in kept if 2 * len(words & set(o.split())) / (len(words) + len(set(o.split()))) >= 0.9), None)
            if at is not None:
                loser, kept[at] = (kept[at][1], (t, i)) if section == "Abstract" else (i, kept[at])
                gone[loser] = kept[at][1]
            elif alike is None:
                kept.append((t, i))
            else:
                gone[i] = alike
        want.update({i: (i not in gone, gone.get(i)) for d, i, *_ in rows if d == doc})
    real = audit.dice_sets
    monkeypatch.setattr(audit, "dice_sets", lambda *a: seen.append(a) or real(*a))
    got = audit.near_paragraphs(spark.createDataFrame(rows, "doc_id string, idx long, text string, section string, is_heading boolean"))
    assert {r.idx: (r.kept, r.duplicate_of) for r in got.collect()} == want and len(seen) == 1


def test_shared_concepts_meet_by_pairs_of_concepts(spark):
    rnd = random.Random(10)
    docs = {f"d{i}": {f"c{rnd.randrange(25)}" for _ in range(rnd.randrange(1, 5))} for i in range(500)}
    rows = [(d, c) for d, cs in docs.items() for c in cs] + [(None, "c1"), ("d1", None)]
    r = journals.shared_concepts(spark.createDataFrame(rows, "doi string, name string"), 2)
    want = {(a, b): sorted(s & t) for a, s in docs.items() for b, t in docs.items() if a < b and len(s & t) >= 2}
    assert {(x.a, x.b): x.shared for x in r.collect()} == want
    assert most_rows(r._jdf.queryExecution().executedPlan()) < 2 * len(want)
