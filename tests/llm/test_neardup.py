import random
import re

from bibliolith.llm import neardup

DOCS = "doc_id long, text string, n_shingles string, kept string"


def brute(rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for d, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def made(seed, n):
    rnd = random.Random(seed)
    word = lambda: "w%d" % rnd.randrange(5000)
    base = [[word() for _ in range(rnd.randint(1, 150))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 5])):
            w[rnd.randrange(len(w))] = word()
        rows.append((i, " ".join(w), "", ""))
    long = " ".join(word() for _ in range(30_000))
    return rows + [(n, None, None, None), (n + 1, "", "", ""), (n + 2, " \n ", "", ""), (n + 3, "One two", "", ""), (n + 4, "one\ttwo ", "", ""), (n + 5, long, "", ""), (n + 6, long.upper(), "", "")]


def check(spark, rows):
    out = neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out) and len(out) == len(rows)


def test_components_equal_brute_force(spark):
    check(spark, made(1, 150))


def test_clusters_of_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE_SHINGLES", 600)
    monkeypatch.setattr(neardup, "TILE", 7)
    check(spark, made(2, 120))


def test_no_documents(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_one_slot_texts_make_no_large_task(spark, monkeypatch):
    """Many short texts that differ in one word share buckets and sketches without being linked; copies among them still are."""
    monkeypatch.setattr(neardup, "TILE", 64)
    rows = [(i, f"your parcel with number n{i % 390} comes today", "", "") for i in range(400)]
    rows += [(1000 + i, f"a b c d e f g h i j k l m n o p q r s t u v w x y z {'end' if i % 2 else 'stop'} x{i}", "", "") for i in range(200)]
    check(spark, rows)


def test_the_bitmap_keeps_every_id(spark):
    texts = spark.range(5000).selectExpr("id", "cast(id as string) as text")
    ids = spark.range(0, 5000, 7)
    kept = {r.id for r in neardup._sifted(texts, ids).collect()}
    assert kept >= set(range(0, 5000, 7)) and len(kept) < 800
