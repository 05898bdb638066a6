import random

import pytest
from pyspark.sql import functions as F

from bibliolith.llm import decontam, hamming, htmltext, quality, secrets


def test_decontamination_tolerates_substitutions(spark):
    rnd = random.Random(3)
    word = lambda: "w%d" % rnd.randrange(3000)
    items = [(i, " ".join(word() for _ in range(n)), "x") for i, n in enumerate([40, 30, 25, 20, 7])] + [(5, None, None), (6, "", ""), (7, "a b", "")]
    noise = lambda n: " ".join(word() for _ in range(n))
    changed = items[0][1].split()
    for k in (4, 11, 18, 25, 32, 38):
        changed[k] = "zzz"
    docs = [
        (1, f"{noise(50)} {' '.join(changed).upper()}! {noise(20)}", ""), (2, noise(300), ""), (3, f"{noise(5)}, {items[1][1].replace(' ', ', ')}", ""), (4, None, ""), (5, "", ""),
        (6, items[4][1], ""), (7, f"{items[2][1]} {noise(3000)} {items[3][1]}", ""), (8, " ".join(items[1][1].split()[:9]), ""), (3, items[1][1], ""),
    ]
    out = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string, doc_id string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in out) == [(1, 0), (3, 1), (3, 1), (6, 4), (7, 2), (7, 3)]
    assert {r.matched_words for r in out if r.doc_id == 1} == {33}  # the last word alone does not outweigh the change before it
    assert decontam.contaminated(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string, doc_id string")).count() == 0
    assert decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string, x string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_several_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 300)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(15))) for i in range(12)]
    docs = spark.createDataFrame([(i, "x " + t) for i, t in items], "doc_id long, text string")
    out = decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in out) == [(i, i) for i in range(12)]


def test_hamming_equals_brute_force(spark):
    rnd = random.Random(4)
    centres = [rnd.getrandbits(64) for _ in range(5)]
    codes = [rnd.choice(centres) ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 3))) for _ in range(300)] + [centres[0]] * 60
    signed = [(c & (2**64 - 1)) - (2**64 if c & (2**64 - 1) >> 63 << 63 else 0) for c in codes]
    rows = list(enumerate(signed)) + [(400, None), (None, 5), (7, signed[7])]
    df = spark.createDataFrame(rows, "vec_id long, code long")
    out = hamming.top_k(df, df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "code"), 10).collect()
    want = []
    for q in range(0, 360, 50):
        near = sorted((bin((signed[q] ^ c) & (2**64 - 1)).count("1"), i) for i, c in enumerate(signed))[:10]
        want += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.distance) for r in out) == want
    few = spark.createDataFrame([(1, 3), (2, 5)], "vec_id long, code long")
    got = hamming.top_k(few, few.select(F.col("vec_id").alias("query_id"), "code"), 10).collect()
    assert sorted((r.query_id, r.vec_id, r.distance) for r in got) == [(1, 1, 0), (1, 2, 2), (2, 1, 2), (2, 2, 0)]
    code = spark.createDataFrame([([1.0, -1.0] + [1.0] * 62,), (None,), ([],)], "v array<float>").select(hamming.sign_code(F.col("v")).alias("c")).collect()
    assert [r.c for r in code] == [-3, 0, 0]


def test_quality_on_held_out_rows(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9)))
    rows = []
    for i in range(600):
        w = [word() for _ in range(rnd.randint(5, 80))]
        good = i % 4 != 0
        rows.append((i, (" ".join(w) + ".") if good else rnd.choice([" | ".join(w), "!! ".join(w).upper() + "!!", " ".join([w[0]] * 60)]), int(good), "k"))
    docs = spark.createDataFrame([(i, t, s) for i, t, _, s in rows] + [(600, None, None), (601, "", "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q, _ in rows] + [(5000, 1), (1, None)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.score_documents(docs, quality.fit(docs, labels)).withColumn("held", quality.held_out(F.col("doc_id"))).collect()}
    assert len(out) == 602 and all(0 <= r.score <= 1 for r in out.values())
    held = [(out[i].predicted, q) for i, _, q, _ in rows if out[i].held]
    assert len(held) > 80 and sum(a == b for a, b in held) / len(held) > 0.95
    constant = quality.fit(docs, labels.where("quality = 1"))
    assert {r.predicted for r in quality.score_documents(docs, constant).collect()} == {1}
    assert quality.score_documents(docs.limit(0), constant).count() == 0


def test_secrets_against_their_labels(spark):
    findings = secrets.labelled_findings(spark, 3000)
    forest = secrets.fit(findings.where("pmod(xxhash64(value, before), 4) > 0"))
    text = findings.where("pmod(xxhash64(value, before), 4) = 0 and length(value) >= 16 and value rlike '[0-9]' and not value rlike '[^A-Za-z0-9_+/=.-]'")
    docs = text.select(F.monotonically_increasing_id().alias("doc_id"), F.concat(F.lit("Some words, "), "before", "value", F.lit(" end.")).alias("text"), F.col("path").alias("source"), "label", F.lit("x").alias("start"))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    out = secrets.scan(docs, forest).groupBy("doc_id").agg(F.max(F.col("secret").cast("int")).alias("secret"))
    good = docs.join(out, "doc_id").agg(F.avg((F.col("label") == F.col("secret")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert good.n > 300 and good.a > 0.85
    odd = spark.createDataFrame([(1, None, None), (2, "", ""), (3, 'token = "' + "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" + '"', None), (4, "é " * 9000, "a")], "doc_id long, text string, source string")
    r = secrets.scan(odd, forest).collect()
    assert [(x.doc_id, x.start, x.end, x.secret) for x in r] == [(3, 9, 49, True)]


PAGE = '<html><head><title>x</title></head><body><div class="top"><p>Menu of site</p></div><div class="story"><p>{a}</p><p>{b}</p></div><div class="end"><p>All rights</p></div></body></html>'


def test_html(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(a=f"Text &amp; number {i} of\n many", b=f"more<br>{i * 7}"), "x") for i in range(12)]
    rows += [(100, "http://one.example/a", "<body><nav>n</nav><article><h1>T</h1><p>A <b>b<br><p>C &lt;d&gt; &copy;<aside>no</aside><div class='comments'>c</div></article><footer>f</footer>", "x")]
    rows += [(101, None, None, None), (102, "x", "", ""), (103, "http://z", "just text", ""), (104, "http://z", "<p", ""), (100, "http://one.example/a", "<p>twice</p>", "")]
    out = {(r.page_id, r.text): r.n_chars for r in htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    want = {(i, f"Text & number {i} of many\n\nmore {i * 7}") for i in range(12)} | {(100, "T\n\nA b\n\nC <d> ©"), (101, ""), (102, ""), (103, "just text"), (104, ""), (100, "twice")}
    assert set(out) == want and all(n == len(t) for (_, t), n in out.items())
    assert htmltext.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("page,text", [("a < b &amp; c", "a < b & c"), ("<script>var t='</p>';x</script>y", "y"), ("<!-- <p>no</p> -->y", "y"), ('<p title="a>b">q</p', "q"), ("<form>f</form><p>x  y</p>", "x y")])
def test_main_text(page, text):
    assert htmltext.main_text(page, frozenset()) == text
