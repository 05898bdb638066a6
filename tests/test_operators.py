"""Small fixtures with expectations worked out by hand."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from bibliolith.functions import segment, text
from bibliolith.operators import graph, merge, ranking, rules, similar
from bibliolith.operators.components import connected_components
from bibliolith.sources import bibtex, files


def ranks(spark, nodes, edges):
    p = spark.createDataFrame([(n,) for n in nodes], "doi string")
    e = spark.createDataFrame(edges, "citing string, cited string")
    return {r.doi: r["rank"] for r in graph.paper_rank(p, e).collect()}


def test_rank_of_small_graphs(spark):
    assert ranks(spark, "A", []) == {"A": pytest.approx(1.0)}
    chain = ranks(spark, "ABC", [("A", "B"), ("B", "C")])
    assert [round(chain[k], 5) for k in "ABC"] == [0.18442, 0.34117, 0.47441]
    star = ranks(spark, "ABCDH", [(x, "H") for x in "ABCD"])
    assert star["H"] == pytest.approx(0.523809, abs=1e-5) and sum(star.values()) == pytest.approx(1)
    assert ranks(spark, "AB", [("A", "X")])["A"] == pytest.approx(0.5)


def test_rank_of_no_nodes(spark):
    assert ranks(spark, [], []) == {}


def test_components_match_union_find(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(rnd.randrange(100, 400), rnd.randrange(100, 400)) for _ in range(150)] + [(None, 3), (7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_three_tiers_equal_a_sequential_fold(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.choice(["", "d1", "d2", "d3", "d4"]), rnd.choice(["", "t1", "t2", "t3"]), rnd.choice(["", "2001", "2002"]), rnd.choice(["", "a", "b"]), rnd.choice(["", "j"])) for i in range(300)]
    dois, titles, names, want = {"d4"}, set(), set(), []
    for i, d, t, y, s, j in rows:
        if d and d in dois and d == "d4":
            continue
        if d and d in dois:
            continue
        dois |= {d} - {""}
        k = (t, y) if t and y else None
        if k in titles and k:
            continue
        titles |= {k} - {None}
        k = (s, y, j) if s and y and j else None
        if k in names and k:
            continue
        names |= {k} - {None}
        want.append(i)
    df = spark.createDataFrame(rows, "position long, doi string, title string, year string, surname string, journal string")
    got = sorted(r.position for r in merge.three_tier(df, spark.createDataFrame([("d4",)], "doi string")).collect())
    assert got == want


def test_fusion_and_metrics(spark):
    hits = spark.createDataFrame([("q", "notes", "top", 1, "a"), ("q", "meta", "x", 1, "bb"), ("q", "vector", "x", 1, "b"), ("q", "vector", "other", 2, "c")], "query string, channel string, key string, rank long, snippet string")
    got = {r.key: (round(r.rrf, 6), r.source, r.snippet) for r in ranking.rrf(hits, {"notes": 1.0, "meta": 0.5, "vector": 1.0}).collect()}
    assert got == {"x": (0.02459, "vector", "bb"), "top": (0.016393, "notes", "a"), "other": (0.016129, "vector", "c")}
    ranked = spark.createDataFrame([("q", 1, "x"), ("q", 2, "b"), ("q", 3, "y"), ("q", 4, "a")], "query string, rank long, key string")
    wanted = spark.createDataFrame([("q", k, k) for k in "abc"], "query string, item string, key string")
    r = ranking.retrieval_metrics(ranked, wanted).first()
    assert (round(r.recall, 6), r.mrr, round(r.ndcg, 6)) == (0.666667, 0.5, 0.498189)


def test_packing_with_and_without_skips(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 3, 4), ("b", 1, 99)], "g string, o long, c long")
    assert [(r.g, r.o) for r in ranking.pack_skipping(df, "g", "o", "c", 10).orderBy("g", "o").collect()] == [("a", 1), ("a", 3)]
    kept = ranking.within_budget(df, ["g"], [F.col("o")], F.col("c"), 10).orderBy("g", "o").collect()
    assert [(r.g, r.o) for r in kept] == [("a", 1), ("b", 1)]


def test_chunks_cover_and_slice_back():
    rnd = random.Random(1)
    body = "# One\n\n" + " ".join(rnd.choice(["alpha", "beta.", "gamma,", "d$x$"]) for _ in range(900)) + "\n\n## Two\n\n\n# Three\n\nshort text"
    got = segment.chunks(body, 300, 40)
    assert [s for s, _, _ in got if s == "Two"] == [] and got[-1][0] == "Three"
    for _, a, b in got:
        assert 0 < b - a <= 300 and body[a:b] == body[a:b].strip()
    assert segment.boundary_trim("x" * 50, 20) == "x" * 20
    assert segment.chunks("", 10, 2) == []


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    lit = F.lit
    assert one(text.doi(lit(" https://doi.org/10.1/AbC.. "))) == "10.1/abc"
    assert one(text.slug(lit("  A & B -- c! "))) == "a-b-c" and one(text.slug(lit("!!"))) == "unknown"
    assert one(text.journal_key(lit("J. Phys. & Chem."))) == one(text.journal_key(lit("J Phys and Chem")))
    assert one(text.surname(lit("Doe, Jane A."))) == "doe" and one(text.initials(lit("Doe, Jane A."))) == "JA" and one(text.initials(lit("Jane A. Doe"))) == "JA" and one(text.initials(lit("Doe, JA"))) == "JA"
    names = [one(text.dirname(lit(d))) for d in ("10.1000/a_s", "10.1000/a/", "10.1000/A_s", "10.1000_a/s")]
    assert len(set(names)) == 4 and one(text.from_dirname(lit(names[0]))) == "10.1000/a_s"
    sup = one(text.citation_superscripts(lit("x$^{1,2}$ y")))
    assert sup == "x[1,2] y" and one(text.citation_superscripts(lit(sup))) == sup
    assert one(text.latex_flags(lit(r"a $x {"))) == ["odd_dollar", "braces"]
    assert one(text.from_inverted_index(F.create_map(lit("b"), F.array(lit(1)), lit("a"), F.array(lit(0), lit(2))))) == "a b a"


def test_similarity(spark):
    assert similar.lcs_length(list("abcbdab"), list("bdcaba")) == 4
    df = spark.createDataFrame([(1, ["a b c", "x y z", "p q"], ["a b c d", "new text", "p q"])], "id long, left array<string>, right array<string>")
    assert [(r.i, r.j) for r in similar.align(df).orderBy("i").collect()] == [(0, 0), (2, 2)]


def test_rules(spark):
    rs = [
        {"rule_id": "2", "category": "spacing", "level": "builtin", "confidence": 0.9, "pattern_type": "literal", "pattern": "b", "replacement": "c"},
        {"rule_id": "1", "category": "latex", "level": "user", "confidence": 0.5, "pattern_type": "regex", "pattern": "a+", "replacement": "b"},
        {"rule_id": "3", "category": "layout", "level": "user", "confidence": 0.5, "pattern_type": "dict", "pattern": "teh", "replacement": "the"},
    ]
    assert spark.range(1).select(rules.apply_rules(F.lit("aab Teh tehx"), rs).alias("v")).first().v == "cc The tehx"


def test_bibtex(spark, tmp_path):
    (tmp_path / "x.bib").write_text(
        "@comment{no}\n@article{k1, title={A {Nested} Title}, author={Doe, J. and Roe, R.}, doi = {10.1000/A}, year=2020, keywords={x; y},\n cited-references={Foo B, 2001, J X, DOI 10.2000/b. Bar C, 2002, J Y.}}\n"
        '@misc(k2, note="no title")\n@book{k3, title = "Quoted {\\"u} title"}\n@article{broken, title={open'
    )
    rows = bibtex.papers(bibtex.read_bibtex(spark, str(tmp_path))).orderBy("position").collect()
    assert [r.title for r in rows][:2] == ["A Nested Title", 'Quoted \\"u title'] and rows[0].authors == ["Doe, J.", "Roe, R."] and rows[0].keywords == ["x", "y"] and rows[0].year == "2020"
    e = bibtex.reference_edges(bibtex.papers(bibtex.read_bibtex(spark, str(tmp_path)))).collect()
    assert [(x.citing, x.cited) for x in e] == [("10.1000/A", "10.2000/b")]


def test_files(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('# golden\n{"query": "a", "relevant": ["x"]}\n\n{"query": "b", "other": 1}\n')
    assert [(r.query, r.relevant) for r in files.read_jsonl(spark, str(tmp_path / "g.jsonl"), "query string, relevant array<string>").orderBy("query").collect()] == [("a", ["x"]), ("b", None)]
    md = spark.createDataFrame([("p", "# Intro\n\nText one.\n\nFigure 1. cap\n\n## References\n\n[1] x")], "path string, text string")
    assert [(r.section, r.kind, r.in_references) for r in files.markdown_blocks(md).orderBy("position").collect()] == [
        ("Intro", "heading", False), ("Intro", "paragraph", False), ("Intro", "caption", False), ("References", "heading", True), ("References", "paragraph", True)
    ]
    card = files.cards(spark.createDataFrame([("c", '---\ndoi: "10.1/x"\nType: note\n---\nBody\n')], "path string, text string")).first()
    assert card.meta == {"doi": "10.1/x", "type": "note"} and card.body == "Body"


def test_workbook():
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda r, v: f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="JCR 2023" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row>{cell("A1", "Journal")}{cell("C1", "JIF")}</row><row>{cell("A2", "Nature")}{cell("C2", "1,050.5")}</row><row>{cell("A3", "X")}{cell("C3", "-")}</row></sheetData></worksheet>')
    assert files.journal_metrics(out) == [("Nature", 1050.5, "", 2023, "", ""), ("X", 0.0, "", 2023, "", "")]
