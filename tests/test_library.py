"""Library, sequence, audit, retrieval and source operators on small fixtures worked out by hand."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from bibliolith import registry
from bibliolith.functions import repair, segment, text
from bibliolith.operators import audit, communities, journals, library, merge, recall, rules, search, sequence, similar
from bibliolith.sources import files


def values(spark, *columns):
    return list(spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first())


def test_identifiers_and_names(spark):
    lit = F.lit
    keys = values(spark, *(text.journal_key(lit(n)) for n in ("Sensors & Actuators B: Chemical", "SENSORS AND ACTUATORS B-CHEMICAL", "材料 科学", "Zeitschrift für Physik")))
    assert keys == ["SENSORSANDACTUATORSBCHEMICAL", "SENSORSANDACTUATORSBCHEMICAL", "材料科学", "ZEITSCHRIFTFÜRPHYSIK"]
    assert values(spark, text.loose_journal_key(lit("Children-Basel")), text.loose_journal_key(lit("Oncology-New York"))) == ["CHILDREN", "ONCOLOGY"]
    assert values(spark, *(text.concept(lit(c)) for c in ("n-p Junction (LIG/CoP_x)", "back-relaxation", "Metals"))) == ["n p junction", "back relaxation", "metals"]
    dois = ("10.1002/adma.202407106", "10.1002/a_b", "10.1002/a/b", "10.1002/a:b")
    names = values(spark, *(text.dirname(lit(d)) for d in dois))
    assert names == ["10.1002_adma.202407106", "10.1002_a__b", "10.1002_a_b", "10.1002_a~b"]
    assert values(spark, *(text.from_dirname(lit(n)) for n in names)) == list(dois)
    odd = values(spark, text.dirname(lit("10.1002/a b")), text.dirname(lit("_global")), text.dirname(lit("")), text.from_dirname(lit("JMADE-D-26-04277_R1_reviewer")), text.from_dirname(lit("_global")))
    assert odd[0].startswith("10.1002_a-b--") and len(odd[0]) == 19 and odd[1:] == ["_global", "paper", "", ""]
    assert values(spark, text.doi_in_text(lit("see https://doi.org/10.1000/xyz.12). More")), text.doi_in_text(lit("none"))) == ["10.1000/xyz.12", ""]
    e = lit("")
    rid = lambda **k: text.resource_key(*(lit(k[n]) if n in k else e for n in ("kind", "doi", "isbn", "cnki", "cstr", "arxiv", "report", "fingerprint", "parent")))
    got = values(spark, rid(doi="10.1002/adma.1"), rid(kind="book", isbn="978 3"), rid(kind="si", parent="doi-10.1"), rid(fingerprint="ABCDEF0123456789"), rid())
    assert got == ["doi-10.1002_adma.1", "book__isbn-978-3", "si__doi-10.1", "nd-abcdef012345", "nd-untitled"]
    assert values(spark, text.joined_words(lit("the electrodeandconductor within")), text.joined_words(lit("Withinness and THERE"))) == [["electrodeandconductor"], ["withinness"]]


def test_trims_and_windows(spark):
    body = "Para one.\n\nPara two is longer, and $x. y$ stays. " + "word " * 60
    for limit in (12, 40, 47, 60, 200, 10_000):
        assert values(spark, segment.trimmed(F.lit(body), limit)) == [segment.boundary_trim(body, limit)]
    assert segment.boundary_trim("abc def; ghi jkl", 12) == "abc def;"
    long = "first line\nsecond line with the anchor here\n" + "tail. " * 300
    (w,) = values(spark, search.match_window(F.lit(long), F.array(F.lit("ANCHOR"), F.lit("anchor")), 100, 20))
    assert w.startswith("tail.") or w.startswith("with the") or "anchor" in w
    assert len(w) <= 100 and w.endswith("tail.")
    assert values(spark, search.match_window(F.lit("short"), F.array(F.lit("zzz")), 100)) == ["short"]
    assert segment.sentences("One. Two! Three is long.", 10) == ["One. Two!", "Three is l", "ong."]


def test_scores_and_rules(spark):
    r = spark.createDataFrame(
        [("1", "x", "regex", "p", "a", "learned", 0.9, 1, 5, ["e1"]), ("2", "x", "regex", "p", "b", "builtin", 0.5, 1, 2, ["e2"]), ("3", "x", "regex", "p", "b", "learned", 0.9, 1, 3, ["e3"]), ("4", "x", "regex", "q", "a", "user", 0.1, 1, 1, [])],
        "rule_id string, category string, pattern_type string, pattern string, replacement string, level string, confidence double, version int, hits long, evidence array<string>",
    )
    got = {x.pattern: (x.rule_id, x.replacement, x.hits, x.evidence, x.dropped) for x in rules.merge_rules(r).collect()}
    assert got == {"p": ("2", "b", 5, ["e2", "e3"], ["1"]), "q": ("4", "a", 1, [], [])}
    store = spark.createDataFrame([("d1", "", 0), ("d2", "kept", 4)], "doi string, title string, cites long")
    more = spark.createDataFrame([("d1", "", 7, 1), ("d1", "second", 9, 2), ("d2", "new", 1, 3)], "doi string, title string, cites long, position long")
    assert sorted(map(tuple, merge.absorb(store, more, "doi", ["title", "cites"]).collect())) == [("d1", "second", 7), ("d2", "kept", 4)]


def test_readings_are_verified(spark):
    same = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(1, same, same), (2, same, "again and again dog lazy the over jumps fox brown quick the"), (3, same, ""), (4, same, "the quick brown fox jumps over a sleepy cat some more"), (5, "the quick brown fox one two three four", "the quick brown fox four three two one"), (6, same, "in addition we find that none of these is so")]
    got = {r.id: r.verdict for r in similar.verify_pairs(spark.createDataFrame(rows, "id long, left string, right string")).collect()}
    assert got == {1: "ok", 2: "suspicious", 3: "suspicious", 4: "suspicious", 5: "suspicious", 6: "misaligned"}


def test_anomalies(spark):
    rows = [("d", 1, "bad � sign and �", False), ("d", 2, "�", True), ("d", 3, "gas $\\Nu _ { 2 }$ here", False)] + [("e", k, "�", False) for k in range(60)]
    got = text.anomalies(spark.createDataFrame(rows, "doc_id string, para long, text string, is_heading boolean")).collect()
    assert sorted((r.para, r.sentence) for r in got if r.doc_id == "d") == [(1, "bad � sign and �"), (3, "gas $\\Nu _ { 2 }$ here")] and sum(r.doc_id == "e" for r in got) == 50


def test_names_and_hits(spark):
    papers = spark.createDataFrame([("d", ["Zhang, Y; Wang, JH (Corresponding Author), Tsinghua, X", "Other block", "Wang, JH (Corresponding Author), B"], ["Wang, Jian-Hua", "Zhang, Yi", "Wang, Li"])], "doi string, affiliations array<string>, authors array<string>")
    assert journals.corresponding_authors(papers).first().corresponding == ["Zhang, Yi", "Wang, Jian-Hua"]


def test_sequences(spark):
    rows = spark.createDataFrame([("d", k, n) for k, n in enumerate((50, 60, 500, 10, 10, 10))], "d string, k long, n long")
    assert [r.batch for r in sequence.batches(rows, "d", "k", "n", 2, 120).orderBy("k").collect()] == [0, 0, 1, 2, 2, 3]
    block = lambda n, x, y, w: ("d", 1, n, float(x), float(y), float(x + w), float(y + 5), 600.0)
    blocks = [block(k, 20, 100 + 20 * k, 200) for k in range(4)] + [block(10 + k, 330, 100 + 20 * k, 200) for k in range(4)] + [block(20, 10, 50, 580), block(21, 10, 130, 580), block(22, 10, 900, 580)]
    df = spark.createDataFrame(blocks, "doc_id string, page long, block long, x0 double, y0 double, x1 double, y1 double, width double")
    assert [r.block for r in sequence.reading_order(df).orderBy("nth").collect()] == [20, 0, 1, 21, 2, 3, 10, 11, 12, 13, 22]
    p = spark.createDataFrame([("d", 0, "It goes"), ("d", 1, "on and com-"), ("d", 2, "pletes."), ("d", 3, "new one")], "doc_id string, idx long, text string")
    assert [r.text for r in sequence.stitched(p).orderBy("first").collect()] == ["It goes on and completes.", "new one"]
    b = spark.createDataFrame([("d", 1, "stray [1] One"), ("d", 2, "goes on [2] Two"), ("d", 3, "Downloaded from x"), ("d", 4, "[3] Three")], "doc_id string, nth long, text string")
    assert [(r.number, r.text) for r in sequence.references(b).orderBy("number").collect()] == [(1, "[1] One goes on"), (2, "[2] Two"), (3, "[3] Three")]
    lines = ["Intro words here", "the first paragraph starts with", "these lines and ends here now", "a second paragraph then follows", "until it ends with this line"]
    paragraphs = ["The first paragraph starts with these lines and ends here now", "A second paragraph then follows until it ends with this line", "too short"]
    got = sequence.anchor(spark.createDataFrame([("d", paragraphs, lines)], "id string, paragraphs array<string>, lines array<string>")).orderBy("paragraph").collect()
    assert [(r.paragraph, r.first_line, r.last_line) for r in got] == [(0, 1, 2), (1, 3, 4)] and all(r.score == 1 for r in got)


def test_near_paragraphs_keep_the_first_or_the_abstract(spark):
    a, b = "alpha beta gamma delta " * 12, "other words are used in this one here " * 8
    rows = [("d", 0, a, "Intro", False), ("d", 1, b, "Body", False), ("d", 2, a, "Abstract", False), ("d", 3, b + "extra", "Body", False), ("d", 4, "short", "Body", False), ("d", 5, a, "End", False)]
    got = {r.idx: (r.kept, r.duplicate_of) for r in audit.near_paragraphs(spark.createDataFrame(rows, "doc_id string, idx long, text string, section string, is_heading boolean")).collect()}
    assert got == {0: (False, 2), 1: (True, None), 2: (True, None), 3: (False, 1), 5: (False, 2)}


def test_repairs(spark):
    assert repair.balanced(r"$\mathrm{Co(O_{x})$ and $a}$ and $x_{1}}$") == r"$\mathrm{Co(O_{x})}$ and $a}$ and $x_{1}$"
    assert repair.unbalanced(r"$\mathrm{a$ $b$") == [r"\mathrm{a"]
    assert [k for k, _ in repair.syntax_errors(r"\begin{a} $x \foo } \end{b}", frozenset({"begin", "end"}))] == ["unknown_command", "unclosed_math", "unmatched_brace", "unmatched_env"]
    assert values(spark, repair.normalized(F.lit("Eﬃcient $\\mathrm{Co}$ 1 5 0 é")), repair.normalized_words(F.lit("a $1 5 0$ b"))) == ["efficientco150e", "a 150 b"]
    assert values(spark, repair.domain_fixes(F.lit("CoOx and CoOxy and H2O"), {"CoOx": "$CoO_x$"})) == ["$CoO_x$ and CoOxy and H2O"]
    kinds = values(spark, *(repair.line_kind(F.lit(t), F.lit(2), F.lit(10.0), F.lit(10.0)) for t in ("a@b.org", "Fig. 1. A cap", "2.1 Methods", "Plain text here.", "RESEARCH ARTICLE", "Figure 3 shows it", "")))
    assert kinds == ["meta", "caption", "heading", "body", "meta", "body", "other"]
    md = "# A Title\n\nJane Doe, Max Roe, and Ann Lee\n\nUniversity of X\n\nKeywords: a; b\n\n1 text"
    f = values(spark, *repair.front_matter(F.lit(md)).values())
    assert f == ["A Title", ["Jane Doe", "Max Roe", "Ann Lee"], ["University of X"], ["a", "b"]]
    s = dict(zip(("images", "noise", "suspicious", "ok"), values(spark, *repair.structure(F.lit("# 1 Intro\n![x](y)\n# abstract\nAvailable online 3 May")).values()), strict=True))
    assert s == {"images": 1, "noise": 1, "suspicious": 1, "ok": False}


def test_votes_and_scorecards(spark):
    page = "The measured conductivity of the sample was 480 nm thick and stable for many days. " * 4
    got = values(spark, audit.vote(F.lit("conductivity of the"), F.lit("conductlvity of the"), F.lit(page)), audit.vote(F.lit("ab"), F.lit("cd"), F.lit(page)), audit.vote(F.lit("of conductivity the x"), F.lit("zzz of nothing here"), F.lit(page)))
    assert got == ["first", "unknown", "neither"]
    assert values(spark, audit.unverified(F.lit("has 480 nm and 999 km"), F.lit(page))) == [["999km"]]
    cards = audit.scorecard(spark.createDataFrame([(1, "# A\n$x$ $x$ $y$\n# B", "# A\n$x$ $z$"), (2, None, "fine � $a")], "id long, gold string, text string"))
    got = {r.id: (r.formula_mismatch, r.heading_edits, r.garbled, r.latex) for r in cards.collect()}
    assert got == {1: (3, 1, 0, 0), 2: (0, 0, 1, 1)}
    e = audit.char_edits(spark.createDataFrame([(1, "Eficient", "Efficient")], "id long, left string, right string")).collect()
    assert [(x.op, x.left_from, x.left_to, x.right_from, x.right_to) for x in e] in ([("insert", 2, 2, 2, 3)], [("insert", 1, 1, 1, 2)])


def test_staged_search_of_notes(spark):
    notes = spark.createDataFrame([("d1", "_note.md", "graphene oxide layers"), ("d2", "_note.md", "oxide only"), ("d3", "_note.md", "本文的创新点在于材料"), ("d4", "_note.md", "文献综述与创新")], "doi string, file string, content string")
    q = spark.createDataFrame([(1, "graphene oxide"), (2, "missing oxide"), (3, "创新点 材料"), (4, "这篇文献的贡献"), (5, "ab")], "query_id long, query string")
    got = {}
    for r in recall.search_notes(notes, q).collect():
        got.setdefault(r.query_id, []).append((r.stage, r.doi))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(1, "d1")], 2: [(2, "d1"), (2, "d2")], 3: [(2, "d3")], 4: [(5, "d4")]}
    assert [r.doi for r in recall.search_notes(notes, q, doi="d2").where("query_id = 2").collect()] == ["d2"]


def test_communities_of_two_cliques(spark):
    clique = lambda lo: [(a, b, 1.0) for a in range(lo, lo + 4) for b in range(a + 1, lo + 4)]
    edges = spark.createDataFrame([*clique(0), *clique(10), (3, 10, 1.0), (5, 5, 1.0)], "src long, dst long, weight double")
    assert {r.node: r.community for r in communities.communities(edges, 4, 2).collect()} == {**dict.fromkeys(range(4), 0), **dict.fromkeys(range(10, 14), 10)}
    assert communities.cluster(edges.limit(0).toDF("a", "b", "weight"))[1] == "none"


def test_fetched_records_and_files(spark, tmp_path):
    w = spark.createDataFrame(
        [("10.1/A", [" T "], ["J"], ["1-1", "2-2"], None, [[2020, 5]], [[2019]], 7, "<p>Abstract: Text</p>", [("A", "B"), (None, "C"), (None, None)], "article")],
        "doi string, title array<string>, container_title array<string>, issn array<string>, published_print array<array<int>>, published_online array<array<int>>, issued array<array<int>>, cited_by int, abstract string, author array<struct<given:string,family:string>>, type string",
    )
    r = files.crossref(w).first()
    assert (r.doi, r.title, r.journal, r.issn, r.eissn, r.year, r.times_cited, r.abstract, r.authors) == ("10.1/a", "T", "J", "1-1", "2-2", "2020", 7, "Text", ["A B", "C"])
    s = spark.createDataFrame([("10.2/b", "T", "abs", None, [("A", ["X", "Y"]), ("B", ["X"])], "V", "", 2021, 3, "p")], "doi string, title string, abstract string, tldr string, authors array<struct<name:string,affiliations:array<string>>>, venue string, journal string, year int, citation_count int, paper_id string")
    r = files.semantic_scholar(s).first()
    assert (r.authors, r.affiliations, r.journal, r.tldr) == (["A", "B"], ["X", "Y"], "V", "")
    (tmp_path / "c.json").write_text(json.dumps([{"type": "text", "text": "Hi", "bbox": [1, 2, 3, 4], "page_idx": 1, "text_level": 1}, {"type": "", "text": ""}, {"type": "image", "bbox": []}]))
    assert [(i.idx, i.page, i.x0, i.y1, i.type, i.text) for i in files.layout_items(spark, str(tmp_path / "c.json")).orderBy("idx").collect()] == [(0, 2, 1.0, 4.0, "text", "Hi"), (2, 1, 0.0, 0.0, "image", "")]
    rs = spark.createDataFrame([("r1", "spacing", "user", "regex", "a", "b", 0.9, 1, True, 1, ["e"]), ("r2", "spacing", "user", "regex", "c", "d", 0.9, 1, True, 1, [])], files.RULE)
    files.write_rules(rs, str(tmp_path / "rules"))
    new, no = files.read_rules(spark, str(tmp_path / "rules"), spark.createDataFrame([("r1",)], "rule_id string"))
    assert [x.rule_id for x in new.collect()] == ["r2"] and [tuple(x) for x in no.collect()] == [("r1", "exists")]
    md = files.render_markdown(spark.createDataFrame([("d", 1, "Text", 0), ("d", 0, "Head", 2)], "doc_id string, idx long, text string, level int")).first()
    assert md.markdown == "## Head\n\nText"
    counts = files.import_counts(spark.createDataFrame([("d1", "t"), ("d1", "t"), ("", ""), ("", "u"), ("k", "")], "doi string, title string"), spark.createDataFrame([("k",)], "doi string")).first()
    assert tuple(counts) == (5, 1, 1, 2)


def test_zone_sheets():
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda r, v: f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="2024" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        rows = (("Heading",), ("期刊名称", "2024分区", "Top"), ("Nature", "1区", "是"), ("", "2区", ""))
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>" + "".join("<row>" + "".join(cell(f"{'ABC'[k]}{n}", v) for k, v in enumerate(r)) + "</row>" for n, r in enumerate(rows, 1)) + "</sheetData></worksheet>")
    assert files.journal_zones(out) == [("Nature", "1", "是", 2024, "")]


def test_registry_and_retries(spark):
    seen = []
    r = registry.Registry({"one": lambda s, d: s.range(1)})
    r.register(spark, registry.Plugin("p", functions={"twice_": (lambda x: 2 * x, "long")}, queries={"two": lambda s, d: s.sql("select twice_(2) as x")}, on_register=seen.append))
    assert sorted(r.tools()) == ["one", "two"] and r.call("two", spark, "").first().x == 4 and seen == [spark]
    r.enable("p", False)
    assert sorted(r.tools()) == ["one"]
    done, rounds = registry.retried(lambda open_: open_.where("id % 3 < 2 or id < 0").limit(4), spark.range(9), "id")
    assert {x.id % 3 for x in done.collect()} == {0, 1} and done.count() == 6 and rounds == 3
    t = registry.recover(spark.createDataFrame([("a", "running", 0), ("b", "done", 1)], "id string, status string, tries int"))
    assert sorted(map(tuple, t.collect())) == [("a", "queued", 1), ("b", "done", 1)]
    assert registry.VectorIndex().search(spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>"), 3).count() == 0


def test_library_view_of_folders(spark):
    f = library.LibraryFilter(journal="x", status="l1", year_from=2000)
    assert "on_disk" in str(f.condition()) and library.page_of(spark.range(500), [F.col("id")], 0, 1000).count() == 200


def test_upserts_by_part(spark, tmp_path):
    from bibliolith.streaming import events

    write = events.upsert_batches(str(tmp_path / "t"), "k", "version")
    first = spark.createDataFrame([(k, 1, "a") for k in range(200)], "k long, version long, x string")
    second = spark.createDataFrame([(5, 2, "b"), (5, 0, "c"), (900, 1, "d")], first.schema)
    write(first, 0)
    write(second, 1)
    write(second, 1)
    got = {r.k: (r.version, r.x) for r in events.read_upserted(spark, str(tmp_path / "t"), first.schema).collect()}
    assert len(got) == 201 and got[5] == (2, "b") and got[900] == (1, "d") and got[7] == (1, "a")
    assert len(list((tmp_path / "t" / "v=1").glob("part=*"))) <= 2
    assert events.read_upserted(spark, str(tmp_path / "none"), first.schema).count() == 0
