import random

from pyspark.sql import functions as F

from bibliolith.llm import htmltext

ARTICLE = "<body><article><h1>Title {i}</h1><p>Story {i} of its day.</p><p>Read it in our app.</p><div><p>All about us</p></div><p>Its end {i}.</p></article></body>"
TEASERS = "<body><div class='story'><h2>Head {i}</h2><p>The story {i} itself.</p></div><article><p>Teaser {i}</p></article></body>"
COPIES = "<body><article><h1>Same</h1><p>The same text.</p></article></body>"


def test_template_decides_inside_articles_and_outside(spark):
    rows = [(i, f"http://a.example/{i}", ARTICLE.format(i=i)) for i in range(10)]
    rows += [(100 + i, f"http://b.example/{i}", TEASERS.format(i=i)) for i in range(10)] + [(200, "http://one.example/", TEASERS.format(i=1))]
    rows += [(300 + i, f"http://c.example/{i}", COPIES) for i in range(8)]
    out = {r.page_id: r.text for r in htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i] == f"Title {i}\n\nStory {i} of its day.\n\nIts end {i}." for i in range(10))
    assert all(out[100 + i] == f"Head {i}\n\nThe story {i} itself.\n\nTeaser {i}" for i in range(10))
    assert out[200] == "Head 1\n\nThe story 1 itself.\n\nTeaser 1"
    assert all(out[300 + i] == "Same\n\nThe same text." for i in range(8))


def test_names_are_whole_and_never_remove_the_article():
    text = "The story of the day, long enough to be most of the page."
    for name in ("layout has-sidebar", "page no-sidebar", "site header-fixed", "social-science", "widget", "sidebar"):
        assert htmltext.main_text(f"<body><div class='{name}'><article class='post comments-open'><p>{text}</p></article></div></body>", frozenset()) == text
        assert htmltext.main_text(f"<body><div class='{name}'><p>{text}</p></div><div class='ad'>Buy</div></body>", frozenset()) == text
    page = f"<div class='related'><article>Other</article></div><div id='social'><main><p>{text}</p><div class='x share'>Share</div></main></div><p class='ad'>Buy</p>"
    assert htmltext.main_text(page, frozenset()) == text
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math>.</p><object data='a'>An object</object><noscript><p>No script</p></noscript></article>"
    assert htmltext.main_text(page, frozenset()) == "Let x=1.\n\nAn object\n\nNo script"
    many = "<div class='widget'>" * 40 + text + "</div>" * 40
    assert htmltext.main_text(many, frozenset()) == text


PLAIN = "<body><div class='a{r}'><div><a href='/'>Home</a> <a href='/x'>News</a></div><div><p>Notice {n} of the house.</p></div></div><div class='b'><h2>Head {i}</h2><p>The story {i} itself.</p></div><div class='c'><p>All rights reserved.</p></div></body>"


def test_the_template_alone_finds_unmarked_furniture(spark):
    """No element and no name says what is furniture: links, a line that never changes, and notices that take turns."""
    rows = [(i, f"http://a.example/{i}", PLAIN.format(i=i, n=i % 3, r="")) for i in range(20)]
    base = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", htmltext.host_of(F.col("url")))
    found = frozenset(htmltext.templates(base).first().furniture)
    for i, _, page in rows:
        assert htmltext.main_text(page, found, names=False) == f"Head {i}\n\nThe story {i} itself."


def brute_furniture(pages):
    """The paths that the rule names, from the whole vectors of a host's pages."""
    where, texts, links, on = {}, {}, {}, {}
    for k, page in enumerate(pages):
        mine = {}
        for path, text, *_, tags, link in htmltext.blocks(page):
            for tag in tags:
                where.setdefault((path, tag), [0] * len(pages))[k] += 1
            mine.setdefault(path, []).append(text)
            where.setdefault(path, [0] * len(pages))[k] += 1
            on.setdefault((path, text), set()).add(k)
            n, m = links.get(path, (0, 0))
            links[path] = (n + len(text), m + (len(text) if link else 0))
        for path, own in mine.items():
            texts.setdefault(path, set()).add(tuple(own))
    classes = {}
    for path, vector in where.items():
        classes.setdefault(tuple(vector), []).append(path)
    valid = [v for v, own in classes.items() if len(own) >= 2 and sum(map(bool, v)) >= max(3, 0.3 * len(pages))]
    return {p for v in valid for p in classes[v] if isinstance(p, str) and (len(texts[p]) == 1 or links[p][1] >= 0.9 * links[p][0])}


def test_slots_equal_those_of_whole_vectors(spark):
    rnd = random.Random(4)
    pages = []
    for i in range(30):
        parts = ["<nav><a href='/'>Home</a></nav>", f"<h1>T {i}</h1>"]
        if rnd.random() < 0.5:
            parts += ["<div class='q'><p>Subscribe now</p></div>", "<div class='r'><p>Follow us</p></div>"]
        parts += [f"<div class='s'><p>{rnd.random()}</p></div>"] * rnd.randint(1, 3)
        pages.append("<body>" + "".join(parts) + "<div class='z'>The end</div></body>")
    rows = [(i, "http://h.example/", p) for i, p in enumerate(pages)]
    base = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", htmltext.host_of(F.col("url")))
    found = {p for p in htmltext.templates(base).first().furniture if not p.startswith(("\n", "\r"))}
    assert found == brute_furniture(pages) and any(".q" in p for p in found) and any(".z" in p for p in found)


def test_odd_markup_keeps_its_text():
    assert htmltext.main_text("<article><p>a</p><svg class='i'/><p>b</p></article>", frozenset()) == "a\n\nb"
    deep = [f"<div class='d{i}'>" for i in range(80)]
    paths = [htmltext.blocks("".join([f"<div class='{first}'>", *deep]) + "text")[0][0] for first in ("x", "y")]
    assert paths[0] != paths[1] and all(len(p) <= htmltext.LONGEST_PATH for p in paths)


def test_no_pages_and_repeated_rows(spark):
    schema = "page_id long, url string, html string, host string, text string"
    assert htmltext.extract_text(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "http://a.example/", "<p>One</p>", "h", "t")] * 2 + [(1, "http://a.example/", "<p>Two</p>", "h", "t"), (2, None, None, None, None)]
    out = [(r.page_id, r.text, r.n_chars) for r in htmltext.extract_text(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(out) == [(1, "One", 3), (1, "One", 3), (1, "Two", 3), (2, "", 0)]
