import hashlib
import random
import re

from bibliolith.llm import pii

DOCS = "doc_id long, text string, spans string, n_chars long"
KINDS = ["email", "ip", "card", "phone"]
PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def valid(k, v):
    d = re.sub("[^0-9]", "", v)
    if k == 1:
        return all(int(x) <= 255 for x in v.split("."))
    if k == 2:
        return 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    return k != 3 or 9 <= len(d) <= 15


def base(text):
    return sorted((m.start(), k, m.end()) for k in range(4) for m in re.finditer(PLAIN[k], text) if valid(k, m[0]))


def test_base_spans_equal_plain_patterns(spark):
    rnd = random.Random(6)
    bits = ["a@b.co", "x.y+z@q-r.s.t", "@", ".", "1.2.3.4", "300.1.1.1", "0255.1.1.01", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 010-9999", "+12", " ", "-", "é", "😀", "12", "_", "%", "\n", "(", ")"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))), "", 0) for i in range(1500)]
    rows += [(2000, None, None, None), (2001, "", "", 0), (2002, "1" * 3_000, "", 0), (2003, "1 " * 1_500, "", 0), (2004, "a" * 2_000 + "@" + "b." * 1_000 + "c", "", 0), (2005, "1." * 1_500, "", 0), (0, "a@b.co", "", 0)]
    out = pii.find_pii(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == len(rows)
    want = sorted((d, hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base(t or "")).encode()).hexdigest(), *(sum(s[1] == k for s in base(t or "")) for k in range(4))) for d, t, *_ in rows)
    assert sorted((r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in out) == want


def made():
    rows = [(i, f"Reach account holder: u{i}@mail.org today. Nothing else here.", "", 0) for i in range(20)]
    rows += [(100 + i, f"Then account holder: ZX-{i}9-77 was seen.", "", 0) for i in range(2)]
    rows += [(200 + i, f"There are about {1000 + i}0 of them.", "", 0) for i in range(30)]
    return rows


def test_contexts_find_unseen_identifiers(spark):
    out = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(made(), DOCS)).collect()}
    text = dict((d, t) for d, t, *_ in made())
    for d in (100, 101):
        kind, a, b = out[d].spans.split(":")
        assert kind == "context" and text[d][int(a) : int(b)] == f"ZX-{d - 100}9-77"
    assert all(out[d].n_contextual == 0 for d in out if d not in (100, 101))


def test_redaction(spark):
    out = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(spark.createDataFrame([*made(), (300, "é +1 (555) 010-9999 b 1.2.3.4", "", 5), (301, None, None, None), (302, "plain", "", 7)], DOCS)).collect()}
    assert out[300] == ("é <PHONE> b <IP>", 16) and out[301] == (None, None) and out[302] == ("plain", 7)
    assert out[3][0] == "Reach account holder: <EMAIL> today. Nothing else here." and "<CONTEXT>" in out[100][0]


def test_no_documents(spark):
    assert pii.find_pii(spark.createDataFrame([], DOCS)).count() == 0


def test_long_runs_take_linear_time(spark):
    rows = [(1, "1" * 200_000, "", 0), (2, "1 " * 100_000, "", 0), (3, "a" * 200_000 + "@" + "b." * 50_000 + "c", "", 0), (4, "-a" * 100_000, "", 0), (5, "+1" * 100_000, "", 0)]
    out = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.find_pii(spark.createDataFrame(rows, DOCS)).collect()}
    assert out == {1: (0, 0, 0, 0), 2: (0, 0, 0, 0), 3: (1, 0, 0, 0), 4: (0, 0, 0, 0), 5: (0, 0, 0, 0)}
