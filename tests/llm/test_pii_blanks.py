import random

from bibliolith.llm import pii


def test_spaced_values_are_instances(spark):
    rows = [(i, f"Please call home number: +1 (743) 555-{3800 + i}, thanks. Then go.") for i in range(20)]
    rows += [(50 + i, f"She paid with card: 4111 1111 1111 1111 {'.' * i}") for i in range(2)]
    rows += [(100, "My home number: 743 555 3824 is new."), (101, f"His home number: {'x9' * 50} is new.")]
    rows += [(200 + i, f"There were about {i + 10} 000 of them.") for i in range(30)]
    text = dict(rows)
    out = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    got = {d: [(s.split(":")[0], text[d][int(s.split(":")[1]) : int(s.split(":")[2])]) for s in out[d].spans.split(",") if s] for d in text}
    assert got[100] == [("context", "743 555 3824")] and got[101] == [("context", "x9" * 50)]
    assert got[0] == [("phone", "+1 (743) 555-3800")] and got[50] == [("card", "4111 1111 1111 1111")]
    assert all(not got[200 + i] for i in range(30))


def test_one_word_and_words_around_are_patterns(spark):
    """The second word before the identifier differs each time: only the word before, or the words around, can be learnt."""
    names = [f"{a}{b}" for a in "bcdfghklmnpqrst" for b in ("am", "eli", "or", "ux")]
    rows = [(i, f"Notes of {n} mailto: {n}@mail.org and more text.") for i, n in enumerate(names)]
    rows += [(500, "Then zorro mailto: someone@localhost and more."), (501, "As before mailto: 12345678 and more.")]
    rows += [(600 + i, f"So {n} via +1 743 555 {3800 + i} reached her.") for i, n in enumerate(names[:9])] + [(700, "So nobody via 743 555 3824 reached her."), (701, "So nobody via 743 555 3824 missed her.")]
    text = dict(rows)
    out = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    got = {d: [(s.split(":")[0], text[d][int(s.split(":")[1]) : int(s.split(":")[2])]) for s in out[d].spans.split(",") if s] for d in text}
    assert got[500] == [("context", "someone@localhost")] and got[501] == []
    assert got[700] == [("context", "743 555 3824")] and got[701] == []


def test_bootstrap_equals_plain_iteration(spark):
    rnd = random.Random(3)
    pairs = {(f"{rnd.choice('21a')} c{rnd.randrange(12)}", f"i{rnd.randrange(60)}") for _ in range(260)}
    seeds = {f"i{k}" for k in range(45)}
    rows = [(c, i, int(i in seeds)) for c, i in pairs]
    got = {r.cue: r.score for r in pii.bootstrap_patterns(spark.createDataFrame(rows, "cue string, ident string, seed int"), 3, 3, 0.7).collect()}
    known = {i: 1.0 for _, i in pairs if i in seeds}
    for _ in range(3):
        accepted = {}
        for cue in {c for c, _ in pairs}:
            own = [known.get(i, 0.0) for c, i in pairs if c == cue]
            need, least = (12, 0.85) if cue.startswith("1 ") else (3, 0.7)
            if sum(k >= 0.7 for k in own) >= need and sum(own) / len(own) >= least - 1e-12:
                accepted[cue] = min(sum(own) / len(own), 0.999)
        belief = {}
        for c, i in pairs:
            if c in accepted:
                belief[i] = belief.get(i, 1.0) * (1 - accepted[c])
        known = {i: max(1.0 if i in seeds else 0.0, 1 - belief.get(i, 1.0)) for _, i in pairs if i in seeds or i in belief}
    assert got.keys() == accepted.keys() and len(got) > 3
    assert all(abs(got[c] - accepted[c]) < 1e-9 for c in got)


def test_rows_that_share_an_id_keep_their_own_spans(spark):
    rows = [(1, "mail a@b.co"), (1, "no data here"), (1, "ip 1.2.3.4"), (None, "mail c@d.co"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.spans for r in pii.find_pii(docs).collect()) == ["", "", "email:5:11", "email:5:11", "ip:3:10"]
    assert sorted(str(r.text) for r in pii.redact(docs).collect()) == ["None", "ip <IP>", "mail <EMAIL>", "mail <EMAIL>", "no data here"]
