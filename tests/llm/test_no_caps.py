"""Bounds that used to drop or change cases, crossed."""

from __future__ import annotations

import random
from fractions import Fraction

from caseloom.llm import neardup, personal, scans

FILL = "the dispatcher stated that quarterly boiler borrowed telephone auditor signed memorandum invoice surveyor warehouse reported delivered".split()


def page(k, extra=()):
    rng = random.Random(k)
    body = [" ".join(rng.choice(FILL) for _ in range(9)) for _ in range(30)]
    return "\n".join([f"Statement bundle A{1000 + k}", "", *body, *extra, "", f"[{k}]"])


def test_one_wide_line_doesnt_make_a_page_unscanned(spark):
    rows = [(k, page(k)) for k in range(60)] + [(100, page(3, ["the auditor signed the memorandun " + "and the boiler " * 10]))]
    ocr = spark.createDataFrame(rows, "ocr_id long, text string")
    none = spark.createDataFrame([], "id long, extracted_text string")
    found = {(r["line_no"], r["kind"]) for r in scans.found(ocr, none).filter("rec_id = 100").collect()}
    assert {(1, "furniture"), (35, "furniture"), (33, "misread")} <= found


def test_wide_furniture_counts(spark):
    header = "Consolidated statement of the independent receivers concerning all shipments and deliveries, bundle"
    assert len(header) > 80

    def wide(k):
        rng = random.Random(k)
        return "\n".join([f"{header} {k}", "", *[" ".join(rng.choice(FILL) for _ in range(15)) for _ in range(30)]])

    ocr = spark.createDataFrame([(k, wide(k)) for k in range(80)], "ocr_id long, text string")
    none = spark.createDataFrame([], "id long, extracted_text string")
    assert scans.found(ocr, none).filter("kind = 'furniture' and line_no = 1").count() == 80


def test_readings_of_many_signs():
    """Sixteen signs with two readings each are more than any list of 64 readings: the trie finds the word all the same."""
    word = "illlilliilillill"
    lex = scans.Lexicon({f"w{word}": 50, "wboiler": 50})
    assert lex.meant("1" * 16) is None  # a number
    assert lex.from_signs("1" * 16) == word
    assert lex.meant("b0i1er") == "boiler"


def test_a_higher_floor_of_the_vocabulary_changes_nothing(spark, monkeypatch):
    """Words too rare for the broadcast vocabulary are looked up in the table of counts, so a floor that grows with the corpus makes no false cases."""
    rng = random.Random(9)
    rare = ["barnacle", "tungsten", "marigold", "cathedral", "pendulum"]
    rows = []
    for k in range(120):
        lines = [" ".join(rng.choice(FILL) for _ in range(9)) for _ in range(25)]
        lines[5] += f" {rare[k % 5]}"
        lines[9] = lines[9].replace("boiler", "boi1er")
        rows.append((k, "\n".join(lines)))
    ocr = spark.createDataFrame(rows, "ocr_id long, text string")
    none = spark.createDataFrame([], "id long, extracted_text string")
    low = {tuple(r) for r in scans.found(ocr, none).filter("kind = 'misread'").collect()}
    monkeypatch.setattr(scans, "MIN_SHARE", 2e-3)  # a floor of over 50: the rare words, 24 times each, fall out
    assert {tuple(r) for r in scans.found(ocr, none).filter("kind = 'misread'").collect()} == low and low


def test_short_sets_at_any_threshold(spark):
    """Sets of one to six words in hot buckets: what the masks can't tell apart is found by rare words."""
    rng = random.Random(8)
    for t in (Fraction(1, 2), Fraction(3, 4)):
        rows = [(i, " ".join(rng.sample([f"w{k}" for k in range(9)], rng.randint(1, 6))), "") for i in range(120)]
        df = spark.createDataFrame(rows, "id long, a string, b string")
        texts = neardup.texts_of(df, "id", ["a", "b"])
        got = {(r["a"], r["b"]) for r in neardup.candidates(texts, 1, 9, t, cap=2).collect()}
        sets = [set(r[1].split()) for r in rows]
        want = {(i, j) for i in range(120) for j in range(i + 1, 120) if sets[i] != sets[j] and len(sets[i] & sets[j]) * t.denominator >= len(sets[i] | sets[j]) * t.numerator}
        assert want <= got


GIVEN, LAST = "Anna Bruno Clara Dorian Elena Felix".split(), "Vandermolen Quistgaard Ferrante Lindholm".split()


def labelled(n, seed):
    """Texts with planted items and look-alikes: (text, spans)."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        text, spans = "", []

        def put(s, kind=None):
            nonlocal text
            if kind:
                spans.append((kind, len(text), len(text) + len(s)))
            text += s

        for _ in range(6):
            k = rng.randrange(8)
            if k == 0:
                put("Please contact "), put(f"{rng.choice(GIVEN)} {rng.choice(LAST)}", "name"), put(" about it. ")
            elif k == 1:
                put("Call "), put(f"+44 20 {rng.randint(1000, 9999)} {rng.randint(1000, 9999)}", "phone"), put(" today. ")
            elif k == 2:
                put(f"Invoice no. {rng.randint(100, 999)}-{rng.randint(100, 999)}-{rng.randint(1000, 9999)} was paid. ")
            elif k == 3:
                put(f"The firm {rng.choice(GIVEN)} {rng.choice(LAST)} {rng.choice(['Metals', 'Seeds'])} plc delivered the goods. ")
            elif k == 4:
                put("Serial "), put(f"J{rng.randint(1000000, 9999999)} belongs to the pump. ")
            elif k == 5:
                put("Write to "), put(f"{rng.choice(GIVEN).lower()}@example.org", "email"), put(". ")
            elif k == 6:
                put("SSN: "), put(f"{rng.randint(100, 999)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", "idnum"), put(" is on file. ")
            else:
                put(f"Container {rng.randint(100, 999)} {rng.randint(100, 999)} {rng.randint(1000, 9999)} and quarry goods arrived. ")
        out.append((text, spans))
    return out


def scores(got, want):
    hit = len(got & want)
    return hit / max(1, len(want)), hit / max(1, len(got))


def test_em_and_classifier_beat_counting_votes(spark):
    """Precision and recall on labelled texts, with EM and the classifier and with mere majorities of the same votes: they differ, and in favour of the former."""
    texts = labelled(400, 2)
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")
    roster = spark.createDataFrame([(k, "person", f"{g} {s}") for k, (g, s) in enumerate((g, s) for g in GIVEN for s in LAST)], "ref_id long, kind string, full_name string")
    nick = spark.createDataFrame([], "formal string, short string")
    want = {(d, *s) for d, (_, spans) in enumerate(texts) for s in spans}
    got = {tuple(r) for r in personal.found(docs, roster, nick).select("doc_id", "kind", "start_pos", "end_pos").collect()}
    spans = personal.candidates(docs, personal.gazetteer(docs, roster, nick)).collect()
    voted = {(r["doc_id"], x["kind"], x["start_pos"], x["end_pos"]) for r in spans for x in r["spans"] if x["votes"].count("+") > x["votes"].count("-")}
    with_em, without = scores(got, want), scores(voted, want)
    print("with EM and classifier: recall %.3f, precision %.3f; majority of votes: recall %.3f, precision %.3f" % (*with_em, *without))
    assert with_em != without and min(with_em) >= 0.97 and sum(with_em) > sum(without)
