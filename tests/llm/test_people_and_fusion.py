from __future__ import annotations

from datetime import datetime

from caseloom.llm import fusion, names

ROSTER = [(1, "person", "Robert R. Carvacre"), (2, "person", "Anouk Wympström"), (3, "organization", "Fabrwick Metals Quarry Group"), (4, "person", "Søren Opatbrook"), (5, "person", "Dalia Carvacre"), (6, "organization", "Quillacre Chemicals Logistics LLC")]
CASES = [
    ("Robert R. Carvacre", []), ("Carvacre, Robert", [1]), ("Bob Carvacre", [1]), ("R. Carvacre", [1]), ("ROBERT CARVACRE", [1]), ("Dr Robert Carvacer (witness)", [1]), ("Henry Carvacre", []), ("H. Carvacre", []), ("Anouk Wympstroem", [2]), ("anouk wympstrom", [2]),
    ("WYMPSTRÖM Anouk", [2]), ("Anouk Wympström & Soren Opatbrook", [2, 4]), ("  Søren  Opatbr0ok ", [4]), ("Fabrwick Metals Quarry", [3]), ("FMQ Group", [3]), ("fabrwick-metals quarry group", [3]), ("Fabrwick Metals Quarry Ltd", []), ("Lorthorpe Metals Group", []),
    ("the Fabrwick Metals company", [3]), ("Quillacre Chemicals Logistics L.L.C.", [6]), ("Quillacre Chem. Logistics LLC", [6]), ("N/A", []), ("", []), (None, []), ("?", []), ("x" * 5000, []),
]


def test_links(spark):
    roster = spark.createDataFrame(ROSTER, "ref_id long, kind string, full_name string")
    nick = spark.createDataFrame([("Robert", "Bob"), (None, "x")], "formal string, short string")
    facts = spark.createDataFrame([(k, [n], "x") for k, (n, _) in enumerate(CASES)] + [(500, None, "x"), (501, [], "x"), (0 + 502, [None, "Bob Carvacre"], "x")], "id long, people array<string>, name string")
    raw = spark.createDataFrame([(7, ["Bob Carvacre"])], "raw_id long, people array<string>")
    got = {(r["tab"], r["rec_id"], r["person_pos"], r["ref_id"]) for r in names.found(facts, raw, roster, nick).collect()}
    want = {("facts", k, 0, r) for k, (_, refs) in enumerate(CASES) for r in refs} | {("facts", 502, 1, 1), ("llm_facts", 7, 0, 1)}
    assert got == want
    assert names.found(facts.filter("false"), raw.filter("false"), roster, nick).count() == 0


def test_fusion(spark):
    sources = spark.createDataFrame([("HBR", "x", "Europe/Berlin", "DMY", "de")], "source_code string, site_name string, zone_name string, date_order string, main_lang string")
    t = [None, datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(2024, 1, 3)]
    cols = "id long, fingerprint string, filename string, fact_summary string, associated_date string, severity_score int, confidence double, is_deleted boolean, created_at timestamp, pipeline_id string, pass_name string, value string"
    rows = [
        (1, "f", "HBR_1", "Same  thing", "2020-01-01", 5, 0.4, False, t[1], "p", "a", None), (2, "f", "HBR_1", "same thing", "02.01.2020", 7, 0.9, False, t[2], "p", "b", None), (3, "f", "HBR_1", "SAME THING ", "bad", None, None, None, t[1], None, None, None),
        (4, "f", "HBR_1", "same thing", "2021-01-01", 3, 1.0, True, t[3], "p", "a", None),
        (5, "g", "HBR_2", "other", None, 4, 0.9, False, t[1], "p", "a", None), (6, "g", "HBR_2", "other", None, 6, 0.5, False, t[2], "p", "a", None),  # the later is less sure
        (7, "h", "HBR_3", "tie", None, 2, 0.5, False, None, "p", "a", None), (8, "h", "HBR_3", "tie", None, 3, 0.5, False, None, "p", "a", None),
        (9, "i", "HBR_4", "alone", None, 2, 0.5, False, t[1], "p", "a", None), (10, None, None, None, None, None, 2.0, False, t[1], None, None, None),
    ]
    df = spark.createDataFrame(rows, cols)
    got = {(r["group_id"], r["field_name"], r["source_id"]) for r in fusion.found(df, sources).collect()}
    assert got == {(1, "associated_date", 2), (1, "severity_score", 2), (1, "confidence", 2)}
    all_ = {(r["group_id"], r["field_name"]): r for r in fusion.survivors(df, sources).collect()}
    assert all_[1, "associated_date"]["value"] == "2020-01-02" and set(k[0] for k in all_) == {1, 5, 7}
    assert fusion.found(df.filter("false"), sources).count() == 0


def test_copies_are_no_votes(spark):
    """Three sources of five share false values in many groups, as two of them copy the third: the majority is wrong, the fusion right."""
    import random

    rng = random.Random(4)
    rows, truth = [], {}
    for g in range(300):
        right = rng.randint(1, 9)
        truth[g] = right
        wrong = rng.choice([x for x in range(1, 10) if x != right])
        bad = rng.random() < 0.4  # the copied source errs
        said = {"a": right if rng.random() < 0.95 else wrong % 9 + 1, "b": right if rng.random() < 0.95 else rng.randint(1, 9), "c": wrong if bad else right}
        said |= {"d": said["c"], "e": said["c"]}
        rows += [(g, "severity_score", str(v), ord(s), 10 * g + k, 0, 0.5) for k, (s, v) in enumerate(said.items())]
    claimed = spark.createDataFrame(rows, "group_id long, field_name string, value string, source long, id long, created long, trust double")
    got = {r["group_id"]: int(r["value"]) for r in fusion.fuse(claimed).collect()}
    voted = {g: max({v for _, _, v, *_ in rows[5 * g : 5 * g + 5]}, key=lambda v, g=g: sum(r[2] == v for r in rows[5 * g : 5 * g + 5])) for g in truth}
    majority = sum(int(voted[g]) == t for g, t in truth.items()) / len(truth)
    fused = sum(got[g] == t for g, t in truth.items()) / len(truth)
    assert majority < 0.7 and fused > 0.9
    once = {r["group_id"]: int(r["value"]) for r in fusion.fuse(claimed, 0).collect()}  # without rounds, copies count
    assert sum(once[g] == t for g, t in truth.items()) / len(truth) < 0.7
