from __future__ import annotations

import random
from collections import Counter

import pytest

from caseloom.llm import encodings, personal, scans, splitting

WORDS = "the dispatcher stated that the quarterly boiler had been restored from a borrowed telephone and the third-party auditor signed the memorandum".split()


def scan_page(k):
    rng = random.Random(k)
    filler = [" ".join(rng.sample(WORDS[:12], 9)) for _ in range(60)]
    body = ["the dispatcher stated that the quarterly boiler had been resto-", "red from a borrowed telephone and the third-", "party auditor signed the memorandum."]
    return "\n".join([f"Statement bundle A{1000 + k}", "", *filler[:29], filler[29] + " third-party", *body, *filler[30:], "", f"[{k}]"])


def test_scans(spark):
    rows = [(k, scan_page(k)) for k in range(1, 60)] + [(100, scan_page(3).replace("boiler had been resto", "bo1ler had been resto").replace("signed", "signcd")), (101, None), (102, "")]
    ocr = spark.createDataFrame(rows, "ocr_id long, text string")
    cache = spark.createDataFrame([(1, "A clean text of one long line. " * 12), (2, None)], "id long, extracted_text string")
    found = scans.found(ocr, cache).collect()
    assert {(r["line_no"], r["kind"]) for r in found if r["rec_id"] == 5 and r["tab"] == "ocr_results"} == {(1, "furniture"), (33, "hyphen"), (67, "furniture")}
    assert {(r["line_no"], r["kind"]) for r in found if r["rec_id"] == 100} == {(1, "furniture"), (33, "hyphen"), (33, "misread"), (35, "misread"), (67, "furniture")}
    assert not [r for r in found if r["tab"] == "text_cache"]
    text = {r["rec_id"]: r["text"] for r in scans.repaired(ocr, cache).collect() if r["tab"] == "ocr_results"}
    assert "the dispatcher stated that the quarterly boiler had been restored from a borrowed telephone and the third-party auditor signed the memorandum." in text[100]
    assert "bundle" not in text[100] and "[3]" not in text[100]
    empty = ocr.filter("false")
    assert scans.found(empty, cache.filter("false")).count() == 0


def test_automaton_is_complete():
    words = {"boiler", "broiler", "toiler", "oiler", "boilers", "modem", "modern", "clear", "dear"}
    lex = scans.Lexicon({f"w{w}": 10 for w in words})

    def within(a, b):
        rows = [list(range(len(b) + 1))]
        for i, x in enumerate(a, 1):
            rows.append([i] + [0] * len(b))
            for j, y in enumerate(b, 1):
                rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (x != y))
        return rows[-1][-1]

    for typed in ("boiler", "bolier", "boilr", "xboiler", "modem", "dear"):
        for edits in (1, 2):
            assert {w for w in words if within(typed, w) <= edits} <= set(lex.candidates(typed, edits))
    assert "modern" in lex.candidates("modem", 1) and "clear" in lex.candidates("dear", 1)


def test_encodings(spark):
    spanish = "Según el señor de la oficina, la dirección número uno fue añadida después por la compañía"
    german = "Wir möchten höflich daran erinnern, dass die Überweisung für die Büroschlüssel ungeklärt blieb"
    polish = "Według świadka pożyczka była zajęta, łącznie usunięta później przez księgę, łapówka wciąż czeka"
    russian = "По словам свидетеля, подпись и оплата были изъята, просим объяснить, почему накладная отсутствует"
    sound = [spanish, german, polish, russian, "Fee: €75 … agreed", "plain ascii?", "SÃO PEDIDAS À AÇÃO"]
    bad = [
        (german.encode().decode("cp1252", "replace"), "restorable"), (spanish.encode().decode("latin-1"), "restorable"), (spanish.encode("cp850").decode("latin-1"), "restorable"), (polish.encode("cp1250").decode("cp1252"), "restorable"),
        (russian.encode("koi8-r").decode("cp1251"), "restorable"), (german.encode().decode("latin-1").encode().decode("latin-1"), "restorable"), (spanish.encode("ascii", "replace").decode(), "lost"), (german.replace("ö", "�"), "lost"),
    ]
    bad[0] = (german.encode().decode("latin-1"), "restorable")
    rows = [(i, "A_1.txt", t) for i, t in enumerate(sound * 30)] + [(1000 + k, "A_2.txt", t) for k, (t, _) in enumerate(bad)] + [(2000, None, None), (2001, "x", "")]
    df = spark.createDataFrame(rows, "extraction_id long, file_name string, text string")
    got = {r["extraction_id"]: r for r in encodings.restored(df).collect()}
    assert {k: r["state"] for k, r in got.items()} == {1000 + k: s for k, (_, s) in enumerate(bad)}
    assert got[1002]["text"] == spanish and got[1003]["text"] == polish and got[1004]["text"] == russian and got[1005]["text"] == german
    assert encodings.found(df.filter("false")).count() == 0


def test_personal(spark):
    roster = spark.createDataFrame([(1, "person", "Elizabeth Q. Woldington"), (2, "person", "Søren Opatbrook")], "ref_id long, kind string, full_name string")
    nick = spark.createDataFrame([("Elizabeth", "Liz")], "formal string, short string")
    text = (
        "Please contact Elizabeth Woldington at liz_w@example.org or on +44 20 7946 0123 ext. 7. The form lists SSN: 123-45-6789 and the signature of Dr Opatbrook.\n"
        "We sent it to Flat 3, 14 Elder Road, Norwick NQ6 3ZZ on Monday. Batch 113-23-194 failed at 192.0.2.19. Opatbrook Dairy Metals plc paid. [10:11] liz woldington: hello"
    )
    docs = spark.createDataFrame([(k, text, k) for k in range(30)] + [(100, None, 0), (101, "", 0), (102, "nothing here", 0)], "doc_id long, text string, kind int")
    got = [(r["kind"], text[r["start_pos"] : r["end_pos"]]) for r in personal.found(docs, roster, nick).filter("doc_id = 5").collect()]
    assert sorted(got) == sorted([
        ("name", "Elizabeth Woldington"), ("email", "liz_w@example.org"), ("phone", "+44 20 7946 0123 ext. 7"), ("idnum", "123-45-6789"), ("name", "Opatbrook"), ("address", "Flat 3, 14 Elder Road, Norwick NQ6 3ZZ"),
    ])
    out = {r["doc_id"]: r["text"] for r in personal.redacted(docs, roster, nick).collect()}
    assert "[EMAIL]" in out[5] and "liz_w" not in out[5] and out[100] is None and out[101] == "" and out[102] == "nothing here" and "Batch 113-23-194" in out[5]
    assert personal.found(docs.filter("false"), roster, nick).count() == 0


def test_em_prefers_agreeing_labelers():
    p = personal.labels([("+++", 500), ("++0", 200), ("-0-", 400), ("-+-", 20), ("0--", 100)])
    assert p["+++"] > 0.9 and p["-0-"] < 0.1 and p["0--"] < 0.2


def test_splitting(spark, tmp_path):
    rows = [(1, "a. " * 50, 40, 6), (2, "x" * 200, 50, 5), (3, "short", 50, 5), (4, None, 50, 5), (5, "", 50, 5), (6, "日本。" * 40, 30, 4), (7, "no limit " * 30, None, 5)]
    df = spark.createDataFrame(rows, "id long, t string, n int, o int")
    pieces = {}
    for r in splitting.split(df, "id", "t", "n", "o").collect():
        pieces.setdefault(r["text_id"], []).append(r)
    assert set(pieces) == {1, 2, 3, 6, 7}
    for i, t, n, o in rows:
        if i in pieces:
            p = sorted(pieces[i], key=lambda r: r["piece_no"])
            assert p[0]["start_pos"] == 0 and p[-1]["end_pos"] == len(t) and all(t[r["start_pos"] : r["end_pos"]] == r["piece"] and (n is None or len(r["piece"]) <= n) for r in p)
            assert all(a["end_pos"] - b["start_pos"] == o for a, b in zip(p, p[1:]))
    text = "".join(f"line {k} é日\n" for k in range(5000))
    path = tmp_path / "big.txt"
    path.write_text(text)
    got = sorted(splitting.split_file(spark, str(path), 500, 50, range_bytes=7001).collect(), key=lambda r: r["piece_no"])
    assert [r["piece_no"] for r in got] == list(range(len(got))) and got[0]["start_pos"] == 0 and got[-1]["end_pos"] == len(text)
    assert all(text[r["start_pos"] : r["end_pos"]] == r["piece"] and len(r["piece"]) <= 500 and r["piece"].endswith("\n") for r in got)
    assert all(a["end_pos"] - b["start_pos"] == 50 for a, b in zip(got, got[1:]))


def test_ranges_cut_as_the_whole_does(spark):
    """Cutting by ranges with halos is what cutting in one worker gives; boundaries are sought in all of what a piece may hold."""
    text = ("word " * 70 + "\n\n") * 90
    rows = [(1, text, 400, 30), (2, text, 400, 0), (3, "y" * 9000, 300, 10), (4, text, None, None)]
    got: dict = {}
    for r in splitting.split(spark.createDataFrame(rows, "id long, t string, n int, o int"), "id", "t", "n", "o", range_chars=2500).collect():
        got.setdefault(r["text_id"], []).append((r["piece_no"], r["start_pos"], r["end_pos"]))
        assert len(r["piece"]) == r["end_pos"] - r["start_pos"]
    for i, t, n, o in rows:
        assert sorted(got[i]) == splitting.pieces_of(t, n, o, 2500)
    # paragraphs of 352 signs with a limit of 400: every cut is at a blank line
    assert all(text[e - 1] == "\n" for _, _, e in got[2])
    assert len(got[2]) <= 1.15 * 90
    with pytest.raises(Exception, match="out of range"):
        splitting.split(spark.createDataFrame([(1, "x" * 50, 10, 5)], "id long, t string, n int, o int"), "id", "t", "n", "o").collect()


def test_measure_stitches(spark):
    t = "x" * 95 + " " + "y" * 130
    df = spark.createDataFrame([(1, t, "f"), (1, t, "f"), (2, "", "g"), (3, None, "h"), (4, "y" * 100, "k")], "id long, t string, fingerprint string")
    got = sorted((r["id"], r["n_chars"], r["longest_run"]) for r in splitting.measure(df, "id", "t", ("fingerprint",), range_chars=50).collect())
    assert got == [(1, 226, 130), (1, 226, 130), (2, 0, 0), (4, 100, 100)]
    assert Counter(x[0] for x in got)[1] == 2
