"""Rows of scanned pages don't depend on whether the corpus is so large that a word falls below the share of the vocabulary."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

from caseloom.llm import scans

FILL = "the dispatcher stated that quarterly boiler borrowed telephone auditor signed memorandum invoice surveyor warehouse reported delivered".split()


def test_a_higher_floor_changes_neither_lines_nor_texts(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for k in range(120):
        lines = [" ".join(rng.choice(FILL) for _ in range(9)) for _ in range(25)]
        lines[4] += " barnacle cathedral well-tempered barnacle cathedral self-serving"
        lines[8] += " b0iler"
        lines[10] += " barna-"  # a broken word
        lines[11] = "cle " + lines[11]
        lines[13] += " well-"  # a compound
        lines[14] = "tempered " + lines[14]
        lines[16] += " telephones"
        rows.append((k, "\n".join(lines)))
    ocr = spark.createDataFrame(rows, "ocr_id long, text string")
    none = spark.createDataFrame([], "id long, extracted_text string")

    def both():
        return {tuple(r) for r in scans.found(ocr, none).collect()}, {tuple(r) for r in scans.repaired(ocr, none).collect()}

    low = both()
    assert {(r[2], r[3]) for r in low[0] if r[1] == 7} == {(9, "misread"), (11, "hyphen")}
    text = next(r[2] for r in low[1] if r[1] == 7)
    assert "barnacle" in text and "well-tempered" in text and "telephones" in text and "b0iler" not in text
    monkeypatch.setattr(scans, "MIN_SHARE", 1e-2)  # a floor of about 280: the words and compounds above fall out
    assert both() == low


KEYS = ("wbarnacle", "hbarna-cle", "wbarna", "wcle", "pbarna")


@pytest.mark.parametrize("known", [k for n in range(5) for k in combinations(KEYS[:4], n)])
@pytest.mark.parametrize("near", [False, True])
def test_a_record_without_a_deciding_rare_word_needn_t_be_judged_again(known, near):
    """For a broken word with any of its parts in the vocabulary, any of them rare: what is asked for decides all that the rare ones change."""
    counts = {"w" + w: 5_000 for w in FILL} | {k: 5_000 for k in known} | ({"wbarnacles": 900_000} if near else {}) | {"p": 1}
    lex = scans.Lexicon(counts)
    for text in ("the dispatcher stated barna-\ncle that quarterly boiler", "the dispatcher stated\nthat quarterly barna-"):
        for n in range(6):
            for some in combinations(KEYS, n):
                rare = {k: 40.0 for k in some}
                asked: dict[str, bool] = {}
                scans.analyse(text, lex, asked=asked)
                found = {k: rare[k] for k in asked if k in rare}
                given = found if any(asked[k] for k in found) else scans.NO_RARE
                tokens: tuple[dict, dict] = {}, {}
                assert scans.analyse(text, lex, tokens[0], given) == scans.analyse(text, lex, tokens[1], rare)
                assert tokens[0] == tokens[1]


def test_halves_of_a_known_word_alone_decide_nothing():
    lex = scans.Lexicon({"w" + w: 5_000 for w in [*FILL, "barnacle"]} | {"p": 1})
    asked: dict[str, bool] = {}
    scans.analyse("the dispatcher stated barna-\ncle that quarterly boiler", lex, asked=asked)
    assert {k for k, decides in asked.items() if decides} == {"hbarna-cle"}


def test_perhaps_misread_furniture_is_judged_by_the_same_two_words():
    """The first two and last two words put right one by one are those of the line put right."""
    lex = scans.Lexicon({"w" + w: 90_000 for w in FILL} | {"p": 1})
    lex.furniture = {"S The dispatcher", "E signed memorandum"}
    assert lex.is_furniture("The d1spatcher auditor invoice", True) and lex.is_furniture("auditor invoice signed mem0randum", True) and lex.is_furniture("The d1spatcher", True)
    assert not lex.is_furniture("auditor The d1spatcher invoice", True) and not lex.is_furniture("The d1spatcher auditor invoice", False)
