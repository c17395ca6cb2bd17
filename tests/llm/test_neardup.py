from __future__ import annotations

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from caseloom.llm import neardup

T = Fraction(3, 4)
SCHEMA = "id long, fact_summary string, source_quote string, a string, key string"


def brute(rows, t=T, least=8):
    sets = [(i, set(neardup.WORD.findall(f"{s or ''} {q or ''}".lower()))) for i, s, q, *_ in rows]
    return {(min(i, j), max(i, j)) for x, (i, a) in enumerate(sets) for j, b in sets[x + 1 :] if i != j and len(a) >= least and len(b) >= least and len(a & b) * t.denominator >= len(a | b) * t.numerator}


def corpus(n, seed, vocabulary=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)]
    rows, base = [], [rng.sample(words, rng.randint(8, min(30, vocabulary - 4))) for _ in range(n // 5)]
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 4, 6))):
            k = rng.randrange(len(w))
            w[k] = rng.choice((w[k], f"x{rng.randrange(10**6)}", rng.choice(words)))
        rng.shuffle(w)
        rows.append((i, " ".join(w[:5]), " ".join(w[5:]), "a", None))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_no_pair_is_lost(spark, seed):
    rows = corpus(250, seed)
    got = [(r["id_a"], r["id_b"]) for r in neardup.found(spark.createDataFrame(rows, SCHEMA), "id", ["fact_summary", "source_quote"]).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_large_buckets_lose_nothing(spark):
    rows = corpus(120, 7, vocabulary=24)
    df = spark.createDataFrame(rows, SCHEMA)
    texts = neardup.texts_of(df, "id", ["fact_summary", "source_quote"])
    largest = 40
    pairs = {(r["a"], r["b"]) for r in neardup.candidates(texts, 8, largest, T, cap=3).collect()}
    assert brute(rows) - {(i, j) for i, j in brute(rows) if set(" ".join(rows[i][1:3]).split()) == set(" ".join(rows[j][1:3]).split())} <= pairs


def test_hot_copies_nulls_and_empty(spark):
    text = "one two three four five six seven eight nine"
    rows = [(i, text, None, None, None) for i in range(40)] + [(100, None, None, None, None), (101, "", "", None, None), (102, "too few words", None, None, None), (103, text, "ten", None, None), (103, text, "ten", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["id_a"], r["id_b"]) for r in neardup.found(df, "id", ["fact_summary", "source_quote"]).collect()}
    assert got == brute(rows)
    classes = {r["id"]: (r["class_id"], r["links"]) for r in neardup.classes(df, "id", ["fact_summary", "source_quote"]).collect()}
    assert classes[39] == (0, 1) and classes[103] == (103, 1) and classes[102] == (102, 0)
    assert neardup.found(df.filter("false"), "id", ["fact_summary", "source_quote"]).count() == 0


def test_families_cover():
    """Every set of up to r differing words spoils at most all but two groups."""
    rng = random.Random(1)
    for r in (3, 7, 15):
        groups = (r + 1) // 2 + 1
        for _ in range(500):
            hit = [0] * groups
            for _ in range(r):
                hit[rng.randrange(groups)] += 1
            assert sum(h <= 1 for h in hit) >= 2


def test_words_of_one_record_make_no_keys(spark):
    """Keys of rare words: a word that no other record has can't be shared; pairs that are alike share keys all the same."""
    from fractions import Fraction

    from caseloom.llm import neardup

    same = " ".join(f"common{k}" for k in range(12))
    rows = [(1, same + " left"), (2, same + " right"), (3, " ".join(f"lonely{k}" for k in range(13)))]
    keys = neardup.by_rare_words(spark.createDataFrame(rows, "id long, text string"), Fraction(3, 4)).collect()
    of = {i: {r["key"] for r in keys if r["id"] == i} for i in (1, 2, 3)}
    assert not of[3] and of[1] & of[2]


def test_sets_are_hashed_in_no_more_groups_than_their_size_asks_for(spark):
    """Sets of 41 words differ from their partners in 13 words at most: 8 of the 9 groups of radius 15. With none left out, every pair shares two groups or more."""
    rng = random.Random(5)
    rows = []
    for k in range(40):
        words = [f"k{k}w{j}" for j in range(41)]
        rows.append((2 * k, " ".join(words)))
        for j in rng.sample(range(41), 5):
            words[j] = f"other{k}w{j}"
        rows.append((2 * k + 1, " ".join(words)))
    keys = neardup.keys_of(spark.createDataFrame(rows, "id long, text string"), 8, 54, T).collect()
    of = {i: {(r["info"] & 0xFFFF, r["key"]) for r in keys if r["id"] == i and not r["info"] & neardup.EMPTY} for i, _ in rows}
    assert sum(r["id"] == 0 for r in keys) == 3 * 8
    for k in range(40):
        shared = {g for g, _ in of[2 * k] & of[2 * k + 1]}
        empty = [{r["info"] & 0xFFFF for r in keys if r["id"] == i and r["info"] & neardup.EMPTY} for i in (2 * k, 2 * k + 1)]
        assert len(shared | (empty[0] & empty[1])) >= 2


def test_only_keeps_all_wanted_rows_and_few_others(spark):
    df = spark.range(50_000).select("id", F.lit("text").alias("text"))
    wanted = spark.range(0, 50_000, 50)
    got = [r["id"] for r in neardup.only(df, wanted).collect()]
    assert len(got) == len(set(got)) and set(got) >= set(range(0, 50_000, 50)) and len(got) < 1_000 + 5_000
    assert neardup.only(df, wanted.limit(0)).count() == 0


def test_short_sets_that_pass_the_table_of_bits_make_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "only", lambda df, ids: df)  # as if every look-up met another id
    rows = corpus(150, 3, vocabulary=24) + [(1000, "two words", None, None, None), (1001, "words two", "", None, None), (1002, "words, two", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = spark.createDataFrame([(1000, 1001)], "a long, b long")
    assert neardup.verified(pairs, neardup.texts_of(df, "id", ["fact_summary", "source_quote"]), 8, T).count() == 0
    assert {(r["id_a"], r["id_b"]) for r in neardup.found(df, "id", ["fact_summary", "source_quote"]).collect()} == brute(rows)
