"""The n-gram join of names loses no near entry, whatever the roster's size, and ties are decided by average linkage."""

from __future__ import annotations

import random

from caseloom.llm import names


def people(n, seed=1):
    rng = random.Random(seed)
    part = lambda k: "".join(rng.choice(["ba", "lo", "ri", "stan", "mek", "vu", "tor", "qui"]) for _ in range(k)).capitalize()
    return [(k, "person", f"{part(2)} {part(3)}") for k in range(n)]


def test_join_is_complete(spark):
    roster = spark.createDataFrame(people(150), "ref_id long, kind string, full_name string")
    nick = spark.createDataFrame([], "formal string, short string")
    rng = random.Random(2)
    typed = []
    for _, _, full in people(150):
        k = rng.randrange(len(full))
        typed.append(full[:k] + rng.choice("aeiou") + full[k + 1 :])
    parts = names.parts_table(spark.createDataFrame([(t,) for t in typed], "name string"))
    entries = names.entries_of(roster, nick)
    weights = names.gram_weights(spark.createDataFrame([(t,) for t in typed], "name string"))
    got = {(r["form"], r["ref_id"]) for r in names.candidates(parts, entries, weights).collect()}
    vectors = {r["form"]: names.vector(r["form"], weights) for r in parts.collect()}
    for r in entries.collect():
        own = [dict(names.vector(f, weights)) for f in names.forms(names.entry_of(r["ref_id"], r["kind"], r["full_name"], r["nick"]))]
        for form, v in vectors.items():
            if max(sum(x * u.get(g, 0.0) for g, x in v) for u in own) >= names.MIN_COSINE:
                assert (form, r["ref_id"]) in got


def test_an_initial_of_two_entries_is_ambiguous_at_any_roster_size(spark):
    nick = spark.createDataFrame([], "formal string, short string")
    facts = spark.createDataFrame([(1, ["R. Carvacre"]), (2, ["Robert Carvacer"])], "id long, people array<string>")
    raw = spark.createDataFrame([], "raw_id long, people array<string>")
    for extra in (0, 400):
        roster = spark.createDataFrame([(9001, "person", "Robert Carvacre"), (9002, "person", "Richard Carvacre"), *people(extra)], "ref_id long, kind string, full_name string")
        got = {(r["rec_id"], r["ref_id"]) for r in names.found(facts, raw, roster, nick).collect()}
        assert got == {(2, 9001)}


def test_long_and_many_joined_names(spark):
    """No limit on the words of an element, nor on the names joined in one."""
    nick = spark.createDataFrame([], "formal string, short string")
    full = ["Anouk Wympstrom", "Dalia Carvacre", "Soren Opatbrook", "Leila Lindbrook", "Bjorn Hythidge", "Wendell Loxtez", "Tobias Fluxidge"]
    roster = spark.createDataFrame([(k, "person", n) for k, n in enumerate(full)], "ref_id long, kind string, full_name string")
    facts = spark.createDataFrame([(1, [" & ".join(full)])], "id long, people array<string>")
    raw = spark.createDataFrame([], "raw_id long, people array<string>")
    assert {r["ref_id"] for r in names.found(facts, raw, roster, nick).collect()} == set(range(7))


def test_average_linkage_decides_ties(spark):
    """One edit from two entries: the cluster whose members are nearer on average gets the name; without clustering nobody does."""
    entries = names.entries_of(spark.createDataFrame([(1, "person", "Jonas Carvacre"), (2, "person", "Junas Carvacre")], "ref_id long, kind string, full_name string"), spark.createDataFrame([], "formal string, short string"))
    claimed = spark.createDataFrame(
        [("Jinas Carvacre", 0, "jinas carvacre", 1, 2), ("Jinas Carvacre", 0, "jinas carvacre", 2, 2), ("Jinass Carvacre", 0, "jinass carvacre", 1, 1), ("Jinnas Carvacre", 0, "jinnas carvacre", 1, 1), ("Jinasr Carvacre", 0, "jinasr carvacre", 1, 1), ("Junnas Carvacrq", 0, "junnas carvacrq", 2, 1), ("Junaz Carvaxre", 0, "junaz carvaxre", 2, 1)],
        "name string, part int, form string, ref_id long, claims int",
    )
    weights = {"": 1.0}
    got = {(r["name"], r["ref_id"]) for r in names.average_linkage(claimed, entries, weights).collect()}
    assert ("Jinas Carvacre", 1) in got and ("Jinas Carvacre", 2) not in got
    alone = {(r["name"], r["ref_id"]) for r in claimed.filter("claims = 1").collect()}
    assert not [x for x in alone if x[0] == "Jinas Carvacre"]
