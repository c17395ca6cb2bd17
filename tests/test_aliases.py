"""Short forms of names are matched whatever stands around given name and surname."""

from __future__ import annotations

from caseloom.operators import graph


def pairs(spark, *values):
    df = spark.createDataFrame([("Person", v) for v in values], "entity_type string, value string")
    return sorted((r.alias_value, r.value) for r in graph.alias_matches(df).collect())


def test_middle_initials_agree_or_are_absent(spark):
    assert pairs(spark, "R. Bexlenko", "R D Bexlenko", "R. Q. Bexlenko", "Robert D Bexlenko", "Robert Bexlenko", "Rita Dana Bexlenko") == [
        ("R D Bexlenko", "Rita Dana Bexlenko"),
        ("R D Bexlenko", "Robert Bexlenko"),
        ("R D Bexlenko", "Robert D Bexlenko"),
        ("R. Bexlenko", "Rita Dana Bexlenko"),
        ("R. Bexlenko", "Robert Bexlenko"),
        ("R. Bexlenko", "Robert D Bexlenko"),
        ("R. Q. Bexlenko", "Robert Bexlenko"),
    ]


def test_titles_roles_and_notes(spark):
    long = ["Dr. Björn Draysen", "Prof. Björn Draysen (witness)", "Mr Björn Draysen, CFO", "Björn Draysen Jr."]
    assert pairs(spark, "B. Draysen", *long) == sorted(("B. Draysen", x) for x in long)


def test_surname_first(spark):
    long = ["Draysen, Björn", "DRAYSEN Björn", "Björn Draysen"]
    short = ["Draysen, B.", "B Draysen", "BK Draysen", "B.K. Draysen", "Draysen B", "Dr. B. Draysen"]
    assert pairs(spark, *long, *short) == sorted((s, x) for s in short for x in long)


def test_no_pair(spark):
    assert pairs(spark, "B.", "Draysen", "", "Dr.", "(witness)", "C. Draysen", "B. Other", "Björn Draysen", "John Lord", "K. Lord") == []


def test_initials_like_a_title(spark):
    assert pairs(spark, "MR Draysen", "Martin Draysen", "Mr Martin R. Draysen") == [("MR Draysen", "Martin Draysen"), ("MR Draysen", "Mr Martin R. Draysen")]
