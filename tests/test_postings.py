"""The inverted index covers every column that a search of facts looks at."""

from __future__ import annotations

from caseloom.operators import search

SCHEMA = "id bigint, fact_summary string, source_quote string, category string"


def index(df):
    return {(r["column"], r.term, r.doc): (r.tf, r.positions) for r in search.postings(df, "id", search.FACT_COLUMNS).collect()}


def test_postings_of_all_columns(spark):
    df = spark.createDataFrame([(1, "Wire to Zürich, wire back", "no wire", "finance"), (2, None, "", "Travel costs")], SCHEMA)
    assert index(df) == {
        ("fact_summary", "wire", 1): (2, [0, 3]),
        ("fact_summary", "to", 1): (1, [1]),
        ("fact_summary", "zurich", 1): (1, [2]),
        ("fact_summary", "back", 1): (1, [4]),
        ("source_quote", "no", 1): (1, [0]),
        ("source_quote", "wire", 1): (1, [1]),
        ("category", "finance", 1): (1, [0]),
        ("category", "travel", 2): (1, [0]),
        ("category", "costs", 2): (1, [1]),
    }


def test_postings_of_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b", None, "x"), (1, "b", None, "x")], SCHEMA)
    assert index(df) == {("fact_summary", "a", 1): (1, [0]), ("fact_summary", "b", 1): (2, [0, 1]), ("category", "x", 1): (2, [0, 0])}


def test_registered_query_indexes_them(spark, tmp_path):
    from caseloom.plans.core import REGISTRY

    spark.createDataFrame([(1, "wire transfer", "a quote", "finance")], SCHEMA).write.parquet(str(tmp_path / "facts.parquet"))
    assert {(r["column"], r.term) for r in REGISTRY.queries["f7_postings"](spark, str(tmp_path)).collect()} == {("fact_summary", "wire"), ("fact_summary", "transfer"), ("source_quote", "a"), ("source_quote", "quote"), ("category", "finance")}


def test_accents_fold_to_their_letters(spark):
    df = spark.createDataFrame([(1, "où août Dvořák ťava ýmir źle śnieg", None, None)], SCHEMA)
    assert {r.term for r in search.postings(df, "id", search.FACT_COLUMNS).collect()} == {"ou", "aout", "dvorak", "tava", "ymir", "zle", "snieg"}
