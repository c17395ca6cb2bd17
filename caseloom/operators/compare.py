"""Comparing cases: shared entities, dates and facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import alive, parsed_location, r6
from .graph import file_facts, nearby


def shared_entities(facts1: DataFrame, entities1: DataFrame, facts2: DataFrame, entities2: DataFrame) -> DataFrame:
    """Entity values of both cases, with the facts they occur in in each."""

    def per(f: DataFrame, e: DataFrame, n: str) -> DataFrame:
        return e.filter("value is not null").select("value", "fingerprint", F.lower("entity_type").alias("t")).join(file_facts(f), "fingerprint").groupBy("value").agg(F.sum("co").alias(n), F.min("t").alias(f"type_{n}"))

    return per(facts1, entities1, "n1").join(per(facts2, entities2, "n2"), "value").select("value", F.col("type_n1").alias("entity_type"), "n1", "n2")


def date_correlation(facts1: DataFrame, facts2: DataFrame) -> DataFrame:
    """One row: dates of both cases, of either, their Jaccard similarity, and both ranges."""

    def days(f: DataFrame, n: str) -> DataFrame:
        return f.filter(alive() & F.col("associated_date").isNotNull()).select(F.col("associated_date").alias("d")).distinct().withColumn(n, F.lit(1))

    both = days(facts1, "a").join(days(facts2, "b"), "d", "full")
    out = both.agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("aligned"), F.count(F.lit(1)).alias("either"), F.min(F.when(F.col("a") == 1, F.col("d"))).alias("first1"), F.max(F.when(F.col("a") == 1, F.col("d"))).alias("last1"),
        F.min(F.when(F.col("b") == 1, F.col("d"))).alias("first2"), F.max(F.when(F.col("b") == 1, F.col("d"))).alias("last2"),
    )
    return out.withColumn("correlation", r6(F.coalesce(F.try_divide("aligned", "either"), F.lit(0.0))))


def entity_similarity(entities1: DataFrame, entities2: DataFrame) -> DataFrame:
    """One row: different values of each case, common ones, and their Dice similarity."""
    a = entities1.filter("value is not null").select("value").distinct().withColumn("a", F.lit(1))
    b = entities2.filter("value is not null").select("value").distinct().withColumn("b", F.lit(1))
    out = a.join(b, "value", "full").agg(F.count("a").alias("n1"), F.count("b").alias("n2"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"))
    return out.withColumn("dice", r6(F.coalesce(F.try_divide(2 * F.col("common"), F.col("n1") + F.col("n2")), F.lit(0.0))))


def across(cases: dict[str, DataFrame], column: str = "value", least: int = 2) -> DataFrame:
    """Values that occur in several cases, with those."""
    every = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("case"), F.col(column).alias("value")).distinct() for name, df in cases.items()])
    return every.filter("value is not null").groupBy("value").agg(F.array_join(F.array_sort(F.collect_set("case")), ",").alias("cases"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def matching_facts(facts1: DataFrame, facts2: DataFrame) -> DataFrame:
    """Summaries, apart from case and blanks, that both cases hold."""

    def per(f: DataFrame, n: str) -> DataFrame:
        return f.filter(alive() & F.col("fact_summary").isNotNull()).groupBy(F.trim(F.regexp_replace(F.lower("fact_summary"), r"\s+", " ")).alias("summary")).agg(F.count(F.lit(1)).alias(n))

    return per(facts1, "n1").join(per(facts2, "n2"), "summary")


def near_places(entities1: DataFrame, entities2: DataFrame, km: float) -> DataFrame:
    """Places of the first case (location values with coordinates) within km of places of the second."""

    def places(e: DataFrame, case: int) -> DataFrame:
        p = e.filter(F.lower("entity_type") == "location").select("value", parsed_location("value").alias("p")).filter("p is not null").select("value", "p.lat", "p.lon").distinct()
        return p.select(F.struct(F.lit(case).alias("case"), "value").alias("id"), "lat", "lon")

    near = nearby(places(entities1, 1).unionByName(places(entities2, 2)), km).filter("id_a.case = 1 and id_b.case = 2")
    return near.select(F.col("id_a.value").alias("place1"), F.col("id_b.value").alias("place2"), "km")
