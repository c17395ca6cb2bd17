"""Quality of extracted facts and of extracted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import alive, r6


def level(score: Column, good: float = 0.7, marginal: float = 0.4) -> Column:
    return F.when(score >= good, "Good").when(score >= marginal, "Marginal").otherwise("Poor")


def fact_quality(facts: DataFrame) -> DataFrame:
    """Each fact's overall quality from confidence, coverage of its evidence, density of people, and its quote; issues; whether to try again. Lengths are bytes."""
    src = F.greatest(F.octet_length(F.coalesce("evidence_full", "source_quote", F.lit(""))), F.lit(1))
    summary, quote = F.octet_length(F.coalesce("fact_summary", F.lit(""))), F.octet_length(F.coalesce("source_quote", F.lit("")))
    people = F.greatest(F.coalesce(F.size("people"), F.lit(0)), F.lit(0))
    f = facts.filter(alive()).select(
        "id", F.least(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("c"), F.least(summary / src, F.lit(1.0)).alias("coverage"), (1000.0 * people / src).alias("density"),
        F.coalesce(F.least(F.try_divide(quote, summary), F.lit(1.0)), F.lit(0.0)).alias("quoted"), quote.alias("q"), summary.alias("s"), people.alias("p"),
    )
    overall = 0.4 * F.col("c") + 0.2 * F.col("coverage") + 0.2 * F.least("density", F.lit(10.0)) / 10 + 0.2 * F.col("quoted")
    issues = F.array_compact(F.array(F.when(F.col("c") < 0.5, "LowConfidence"), F.when(F.col("q") < 10, "ShortQuote"), F.when(F.col("coverage") < 0.1, "PoorCoverage"), F.when((F.col("s") > 0) & (F.col("p") == 0), "EntityMismatch")))
    out = f.withColumn("overall", r6(overall)).withColumn("issues", F.array_join(issues, ","))
    return out.select("id", "overall", level(F.col("overall")).alias("level"), "issues", ((F.col("overall") < 0.5) | (F.col("c") < 0.5) | (F.col("coverage") < 0.1)).alias("retry"))


def text_quality(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Confidence in an extracted text, and whether it rather is a scan: by its bytes and the mean length of its words."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    n = F.octet_length(t)
    tokens = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    k = F.size(tokens)
    mean = F.coalesce(F.try_divide(F.length(F.regexp_replace(t, r"\s+", "")), k), F.lit(0.0))
    blank = ~t.rlike(r"[^\s\p{Punct}]")
    score = F.when(n < 100, 0.3).when(n < 500, 0.7).otherwise(1.0) * F.when((n < 50) | blank, 0.2).otherwise(1.0) * F.when(mean > 20, 0.5).otherwise(1.0)
    return texts.select(F.col(id_col).alias("id"), r6(score).alias("confidence"), ((n < 50) | blank).alias("scanned"), k.alias("words"))
