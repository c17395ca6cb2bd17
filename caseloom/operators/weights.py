"""Evidence weights, corroboration and quote checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import alive, r6, weight


def weighted(facts: DataFrame, min_weight: float = 0.0, limit: int = 1000, cap: bool = False) -> DataFrame:
    """The heaviest facts of at least min_weight."""
    w = facts.filter(alive()).withColumn("weight", weight(cap)).filter(F.col("weight") >= min_weight)
    return w.select("id", "fingerprint", "filename", "fact_summary", "category", "severity_score", "confidence", "quality_score", r6(F.col("weight")).alias("weight"), "created_at").orderBy(F.desc("weight"), "id").limit(limit)


def custom_weighted(facts: DataFrame, reliability: DataFrame) -> DataFrame:
    """Weights times the reliability of the source (fingerprint, reliability; 1 where none is given), with a label."""
    w = facts.filter(alive()).join(reliability, "fingerprint", "left").withColumn("w", weight(True) * F.coalesce("reliability", F.lit(1.0)))
    return w.select("id", F.round("w", 9).alias("weight"), F.when(F.col("w") >= 0.6, "primary").otherwise("secondary").alias("label"))


def corroboration(facts: DataFrame, min_sources: int = 2) -> DataFrame:
    """Summaries, apart from case and blanks, that several files hold; contradicted if their severities lie five or more apart."""
    key = F.trim(F.regexp_replace(F.lower("fact_summary"), r"\s+", " "))
    g = facts.filter(alive() & F.col("fact_summary").isNotNull()).groupBy(key.alias("summary")).agg(
        F.countDistinct("fingerprint").alias("sources"), F.count(F.lit(1)).alias("facts"), (F.max("severity_score") - F.min("severity_score")).alias("spread")
    )
    return g.filter(F.col("sources") >= min_sources).select("summary", "sources", "facts", (F.coalesce("spread", F.lit(0)) >= 5).alias("contradicted"))


def quote_checks(facts: DataFrame, text_cache: DataFrame) -> DataFrame:
    """Facts with a quote: does the file's text hold it (found), and does the quote hold the summary (holds_summary)? A file extracted more than once counts if any of its texts does.

    Each different quote of a file is looked up once; rows of facts never carry a text.
    """
    texts = text_cache.filter("extracted_text is not null").select("fingerprint", "extracted_text")
    quoted = facts.filter(alive() & (F.coalesce("source_quote", F.lit("")) != "")).select("id", "fingerprint", "source_quote", "fact_summary")
    checked = quoted.select("fingerprint", "source_quote").distinct().join(texts, "fingerprint").groupBy("fingerprint", "source_quote").agg(F.max(F.col("extracted_text").contains(F.col("source_quote"))).alias("found"))
    holds = F.coalesce(F.lower("source_quote").contains(F.lower("fact_summary")), F.lit(False))
    return quoted.join(checked, ["fingerprint", "source_quote"]).select("id", "found", holds.alias("holds_summary"))
