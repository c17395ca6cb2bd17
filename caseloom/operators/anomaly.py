"""Outliers by z-score and quartiles, and suspicious patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import alive, r6

METRICS = {"severity": "severity_score", "confidence": "confidence", "quality": "quality_score"}


def z_scores(df: DataFrame, metric: str, least: float, keep: list[str]) -> DataFrame:
    """Rows whose population z-score is above `least` in absolute value. Mean and deviation are one aggregated row, not a window over all rows."""
    some = df.filter(F.col(metric).isNotNull()).select(*keep, F.col(metric).cast("double").alias("value"))
    one = some.agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    z = some.crossJoin(F.broadcast(one)).withColumn("z", F.try_divide(F.col("value") - F.col("mean"), F.col("sd")))  # with a single row
    return z.filter(F.abs("z") > least).select(*keep, "value", r6(F.col("mean")).alias("mean"), r6(F.col("z")).alias("z"))


def fact_anomalies(facts: DataFrame, metric: str, least: float) -> DataFrame:
    """Unknown metrics give no rows."""
    if metric not in METRICS:
        return facts.filter(F.lit(False)).select("id", F.lit(0.0).alias("value"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("z"))
    return z_scores(facts.filter(alive()), METRICS[metric], least, ["id"])


def size_anomalies(registry: DataFrame, least: float = 2.5) -> DataFrame:
    return z_scores(registry, "file_size", least, ["id"]).withColumn("score", r6(F.least(F.abs("z") / 5.0, F.lit(1.0))))


def severity_outliers(facts: DataFrame) -> DataFrame:
    """Facts outside the quartile fences of their file; quartiles are picked by rank; files under four facts have none.

    Severities are counted by file and value first, so a file's row is at most as long as the scale has values.
    """
    base = facts.filter(alive() & F.col("severity_score").isNotNull()).select("id", "fingerprint", "severity_score")
    counted = base.groupBy("fingerprint", "severity_score").agg(F.count(F.lit(1)).alias("k"))
    per = counted.groupBy("fingerprint").agg(F.array_sort(F.collect_list(F.struct(F.col("severity_score").alias("v"), "k"))).alias("h"), F.sum("k").alias("n")).filter("n >= 4")
    pick = "aggregate(h, named_struct('left', {at}, 'v', cast(null as int)), (s, x) -> if(s.v is not null, s, if(s.left < x.k, named_struct('left', s.left, 'v', x.v), named_struct('left', s.left - x.k, 'v', cast(null as int))))).v"
    q = per.select("fingerprint", F.expr(pick.format(at="n div 4")).alias("q1"), F.expr(pick.format(at="(3 * n) div 4")).alias("q3"))
    fences = q.select("fingerprint", F.expr("greatest(cast(q1 - 1.5 * (q3 - q1) as int), 0)").alias("low"), F.expr("least(cast(q3 + 1.5 * (q3 - q1) as int), 10)").alias("high"))
    v = F.col("severity_score")
    out = base.join(fences, "fingerprint").filter((v < F.col("low")) | (v > F.col("high")))
    return out.select("id", "severity_score", "low", "high", r6(F.least(F.greatest(F.col("low") - v, v - F.col("high")) / 5.0, F.lit(1.0))).alias("score"))


def repeated_hashes(facts: DataFrame, more_than: int = 5) -> DataFrame:
    g = facts.filter("evidence_hash is not null").groupBy("evidence_hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > more_than)
    return g.withColumn("score", r6(F.least(F.col("n") / 20.0, F.lit(1.0))))


def frequent_pairs(pairs: DataFrame, times: float = 3.0) -> DataFrame:
    """Pairs (a, b, n) seen more than so many times as often as the mean pair."""
    one = pairs.agg(F.avg("n").alias("mean"))
    return pairs.crossJoin(F.broadcast(one)).filter(F.col("n") > times * F.col("mean")).select("a", "b", "n", r6(F.least(F.col("n") / (5 * F.col("mean")), F.lit(1.0))).alias("score"))
