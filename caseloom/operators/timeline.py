"""Timelines, anchored clusters and temporal anomalies."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import alive, r6, to_day


def events(facts: DataFrame, start: str | None = None, end: str | None = None, limit: int = 1000) -> DataFrame:
    """Facts in the order of their date as text, both ends included."""
    d = F.col("associated_date")
    df = facts.filter(alive() & d.isNotNull())
    if start:
        df = df.filter(d >= start)
    if end:
        df = df.filter(d <= end)
    return df.select("id", "associated_date", "fact_summary", "category", "severity_score").orderBy("associated_date", "id").limit(limit)


def clusters(facts: DataFrame, days: int) -> DataFrame:
    """Clusters along time: a new one begins when an event is more than `days` after the first of the present one.

    Events are first counted by day; the fold runs over days, of which there are at most as many as the calendar has, never over events.
    """
    daily = facts.filter(alive()).select(to_day("associated_date").alias("day"), "id", "severity_score").filter("day is not null").groupBy("day").agg(
        F.count(F.lit(1)).alias("n"), F.max("severity_score").alias("top_severity"), F.min("id").alias("first_id")
    )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: date | None = None
        for b in batches:
            starts = []
            for d in b.column("day").to_pylist():
                if first is None or (d - first).days > days:
                    first = d
                starts.append(first)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(starts, pa.date32())], names=[*b.schema.names, "cluster_start"])

    ordered = daily.repartition(1).sortWithinPartitions("day")  # after the aggregate: a row for each day
    schema = "day date, n bigint, top_severity int, first_id bigint, cluster_start date"
    return ordered.mapInArrow(fold, schema).groupBy("cluster_start").agg(F.max("day").alias("cluster_end"), F.sum("n").alias("n"), F.max("top_severity").alias("top_severity"), F.count(F.lit(1)).alias("days"))


def cluster_events(facts: DataFrame, days: int) -> DataFrame:
    """Each dated event with its cluster, joined on the day ranges (days are few)."""
    c = clusters(facts, days)
    spans = c.select("cluster_start", F.explode(F.sequence("cluster_start", "cluster_end")).alias("day"))
    dated = facts.filter(alive()).select("id", to_day("associated_date").alias("day"), "severity_score").filter("day is not null")
    return dated.join(spans, "day")


def anomalies(facts: DataFrame, window_days: int, severity_threshold: float) -> DataFrame:
    """Days whose mean severity around them is above a threshold, with the deviation of their count over all days.

    The window is of rows (days with facts): window_days before, the day itself and window_days - 1 after; none for 0.
    """
    daily = facts.filter(alive()).select(to_day("associated_date").alias("day"), "severity_score").filter("day is not null").groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.avg("severity_score").alias("mean_severity"))
    near = Window.orderBy("day").rowsBetween(-window_days, window_days - 1)
    every = Window.partitionBy()
    local = F.coalesce(F.avg("mean_severity").over(near), F.lit(0.0)) if window_days else F.lit(0.0)
    out = daily.withColumn("local_severity", local).withColumn("deviation", F.try_divide(F.col("n") - F.avg("n").over(every), F.stddev_pop("n").over(every)))
    return out.filter(F.col("local_severity") > severity_threshold).select("day", "n", r6(F.col("local_severity")).alias("local_severity"), r6(F.col("deviation")).alias("deviation"))


def hour_pattern(facts: DataFrame) -> DataFrame:
    """Facts by the hour they were recorded."""
    return facts.filter(alive() & F.col("created_at").isNotNull()).groupBy(F.hour("created_at").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def date_consistency(facts: DataFrame) -> DataFrame:
    """By file: the share of dated facts that lie before they were recorded, and how many lie after (backdating or mistakes)."""
    dated = facts.filter(alive()).select("fingerprint", to_day("associated_date").alias("day"), F.col("created_at").cast("date").alias("made")).filter("day is not null and made is not null")
    return dated.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("dated"), F.count_if(F.col("day") > F.col("made")).alias("after_record"), r6(F.avg(F.when(F.col("day") <= F.col("made"), 1.0).otherwise(0.0))).alias("consistency"))


def backdating(facts: DataFrame, days: int = 1) -> DataFrame:
    """Facts whose date lies after the day they were recorded, with by how many days, whether that is more than `days` (flagged), and how sure that is (a year and more: 1)."""
    dated = facts.filter(alive()).select("id", "fingerprint", to_day("associated_date").alias("day"), F.col("created_at").cast("date").alias("made")).filter("day is not null and made is not null")
    ahead = F.date_diff("day", "made")
    return dated.withColumn("days_ahead", ahead).filter("days_ahead > 0").select("id", "fingerprint", "days_ahead", (F.col("days_ahead") > days).alias("flagged"), r6(F.least(F.col("days_ahead") / 365.0, F.lit(1.0))).alias("confidence"))
