"""Counts, distributions and state summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import alive, r6, to_day


def registry_counts(registry: DataFrame, facts: DataFrame, text_cache: DataFrame) -> DataFrame:
    """How many files are registered and processed, facts (deleted ones too) and cached texts: one row."""
    a = registry.agg(F.count(F.lit(1)).alias("registered"), F.count_if(F.coalesce("processed", F.lit(False))).alias("processed"))
    b = facts.agg(F.count(F.lit(1)).alias("facts"))
    return a.crossJoin(b).crossJoin(text_cache.agg(F.count(F.lit(1)).alias("texts")))  # of single rows


def workflow_state(registry: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: counts, latest times, and the stage reached (analyzed, extracted, scanned, none)."""
    r = registry.agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.coalesce("has_extracted_text", F.lit(False))).alias("extracted"), F.count_if(F.coalesce("processed", F.lit(False))).alias("analyzed"),
        F.max("created_at").alias("last_scan"), F.max(F.when(F.col("has_extracted_text"), F.col("extracted_at"))).alias("last_extraction"), F.max(F.when(F.col("processed"), F.col("processed_at"))).alias("last_analysis"),
    )
    stage = F.when((F.col("analyzed") > 0) | (F.col("facts") > 0), "analyzed").when(F.col("extracted") > 0, "extracted").when(F.col("files") > 0, "scanned").otherwise("none")
    return r.crossJoin(facts.agg(F.count(F.lit(1)).alias("facts"))).withColumn("stage", stage)


def extraction_statistics(text_cache: DataFrame, registry: DataFrame, partial_below: float = 0.7) -> DataFrame:
    """By file type: texts, characters, mean length and quality, and how many are partial. A fingerprint counts with one type."""
    types = registry.groupBy("fingerprint").agg(F.min("file_type").alias("file_type"))
    return (
        text_cache.select("fingerprint", F.length("extracted_text").alias("n"), "quality_score")
        .join(types, "fingerprint")
        .groupBy("file_type")
        .agg(
            F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("characters"), r6(F.coalesce(F.try_divide(F.sum("n"), F.count(F.lit(1))), F.lit(0.0))).alias("mean_characters"),
            r6(F.coalesce(F.avg("quality_score"), F.lit(0.0))).alias("mean_quality"), F.count_if(F.col("quality_score") < partial_below).alias("partial"),
        )
    )


def type_map(registry: DataFrame) -> DataFrame:
    """One row: a map of file type to count (types are few); null types are left out."""
    return registry.filter("file_type is not null").groupBy("file_type").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("file_type", "count")))).alias("files_by_type"))


def category_distribution(facts: DataFrame) -> DataFrame:
    return (
        facts.filter(alive() & F.col("category").isNotNull()).groupBy("category")
        .agg(F.count(F.lit(1)).alias("n"), r6(F.avg("severity_score")).alias("mean_severity"), r6(F.avg("confidence")).alias("mean_confidence")).orderBy(F.desc("n"), "category")
    )


def severity_distribution(facts: DataFrame) -> DataFrame:
    return facts.filter(alive()).groupBy("severity_score").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("severity_score"))


def entity_type_distribution(entities: DataFrame) -> DataFrame:
    return entities.groupBy(F.lower("entity_type").alias("entity_type")).agg(F.countDistinct("value").alias("different_values"), F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), "entity_type")


def overall_statistics(facts: DataFrame, entities: DataFrame, chains: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """One row; means over no rows are null. With chains and links, their counts too."""
    f = facts.filter(alive()).agg(F.count(F.lit(1)).alias("facts"), r6(F.avg("severity_score")).alias("mean_severity"), r6(F.avg("confidence")).alias("mean_confidence"), r6(F.avg("quality_score")).alias("mean_quality"))
    out = f.crossJoin(entities.agg(F.count(F.lit(1)).alias("entities"), F.countDistinct("value").alias("different_entities")))  # of single rows
    for name, t in (("chains", chains), ("links", links)):
        out = out if t is None else out.crossJoin(t.agg(F.count(F.lit(1)).alias(name)))
    return out


def date_distribution(facts: DataFrame, limit: int = 24) -> DataFrame:
    """The latest months with their facts; unreadable dates are left out."""
    month = F.date_format(to_day("associated_date"), "yyyy-MM")
    return facts.filter(alive()).withColumn("month", month).filter("month is not null").groupBy("month").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("severity_score")).alias("mean_severity")).orderBy(F.desc("month")).limit(limit)


def project_summary(facts: DataFrame, entities: DataFrame, cap: int = 1000) -> DataFrame:
    """One row: facts, entities, and timeline rows (at most cap are shown)."""
    f = facts.agg(F.count_if(alive()).alias("facts"), F.least(F.count_if(alive() & F.col("associated_date").isNotNull()), F.lit(cap)).cast("long").alias("timeline_rows"))
    return f.crossJoin(entities.agg(F.count(F.lit(1)).alias("entities")))


def quality_rollup(facts: DataFrame) -> DataFrame:
    """By file: mean confidence, people named, share of facts with a quote."""
    return facts.filter(alive()).groupBy("fingerprint").agg(
        r6(F.coalesce(F.avg("confidence"), F.lit(0.0))).alias("mean_confidence"), F.sum(F.coalesce(F.greatest(F.size("people"), F.lit(0)), F.lit(0))).cast("long").alias("people_named"),
        r6(F.avg(F.when(F.coalesce("source_quote", F.lit("")) != "", 1.0).otherwise(0.0))).alias("quoted"),
    )


def by_month(facts: DataFrame, most: int = 10) -> DataFrame:
    """Facts by the first seven signs of their date, latest first, with the ids of the `most` most severe (joined by commas, the most severe first)."""
    dated = facts.filter(alive() & F.col("associated_date").isNotNull()).select(F.substring("associated_date", 1, 7).alias("month"), "id", F.coalesce("severity_score", F.lit(0)).alias("s"))
    per = dated.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.max("s").alias("top_severity"), F.min("id").alias("first_id"))
    # ranked within parts of each month first, so a hot month isn't sorted in one task
    part = Window.partitionBy("month", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy(F.desc("s"), "id")
    best = dated.withColumn("r", F.row_number().over(part)).filter(F.col("r") <= most)
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("month").orderBy(F.desc("s"), "id"))).filter(F.col("r") <= most)
    ids = best.groupBy("month").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"].cast("string")), ",").alias("top_ids"))
    return per.join(ids, "month").orderBy(F.desc("month"))


def facets(facts: DataFrame) -> DataFrame:
    """Faceted counts by category, severity and language in one pass (grouping sets)."""
    facts.filter(alive()).createOrReplaceTempView("__facets")
    return facts.sparkSession.sql(
        "select case when grouping(category) = 0 then 'category' when grouping(severity_score) = 0 then 'severity' else 'language' end as facet,"
        " coalesce(category, cast(severity_score as string), source_language, '') as value, count(*) as n from __facets group by grouping sets ((category), (severity_score), (source_language))"
    )


def batch_outcome(results: DataFrame, status: str = "status") -> DataFrame:
    """One row: successes and errors of a batch."""
    return results.agg(F.count_if(F.col(status) == "ok").alias("successes"), F.count_if(F.col(status) != "ok").alias("errors"))
