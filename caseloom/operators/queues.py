"""Work queues, listings, tags and result filters. Limits are the feature; ties end by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import alive


def _false(name: str) -> Column:
    return ~F.coalesce(F.col(name), F.lit(False))


def _ordered(df: DataFrame) -> DataFrame:
    return df.orderBy(F.asc_nulls_first("processing_priority"), F.desc_nulls_last("last_modified"), "id")


FIELDS = ["id", "fingerprint", "file_name", "file_type", "processing_priority", "last_modified"]


def unprocessed(registry: DataFrame, limit: int) -> DataFrame:
    return registry.filter(_false("processed")).select(*FIELDS).orderBy("id").limit(limit)


def extraction_queue(registry: DataFrame, limit: int) -> DataFrame:
    return _ordered(registry.filter(_false("has_extracted_text")).select(*FIELDS)).limit(limit)


def analysis_queue(registry: DataFrame, limit: int) -> DataFrame:
    return _ordered(registry.filter(F.col("has_extracted_text") & _false("processed")).select(*FIELDS)).limit(limit)


def priority_queue(registry: DataFrame, limit: int) -> DataFrame:
    return _ordered(registry.select(*FIELDS)).limit(limit)


def listing(facts: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of facts, most severe and latest first."""
    return facts.filter(alive()).select("id", "fact_summary", "category", "severity_score", "created_at").orderBy(F.desc_nulls_last("severity_score"), F.desc_nulls_last("created_at"), "id").offset(offset).limit(limit)


def pending_errors(errors: DataFrame, limit: int) -> DataFrame:
    return errors.filter(_false("resolved") & (F.col("next_attempt") <= F.current_timestamp())).orderBy("next_attempt", "id").limit(limit)


def active_checkpoint(checkpoints: DataFrame, job_type: str) -> DataFrame:
    """The newest running checkpoint of a job type."""
    return checkpoints.filter((F.col("status") == "running") & (F.col("job_type") == job_type)).orderBy(F.desc("created_at"), F.desc("id")).limit(1)


def annotations_of(annotations: DataFrame, fact_id: int) -> DataFrame:
    return annotations.filter(F.col("intelligence_id") == fact_id).orderBy(F.desc("created_at"), F.desc("id"))


def by_key(df: DataFrame, key: str, value: object) -> DataFrame:
    """Point look-up of one row."""
    return df.filter(F.col(key) == F.lit(value)).limit(1)


def clean_tags(tags: Column) -> Column:
    """Tags without blanks around them, empty ones and repetitions, in their order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != "")))


def search_by_tags(facts: DataFrame, tags: list[str], match_all: bool, limit: int, substring: bool = False) -> DataFrame:
    """Facts with any or all tags, whole or as part of a tag; no tags give no rows."""
    own = clean_tags(F.col("tags"))

    def hit(t: str) -> Column:
        return F.exists(own, lambda x: x.contains(t) if substring else x == t)

    hits = [hit(t) for t in tags]
    cond = F.lit(bool(hits) and match_all)
    for h in hits:
        cond = (cond & h) if match_all else (cond | h)
    return facts.filter(alive() & cond).select("id", "fact_summary", "category", "severity_score", F.lit(0.0).alias("rank")).orderBy("id").limit(limit)


def all_tags(facts: DataFrame) -> DataFrame:
    return facts.select(F.explode(clean_tags(F.col("tags"))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy("tag")


def tag_added(tags: Column, tag: str) -> Column:
    return F.array_union(clean_tags(tags), F.array(F.lit(tag.strip())))


def tag_removed(tags: Column, tag: str) -> Column:
    return F.array_remove(clean_tags(tags), tag.strip())


def result_filter(facts: DataFrame, text: str, by_severity: bool = True, limit: int = 500) -> DataFrame:
    """Facts whose summary, category or crime holds a text, apart from case."""
    q = text.lower()
    hit = F.lit(False)
    for col in ("fact_summary", "category", "identified_crime"):
        hit = hit | F.coalesce(F.lower(col).contains(q), F.lit(False))
    order = [F.desc_nulls_last("severity_score")] if by_severity else [F.desc_nulls_last("created_at")]
    return facts.filter(alive() & hit).select("id", "fact_summary", "category", "severity_score", "created_at").orderBy(*order, "id").limit(limit)


def severity_band(severity: Column) -> Column:
    return F.when(severity >= 8, "critical").when(severity >= 6, "high").when(severity >= 4, "medium").otherwise("low")


def deviation_band(z: Column) -> Column:
    return F.when(F.abs(z) > 3, "extreme").when(F.abs(z) > 2, "strong").otherwise("mild")
