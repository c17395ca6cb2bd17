"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timestamps import readings
from ..session import table
from .registry import Registry

REGISTRY = Registry()


@REGISTRY.add("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "evidence_sources")
    facts = readings(table(spark, sf_dir, "facts").select("id", "filename", "associated_date"), "associated_date", "filename", sources)
    raw = readings(table(spark, sf_dir, "llm_facts").select("raw_id", "source", "date"), "date", "source", sources)
    return facts.select(F.lit("facts").alias("tab"), F.col("id").alias("rec_id"), "normal_form").unionByName(raw.select(F.lit("llm_facts").alias("tab"), F.col("raw_id").alias("rec_id"), "normal_form"))
