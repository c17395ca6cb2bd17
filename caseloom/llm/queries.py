"""The queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..session import table
from . import encodings, fusion, names, neardup, packing, personal, scans, splitting, tokens

REGISTRY = Registry()


@REGISTRY.add("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.found(table(spark, sf_dir, "ocr_results"), table(spark, sf_dir, "text_cache"))


@REGISTRY.add("p1_repaired")
def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired(table(spark, sf_dir, "ocr_results"), table(spark, sf_dir, "text_cache"))


FACT_TEXTS = ["fact_summary", "source_quote"]


@REGISTRY.add("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.found(table(spark, sf_dir, "facts"), "id", FACT_TEXTS)


@REGISTRY.add("p2_classes")
def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "facts"), "id", FACT_TEXTS)


@REGISTRY.add("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.found(table(spark, sf_dir, "document_extractions"))


@REGISTRY.add("p3_restored")
def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.restored(table(spark, sf_dir, "document_extractions"))


@REGISTRY.add("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.found(*(table(spark, sf_dir, t) for t in ("facts", "llm_facts", "name_roster", "nicknames")))


@REGISTRY.add("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.found(table(spark, sf_dir, "facts"), table(spark, sf_dir, "evidence_sources"))


@REGISTRY.add("p5_survivors")
def p5_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.survivors(table(spark, sf_dir, "facts"), table(spark, sf_dir, "evidence_sources"))


@REGISTRY.add("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(table(spark, sf_dir, "text_cache"), table(spark, sf_dir, "registry"), table(spark, sf_dir, "reasoner_config"))


@REGISTRY.add("p6_pieces")
def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = splitting.limits(table(spark, sf_dir, "registry"), table(spark, sf_dir, "reasoner_config"))
    texts = table(spark, sf_dir, "text_cache").join(sizes, "fingerprint", "left")  # a text without a limit is one piece
    return splitting.split(texts, "id", "extracted_text", "max_chars", "overlap")


@REGISTRY.add("p8_ids")
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


@REGISTRY.add("p9_containers")
def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = table(spark, sf_dir, "reasoner_config").filter("file_type = 'text'").agg(F.min("context_size").alias("context_size")).first()
    return packing.containers(tokens.token_counts(table(spark, sf_dir, "documents")), int(config["context_size"]))


@REGISTRY.add("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.found(*(table(spark, sf_dir, t) for t in ("documents", "name_roster", "nicknames")))


@REGISTRY.add("p10_redacted")
def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.redacted(*(table(spark, sf_dir, t) for t in ("documents", "name_roster", "nicknames")))
