"""Incremental ingestion and running statistics with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import Extractor, extract, fingerprint
from ..functions.scalar import file_kind


def watch(spark: SparkSession, root: str, files_per_trigger: int = 1000) -> DataFrame:
    """New files under root as a stream of rows."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    df = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return df.withColumns({"file_name": name, "kind": file_kind(F.regexp_extract(name, r"\.([^./]+)$", 1)), "fingerprint": fingerprint(F.col("content"))})


def ingest(spark: SparkSession, root: str, target: str, checkpoint: str, hooks: dict[str, Extractor] | None = None) -> StreamingQuery:
    """Extracts the text of all new files once and appends it to target/text_cache; contents that are there already are left out. Ends when all present files are done."""

    def batch(df: DataFrame, _: int) -> None:
        first = df.groupBy("fingerprint").agg(F.min_by(F.struct("path", "file_name", "kind", "content"), "path").alias("r")).select("fingerprint", "r.*")
        try:
            known = df.sparkSession.read.parquet(f"{target}/text_cache").select("fingerprint").distinct()
            first = first.join(known, "fingerprint", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        texts = extract(first, hooks).join(first.select("path", "fingerprint"), "path")
        texts.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(f"{target}/text_cache")

    return watch(spark, root).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, value: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and means by window and key of a stream (or table) of events; rows later than the watermark are dropped from a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean")).select(F.col("w.start").alias("start"), key, "n", "mean")
