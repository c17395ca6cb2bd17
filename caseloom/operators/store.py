"""Tables as append-only files: inserts, upserts, status events, logs, queues, backups."""

from __future__ import annotations

import json
import shutil
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of new to append: the first by order of each key that old hasn't."""
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*new.columns), order).alias("r")).select("r.*")
    return first.join(old.select(*keys).distinct(), keys, "left_anti")


def latest(df: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    """The last row of each key. Aggregated with partial maxima, so a hot key isn't sorted in one task."""
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows in place of those of the same keys; unlisted columns of a replaced row become null. Of several new rows of a key, the last in `seq` holds."""
    seq = "seq" if "seq" in new.columns else None
    n = latest(new, keys, seq) if seq else latest(new, keys, F.struct(*[F.col(c).cast("string") for c in new.columns]))
    return old.join(n.select(*keys).distinct(), keys, "left_anti").unionByName(n.drop("seq"), allowMissingColumns=True)


def apply_status(registry: DataFrame, events: DataFrame) -> DataFrame:
    """The registry after status events (fingerprint, status 'extracted' or 'processed', partial, at): flags, times and quality (0.5 if partial, else 1)."""
    e = events.groupBy("fingerprint").agg(
        F.max(F.when(F.col("status") == "extracted", F.col("at"))).alias("__e"), F.max(F.when(F.col("status") == "processed", F.col("at"))).alias("__p"), F.max_by("partial", F.when(F.col("status") == "extracted", F.col("at"))).alias("__x")
    )
    return (
        registry.join(e, "fingerprint", "left")
        .withColumn("has_extracted_text", F.coalesce("has_extracted_text", F.lit(False)) | F.col("__e").isNotNull()).withColumn("extracted_at", F.coalesce("__e", "extracted_at"))
        .withColumn("processed", F.coalesce("processed", F.lit(False)) | F.col("__p").isNotNull()).withColumn("processed_at", F.coalesce("__p", "processed_at"))
        .withColumn("extraction_quality", F.when(F.col("__e").isNotNull(), F.when(F.col("__x"), 0.5).otherwise(1.0)).otherwise(F.col("extraction_quality"))).drop("__e", "__p", "__x").select(*registry.columns)
    )


def log(spark: SparkSession, path: str, rows: list[tuple], schema: str) -> None:
    """Appends rows to a log table."""
    spark.createDataFrame(rows, schema).write.mode("append").parquet(path)


def job_states(log_table: DataFrame) -> DataFrame:
    """The latest state of each job of a checkpoint log (job_id, status, processed, at)."""
    return latest(log_table, ["job_id"], "at")


def error_states(log_table: DataFrame, max_retries: int = 3) -> DataFrame:
    """The latest row of each error, due again after twice its retries in minutes; resolved ones and those out of retries aren't due."""
    last = latest(log_table, ["error_id"], "at")
    due = F.expr("at + make_dt_interval(0, 0, greatest(retry_count, 0) * 2, 0)")
    return last.withColumn("next_attempt", due).withColumn("open", ~F.coalesce("resolved", F.lit(False)) & (F.col("retry_count") < max_retries))


def error_event(error_id: str, op: str, at: object, retry_count: int = 0, message: str | None = None, resolved_by: str | None = None) -> tuple:
    """A row for the error log: op is add, retry or resolve."""
    if op not in ("add", "retry", "resolve"):
        raise ValueError(f"unknown operation {op}")
    return (error_id, retry_count + (op == "retry"), message, op == "resolve", resolved_by, at)


ERROR_LOG = "error_id string, retry_count int, message string, resolved boolean, resolved_by string, at timestamp"


def backoff(states: DataFrame, base_seconds: int = 60) -> DataFrame:
    """error_states with next_attempt after 2^retries times base_seconds instead."""
    return states.withColumn("next_attempt", F.col("at") + F.make_dt_interval(secs=F.pow(F.lit(2.0), F.least(F.col("retry_count"), F.lit(20))) * base_seconds))


def note_event(key: str, op: str, at: object, intelligence_id: int | None = None, content: str | None = None, kind: str = "general") -> tuple:
    """A row for the log of annotations, whose present state event_view gives: op is add, update or delete."""
    if op not in ("add", "update", "delete"):
        raise ValueError(f"unknown operation {op}")
    if op != "delete" and not (content or "").strip():
        raise ValueError("an annotation has a content")
    return (key, intelligence_id, content, kind, op, at)


NOTE_LOG = "note_id string, intelligence_id bigint, content string, annotation_type string, op string, at timestamp"


def chain_created(chains: DataFrame, name: str, kind: str, at: object, description: str | None = None) -> DataFrame:
    """chains with a new one; its id is the 64-bit hash of the name. A name that is there already is a ValueError."""
    if not chains.filter(F.col("chain_name") == name).isEmpty():
        raise ValueError(f"a chain {name} exists")
    new = chains.sparkSession.createDataFrame([(name, kind, description, at, at)], "chain_name string, chain_type string, description string, created_at timestamp, updated_at timestamp")
    return chains.unionByName(new.withColumn("id", F.xxhash64("chain_name")), allowMissingColumns=True)


def chain_linked(links: DataFrame, chain_id: int, facts: DataFrame, kind: str, strength: float, at: object) -> DataFrame:
    """links with the given facts (a column id) added to a chain; those that are in it already are left as they are."""
    new = facts.select(F.lit(chain_id).cast("long").alias("chain_id"), F.col("id").cast("long").alias("intelligence_id")).distinct().join(links.select("chain_id", "intelligence_id"), ["chain_id", "intelligence_id"], "left_anti")
    return links.unionByName(new.withColumns({"relationship_type": F.lit(kind), "relationship_strength": F.lit(float(strength)), "linked_at": F.lit(at).cast("timestamp")}), allowMissingColumns=True)


def chain_updated(chains: DataFrame, chain_id: int, at: object, **values: str) -> DataFrame:
    """chains with some fields of one changed."""
    own = F.col("id") == chain_id
    return chains.withColumns({k: F.when(own, F.lit(v)).otherwise(F.col(k)) for k, v in {**values, "updated_at": at}.items()})


def alias_added(aliases: DataFrame, entities: DataFrame, entity_id: int, alias: str, kind: str, confidence: float, at: object) -> DataFrame:
    """aliases with one more; ValueError for a blank alias or an entity that isn't there. An alias the entity has already keeps its row."""
    if not alias.strip() or entities.filter(F.col("id") == entity_id).isEmpty():
        raise ValueError("no such entity, or a blank alias")
    new = aliases.sparkSession.createDataFrame([(entity_id, alias.strip(), kind, float(confidence), at)], "canonical_entity_id bigint, alias_value string, alias_type string, confidence double, created_at timestamp")
    return aliases.unionByName(new.join(aliases, ["canonical_entity_id", "alias_value"], "left_anti"), allowMissingColumns=True)


def event_view(events: DataFrame, key: str) -> DataFrame:
    """The present rows of an event log with op in (add, update, delete) and at: the last event of each key, unless it deletes."""
    return latest(events, [key], "at").filter("op <> 'delete'").drop("op", "at")


def backup(directory: str, target: str, evidence: list[str] | None = None) -> str:
    """A zip of a case directory, with evidence files under evidence/ if some are given."""
    path = shutil.make_archive(target, "zip", directory)
    with zipfile.ZipFile(path, "a", zipfile.ZIP_DEFLATED) as z:
        for k, f in enumerate(evidence or []):
            z.write(f, f"evidence/{k}_{Path(f).name}")
    return path


def restore(archive: str, directory: str) -> None:
    """Unpacks a backup; names that lead out of the directory are refused."""
    root = Path(directory).resolve()
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            if not (root / name).resolve().is_relative_to(root):
                raise ValueError(f"unsafe name in the archive: {name}")
        z.extractall(root)


def open_case(spark: SparkSession, directory: str, tables: tuple[str, ...] = ("registry", "facts", "entities")) -> dict[str, DataFrame]:
    """The tables of a case directory; FileNotFoundError if one is missing."""
    missing = [t for t in tables if not Path(directory, f"{t}.parquet").exists()]
    if missing:
        raise FileNotFoundError(f"{directory}: {', '.join(missing)}")
    return {t: spark.read.parquet(f"{directory}/{t}.parquet") for t in tables}


def load_settings(path: str) -> dict:
    return json.loads(Path(path).read_text()) if Path(path).exists() else {}


def save_settings(path: str, settings: dict) -> None:
    Path(path).write_text(json.dumps(settings, indent=2, sort_keys=True))


def settings_problems(settings: dict) -> list[str]:
    """What is wrong with settings: empty or missing paths."""
    return [f"{k} isn't set" if not v else f"{k}: no such path" for k, v in settings.items() if k.endswith("_path") and (not v or not Path(v).exists())]
