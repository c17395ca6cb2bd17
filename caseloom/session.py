"""Session helpers: reading tables, spreading work, cutting lineage in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections import defaultdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that cut() wrote, by application.
_written: dict[str, list[str]] = defaultdict(list)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once a session: they needn't have it installed."""
    context = spark.sparkContext
    if getattr(context, "_caseloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="caseloom-package-")) / "caseloom.zip"  # read by the driver only, which serves it
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(path))
    context._caseloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (only where that is unset and the master is local, as in tests) a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("caseloom.shared.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="caseloom-")
        spark.conf.set("caseloom.shared.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: the lineage ends there and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written[spark.sparkContext.applicationId].append(path)
    df.write.parquet(path)
    _folder(spark, path)[0].deleteOnExit(_folder(spark, path)[1])
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def clear(spark: SparkSession) -> int:
    """Deletes the tables that cut() wrote in this session and says how many. Results that were read from them must have been written or collected before.

    Without it they go when the session's JVM ends.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        fs, p = _folder(spark, path)
        fs.delete(p, True)
    return len(paths)


def spread(df: DataFrame) -> DataFrame:
    """Gives a small input (fewer scan partitions than cores) to all cores; a large input keeps its scan partitions and isn't shuffled."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
