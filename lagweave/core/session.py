"""Session helper: lineage cuts in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Share of the driver's heap limit up to which its garbage is left alone.
HEAP_SHARE = 0.45


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="lagweave-ckpt-")
    sc.setCheckpointDir(configured)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; survives the loss of executors."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def tidy_driver(spark: SparkSession) -> None:
    """Collects the driver's garbage once its heap has grown past HEAP_SHARE of its limit. Flows of very many jobs leave
    plans, broadcasts and task ends behind, for which the heap would otherwise grow to its limit; a full collection also
    gives room back, and lets Spark's cleaner drop the files of frames that are gone."""
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > HEAP_SHARE * heap.maxMemory():
        spark.sparkContext._jvm.System.gc()


def cut_and_tidy(df: DataFrame) -> DataFrame:
    """A reliable checkpoint after which the driver is tidied."""
    cut = cut_lineage(df)
    tidy_driver(df.sparkSession)
    return cut


def shared_folder(spark: SparkSession, name: str) -> str:
    """The name of a new folder that the driver and all executors share; a local one only with a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lagweave-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """The frame written as Parquet in a shared folder and read again: a lineage cut that takes less room than a
    checkpoint where columns repeat or are small."""
    place = shared_folder(df.sparkSession, name)
    df.write.options(**options or {}).parquet(place)
    tidy_driver(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of much work and few bytes over all cores; adaptive execution would put them into one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)
