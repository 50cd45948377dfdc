"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_LOCAL_WORK_DIR: str | None = None
_HELD: list[DataFrame] = []


def build_session(app_name: str = "pairlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Partition counts are left to AQE: ``spark.sql.shuffle.partitions`` is only the
    upper bound it coalesces from, so a cluster should set it to a small multiple
    of its cores.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The folder shared by all executors for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset (a
    local session, tests) a temporary folder of this machine is used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    global _LOCAL_WORK_DIR
    if _LOCAL_WORK_DIR is None or not os.path.isdir(_LOCAL_WORK_DIR):
        _LOCAL_WORK_DIR = tempfile.mkdtemp(prefix="spark-pairlens-")
    return _LOCAL_WORK_DIR


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the work folder that nothing else uses."""
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def hold(df: DataFrame) -> DataFrame:
    """Keep an intermediate result that one plan reads several times.

    Blocks spill to disk and are recomputed if an executor is lost.  Call
    :func:`release_held` between analyses.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _HELD.append(kept)
    return kept


def release_held() -> None:
    """Drop everything :func:`hold` kept."""
    while _HELD:
        _HELD.pop().unpersist()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable, keeping a folder that is already set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(work_dir(spark) + "/checkpoints")
