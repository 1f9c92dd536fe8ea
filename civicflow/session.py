"""Spark session and shared-storage helpers.

The library never hard-codes a cluster layout. ``get_spark`` only fills in
settings that are not already present, so a cluster launcher's own
configuration (master, shuffle partitions, checkpoint folder) always wins.
"""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

# Defaults that are safe on a laptop and on a cluster alike. AQE re-plans joins
# from measured shuffle sizes (this is the size check behind every join we leave
# unhinted), coalesces small partitions and splits skewed join partitions.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # one BLAS thread per Python worker: Spark already runs one task per core
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
}


def get_spark(app_name: str = "civicflow", master: str | None = None,
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Return the active session as it is, or create one with the arguments and our defaults for unset keys."""
    for var in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS"):
        os.environ.setdefault(var, "1")  # inherited by locally started workers
    running = SparkSession.getActiveSession()
    if running is not None:  # its settings are the launcher's business
        ensure_checkpoint_dir(running)
        return running
    builder = SparkSession.builder.appName(app_name)
    master = master or os.environ.get("CIVICFLOW_MASTER")
    if master:
        builder = builder.master(master)
    given = SparkConf()  # spark-submit's and spark-defaults' settings
    conf = {k: v for k, v in _DEFAULTS.items() if not given.contains(k)}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set a local one only if unset.

    On a cluster the launcher names a shared folder; a machine-local folder
    would not survive the loss of an executor, so it is only a fallback for
    local runs and tests.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="civicflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
