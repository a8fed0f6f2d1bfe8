"""Session construction and lineage checkpoints.

Library code never creates its own session; it works on the DataFrames it is
given.  ``get_session`` is for scripts, tests and the benchmark.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Delete checkpoint files once nothing references them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, app_name: str = "tessera",
                shuffle_partitions: int | None = None, driver_memory: str | None = "8g",
                conf: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE and UTC timestamps.

    ``driver_memory`` only matters in local mode, where the driver JVM is
    the whole cluster; it has no effect once a JVM is running.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(_DEFAULT_CONF)
    if driver_memory and (master or "").startswith("local"):
        settings["spark.driver.memory"] = driver_memory
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that is
    used as is.  Only a local-mode session (tests, one machine) without one
    gets a private folder, because a machine-local folder is not visible to
    other executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            configured = None
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if sc.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="tessera-ckpt-")
        sc.setCheckpointDir(folder)
        return sc.getCheckpointDir() or folder
    raise RuntimeError(
        "spark.checkpoint.dir is not set; point it at a folder shared by all "
        "executors (for example an object-store or HDFS path)")


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Checkpointed data keeps its partitioning and in-partition order, and a
    lost executor does not lose it (unlike a local checkpoint or a cache).
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def env_int(name: str, default: int) -> int:
    value = os.environ.get(name)
    return int(value) if value else default
