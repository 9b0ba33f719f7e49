"""SparkSession construction and shared settings."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings the library relies on: UTC session time zone (all event time is UTC),
# AQE for runtime coalescing and skew-join splitting, dynamic partition overwrite
# so a retried batch replaces exactly its own partition.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Let AQE keep several tasks for small-but-CPU-heavy stages (parsing,
    # redaction); on large inputs partitions are far above this floor anyway.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256KB",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "callgauge", conf: dict[str, str] | None = None) -> SparkSession:
    """Return (or create) a session with the library's required settings.

    On a cluster the session already exists and ``master`` is ignored; we only
    apply the SQL settings above, which are session-scoped.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", os.environ.get("CALLGAUGE_DRIVER_MEMORY", "16g"))
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in (conf or {}).items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, registered for
    ``DataFrame.checkpoint()``.

    On a cluster the operator sets it to a shared filesystem. Where it is
    unset (a local session), a folder in the warehouse is used, which driver and
    executors share as well; no machine-local temporary folder ever is.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the checkpoint folder
        sc = None
    if not d and sc is not None:
        cur = sc._jsc.sc().getCheckpointDir()
        d = cur.get() if cur.isDefined() else None
    if not d:
        d = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if sc is not None:
        sc.setCheckpointDir(d)
    return d
