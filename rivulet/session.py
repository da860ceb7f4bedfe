"""Spark session settings shared by tests, bench and the driver entry point.

On a cluster the session comes from the platform; ``configure`` only fills in
settings that are unset, so cluster-level choices (shuffle partitions, the
shared checkpoint folder) always win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job in this library assumes.
_REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "rivulet", checkpoint: str | None = None) -> SparkSession:
    """Local session for tests and the bench (UI off, AQE on, UTC)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("RIVULET_DRIVER_MEMORY", "16g"))
               .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024)))
    if checkpoint:
        builder = builder.config("spark.checkpoint.dir", checkpoint)
    for key, value in _REQUIRED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply required SQL settings to an existing session (idempotent) and
    make the package's functions travel with the tasks that use them."""
    for key, value in _REQUIRED.items():
        spark.conf.set(key, value)
    ship_package()
    return spark


def ship_package() -> None:
    """Pickle functions of this package by value, so Python workers (local
    or remote) run pandas UDFs without the package being installed there."""
    import rivulet
    from pyspark import cloudpickle
    try:
        cloudpickle.register_pickle_by_value(rivulet)
    except ValueError:  # already registered
        pass


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and stream state.

    Uses ``spark.checkpoint.dir`` as the cluster sets it (or a directory
    already registered on the context).  Only when neither exists and
    the master is local, as in tests, a fresh scratch folder is registered; on
    a cluster that is an error, as executors could not read each other's."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if not current:
        current = sc.getConf().get("spark.checkpoint.dir", None)
        if not current:
            try:
                current = spark.conf.get("spark.checkpoint.dir")
            except Exception:  # noqa: BLE001 - unset
                current = None
        if not current:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            current = tempfile.mkdtemp(prefix="rivulet-ckpt-")
        sc.setCheckpointDir(current)
        current = sc.getCheckpointDir() or current
    return current
