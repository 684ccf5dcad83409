"""Session construction and the shared scratch location.

Jobs that must write an intermediate table (CSV round trips, indexed exports, lineage cuts) write it
under the folder named by ``spark.checkpoint.dir``. On a cluster that setting points at shared storage;
only when it is unset (local tests) do we create a private temporary folder and register it.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "scenaria", shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions is None and (master or "").startswith("local"):
        shuffle_partitions = int(os.environ.get("SCENARIA_SHUFFLE_PARTITIONS", "8"))
    if shuffle_partitions:  # on a cluster keep its own setting; AQE coalesces small partitions anyway
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` if the cluster names one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        # Only for a session on this machine (tests); elsewhere executors would not see such a folder.
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="scenaria-ckpt-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir() or root
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path under the checkpoint root."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/scenaria-{name}-{uuid.uuid4().hex}"
