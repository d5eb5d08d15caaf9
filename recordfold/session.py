"""Session helpers: a tuned local session for tests/bench, and scratch paths.

Scratch data (checkpoints, written intermediate tables, stream state) always
lives under ``spark.checkpoint.dir`` so that on a cluster it sits in the shared
folder the cluster names.  Only when that setting is absent (local tests) do we
pick a fresh temporary folder.
"""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "recordfold") -> SparkSession:
    """Session for tests and the bench: AQE on, UTC, no UI, Arrow enabled."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # The engine's own size checks: a side whose scan is under the static
        # threshold (catalogues) is broadcast without shuffling the fact side;
        # AQE converts other joins by the measured size.
        .config("spark.sql.autoBroadcastJoinThreshold", "10MB")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "32MB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("RECORDFOLD_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting a temporary one only if unset."""
    current = spark.conf.get(CHECKPOINT_CONF, None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            # executors on other machines cannot see a local temporary folder
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by the cluster")
        current = tempfile.mkdtemp(prefix="recordfold-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def materialised(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a fresh scratch table and read it back: its size is then
    known to the planner, and it is computed once."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, unique folder under the checkpoint dir for a written table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{label}-{uuid.uuid4().hex[:12]}"
