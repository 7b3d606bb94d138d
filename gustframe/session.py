"""Session helpers.

Library code never creates a module-level session; callers pass one in.
``configure`` only sets options that make results independent of the
caller's environment (UTC session zone for wall-clock NTZ math, AQE on).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # wide feature projections generate methods too large for the JVM to JIT;
    # above 8000 bytes of bytecode fall back to split per-expression codegen
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in _DEFAULTS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    if not spark.sparkContext.getCheckpointDir():
        checkpoint_dir(spark)
    return spark


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "gustframe") -> SparkSession:
    """Local session for tests and the bench (the cluster supplies its own)."""
    builder = (
        SparkSession.builder.master(master or os.environ.get("GUSTFRAME_MASTER", "local[8]"))
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("GUSTFRAME_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without the setting (tests) gets a scratch folder; on a
    cluster a machine-local folder would lose data, so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="gustframe-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    return path
