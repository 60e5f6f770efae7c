"""Session defaults the library is written for.

On a cluster the caller owns the session; :func:`configure` only sets runtime
SQL options and never overrides the checkpoint folder the cluster names.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    # naive timestamps are compared as UTC everywhere
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # hot keys in joins are split at run time; hot keys in ordered windows are
    # split by operators.ordered
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names. A single-JVM session without one gets its own;
    on a cluster a folder of one machine would lose data, so there it is an error."""
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="mealops-ckpt-"))


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  memory: str = "8g", app: str = "mealops") -> SparkSession:
    """Single-JVM session for tests and the bench."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", memory)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
