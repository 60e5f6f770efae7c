"""Table sinks and stage boundaries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Write a frame and return its path. CSV gets a header and empty text for NULL.

    With ``partition_by`` AQE rebalances on the partition columns first, so one task does not
    hold open a file per partition and a hot partition is split over several tasks."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)
    return path


def stage(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut lineage at a stage boundary through a written table in shared storage."""
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(write_table(df, path, partition_by))


def shared_path(spark: SparkSession, label: str = "stage") -> str:
    """A fresh folder name under the shared checkpoint folder of the session."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"


def stage_shared(df: DataFrame, label: str = "stage") -> DataFrame:
    """Stage under the shared checkpoint folder of the session, for an intermediate that
    several branches of one job read: columnar, so each branch reads only its columns, and
    not recomputed when an executor is lost."""
    return stage(df, shared_path(df.sparkSession, label))
