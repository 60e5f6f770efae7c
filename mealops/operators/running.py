"""Row numbers and running sums over one global order, without a window that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import stage_shared


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, Column],
                   number: str | None = None, partitions: int | None = None) -> DataFrame:
    """``df`` with ``number`` (from 1) and running sums (own row included) in ``order``.

    Rows are range-partitioned by ``order`` and written with their partition number, so a
    recomputed task finds the same ranges; each range is summed, offsets run over the few
    ranges, and rows are numbered inside their range. ``order`` should end in a unique
    column: rows that tie stay in one range.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = {f"_v{i}": (name, col) for i, (name, col) in enumerate(sums.items())}
    ranged = df.select("*", *[col.alias(v) for v, (_, col) in values.items()])
    ranged = stage_shared(ranged.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    per = ranged.groupBy("_range").agg(F.count("*").alias("_rows"), *[F.sum(v).alias(f"{v}s") for v in values])
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = per.select(F.col("_range"), F.coalesce(F.sum("_rows").over(upto), F.lit(0)).alias("_r0"),
                        *[F.coalesce(F.sum(f"{v}s").over(upto), F.lit(0)).alias(f"{v}0") for v in values])
    inside = Window.partitionBy("_range").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumn("_row", F.row_number().over(inside))
    for v in values:
        out = out.withColumn(f"{v}i", F.sum(v).over(so_far))
    out = out.join(before, "_range")
    added = [(F.col("_r0") + F.col("_row")).alias(number)] if number else []
    added += [(F.col(f"{v}0") + F.coalesce(F.col(f"{v}i"), F.lit(0))).alias(name) for v, (name, _) in values.items()]
    return out.select(*df.columns, *added)
