"""Choice sets: the store actually chosen against the last different store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.readers import append_frames


def choice_set(chosen: DataFrame, alternatives: DataFrame, required_cols: list[str],
               id: str = "id") -> DataFrame:
    """Chosen (1) and alternative (0) rows with complete attributes; ids left with a no chosen
    or no alternative row are dropped. An order has one chosen row and its few alternatives, so the window
    that counts them is small whatever the data size."""
    both = append_frames(chosen.withColumn("chosen", F.lit(1)),
                         alternatives.withColumn("chosen", F.lit(0))).dropna(subset=[id, *required_cols])
    own = W.partitionBy(id)
    return (both.withColumn("_hi", F.max("chosen").over(own)).withColumn("_lo", F.min("chosen").over(own))
            .filter((F.col("_hi") == 1) & (F.col("_lo") == 0)).drop("_hi", "_lo"))
