"""From raw documents to packed training sequences.

Stages, each over all that the one before kept: quality rules, quality classifier,
near-duplicates, mixing to target weights, packing. The first four return the columns of
``documents``; every stage is written before the next reads it.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from mealops.llm import mil_quality, mixing, near_dups, packing, target_ratio  # noqa: E402
from mealops.llm.common import session, table  # noqa: E402
from mealops.sources.sinks import stage_shared  # noqa: E402

#: Documents that the classifier scores lower go.
LEAST_QUALITY = 0.3


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and read like trusted text."""
    session(spark)
    row = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    return target_ratio.judge(row, table(spark, sf_dir, "labels")).filter("kept").select("row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the passage classifier does not reject. It is fitted on labelled rows of
    the raw table: of those that passed the rules hardly any is labelled bad."""
    score = mil_quality.scorer(mil_quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))(F.col("text"))
    scored = docs.select(F.struct("*").alias("row"), score.alias("score"))
    return scored.filter(F.col("score") >= LEAST_QUALITY).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, and one row of each id. Documents
    without an id stay."""
    session(spark)
    keep = near_dups.near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    row = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    one = Window.partitionBy("doc_id").orderBy("text", F.xxhash64("row"))
    with_id = (row.join(keep, "doc_id", "left_semi").withColumn("place", F.row_number().over(one))
               .filter("place = 1").select("row.*"))
    return with_id.unionAll(docs.filter(F.col("doc_id").isNull()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    session(spark)
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    session(spark)
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier),
          ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack", pack)]

#: The classifier and the tokenizer are beyond SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_shared(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
