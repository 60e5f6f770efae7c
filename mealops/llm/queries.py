"""One query per operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (collocations, conversations, language, mil_quality, mixing, near_dups, packing, paragraph_sketch,
               target_ratio, token_files, token_lengths, toxicity, url_trust)
from .common import is_held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_target_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Base rules and likeness to trusted text for every document."""
    judged = target_ratio.judge(table(spark, d, "documents"), table(spark, d, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "kept", "log_ratio")


def _scored(docs: DataFrame, score, least: float) -> DataFrame:
    return (docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
            .withColumn("predicted", (F.col("score") >= least).cast("int")))


@query
def op1_mil_quality(spark: SparkSession, d: str) -> DataFrame:
    """Attention-weighted passage score of every document."""
    docs = table(spark, d, "documents")
    return _scored(docs, mil_quality.quality_score(docs, table(spark, d, "labels")), 0.3)


@query
def op5_token_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Totals, quantiles and truncated totals for every encoded length as a context limit."""
    return token_lengths.suffix_sums(token_lengths.length_histogram(table(spark, d, "documents")))


@query
def op7_toxicity(spark: SparkSession, d: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, d, "documents")
    return _scored(docs, toxicity.toxicity_score(docs, table(spark, d, "labels")), 0.5)


@query
def op8_language(spark: SparkSession, d: str) -> DataFrame:
    """Language of every document by rank-order profiles."""
    docs = table(spark, d, "documents")
    found = language.predict(docs.select("doc_id", "text"), language.profiles(docs))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query
def op9_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return packing.pack(table(spark, d, "documents"))


@query
def op2_mixing(spark: SparkSession, d: str) -> DataFrame:
    """Words the mix takes of every document."""
    return mixing.mix(table(spark, d, "documents")).drop("fingerprint", "source")


@query
def op3_url_trust(spark: SparkSession, d: str) -> DataFrame:
    """Verdict on every page's url."""
    return url_trust.judge(table(spark, d, "pages"))


@query
def op6_paragraph_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return paragraph_sketch.fingerprints(table(spark, d, "documents"))


@query
def op10_near_dups(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicate group of every document."""
    return near_dups.near_duplicates(table(spark, d, "documents"))


@query
def op11_collocations(spark: SparkSession, d: str) -> DataFrame:
    """Each language's first phrases of two to four words."""
    return collocations.collocations(table(spark, d, "documents"))


@query
def op12_token_files(spark: SparkSession, d: str) -> DataFrame:
    """Digests of every document's ids, read back from Huffman-coded files."""
    return token_files.round_trip(table(spark, d, "documents"))


@query
def op13_conversation_repair(spark: SparkSession, d: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after the contract's damage."""
    original = table(spark, d, "conversations")
    rows = conversations.damaged(original)
    found = conversations.repairs(rows)
    digests = conversations.repaired_digests(rows, found)
    every = original.select("conv_id").distinct()
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    zero = lambda c: F.coalesce(f"f.{c}", F.lit(0).cast("long")).alias(c)
    return (every.alias("e").join(found.alias("f"), same("e", "f"), "left").join(digests.alias("d"), same("e", "d"), "left")
            .select("e.conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                    F.coalesce("f.audit", F.lit("")).alias("audit"),
                    F.coalesce("d.repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")))


ORACLES["op2_mixing"] = mixing.ORACLE
ORACLES["op11_collocations"] = collocations.ORACLE
