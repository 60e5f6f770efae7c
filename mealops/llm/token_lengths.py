"""Token counts: an exact histogram of encoded lengths.

Documents become their encoded length where they are read; only (length, count) moves. Sums
over the histogram's suffixes answer, for every context limit, how many documents are longer,
how many tokens remain when texts are cut at the limit, and which quantile a length is.
The suffix sums run over blocks of lengths first, so no task orders all lengths.

Defined results: a NULL or empty text has length 0; repeated rows count each; an empty table
has an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import stage_shared
from .tokens import TokenIds, default_tokenizer

BLOCK = 1024


def encoded_length(text: Column, tokenizer: str | None = None) -> Column:
    """Number of token ids of a whole text."""
    path = tokenizer or default_tokenizer()

    @F.arrow_udf("bigint")
    def length(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids_of = TokenIds(path)
        for batch in batches:
            yield pa.array([len(ids) // 4 for ids in ids_of.many(batch.to_pylist())], pa.int64())
    return length(text)


def length_histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(length, n_docs), staged: small, and read several times."""
    lengths = docs.select(encoded_length(F.col("text"), tokenizer).alias("length"))
    return stage_shared(lengths.groupBy("length").agg(F.count("*").alias("n_docs")), "lengths")


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length as a context limit: documents at most and at least that long, tokens of
    those longer cut at the limit, all tokens kept under the limit, and the share of documents
    that fit (the quantile of the length)."""
    h = histogram.withColumn("_b", F.floor(F.col("length") / BLOCK))
    tokens = F.col("length") * F.col("n_docs")
    blocks = h.groupBy("_b").agg(F.sum("n_docs").alias("_d"), F.sum(tokens).alias("_t"))
    above = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    blocks = blocks.select("_b", F.coalesce(F.sum("_d").over(above), F.lit(0)).alias("_da"),
                           F.coalesce(F.sum("_t").over(above), F.lit(0)).alias("_ta"))
    inside = Window.partitionBy("_b").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    totals = h.agg(F.sum("n_docs").alias("_n"), F.sum(tokens).alias("_s"))
    out = (h.withColumn("_di", F.sum("n_docs").over(inside)).withColumn("_ti", F.sum(tokens).over(inside))
           .join(blocks, "_b").withColumn("_all", totals.select(F.struct("_n", "_s")).scalar()))
    at_least, at_least_tokens = F.col("_di") + F.col("_da"), F.col("_ti") + F.col("_ta")
    return out.select(
        F.col("length"), F.col("n_docs"), tokens.alias("n_tokens"), at_least.alias("docs_at_least"),
        at_least_tokens.alias("tokens_at_least"), F.col("_all._n").alias("total_docs"),
        F.col("_all._s").alias("total_tokens"),
        (F.col("_all._s") - at_least_tokens + F.col("length") * at_least).alias("tokens_within"),
        ((F.col("_all._n") - at_least + F.col("n_docs")) / F.col("_all._n")).alias("share_fitting"))


def totals_at(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Tokens left when every text is cut at each of ``limits``, and texts cut."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(v),) for v in limits], "limit_at bigint")
    first = [sums.filter(F.col("length") > v).agg(
        F.lit(int(v)).alias("limit_at"), F.coalesce(F.max("docs_at_least"), F.lit(0)).alias("docs_cut"),
        F.coalesce(F.max("tokens_at_least"), F.lit(0)).alias("_t")) for v in limits]
    cut = first[0]
    for more in first[1:]:
        cut = cut.unionAll(more)
    total = sums.agg(F.max("total_tokens").alias("s"))
    return asked.join(cut, "limit_at").select(
        "limit_at", "docs_cut",
        (F.coalesce(total.scalar(), F.lit(0)) - F.col("_t") + F.col("docs_cut") * F.col("limit_at")).alias("tokens_within"))


def quantile(sums: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length that fits each share of the documents."""
    got = [sums.filter(F.col("share_fitting") >= s).agg(F.lit(float(s)).alias("share"), F.min("length").alias("length"))
           for s in shares]
    out = got[0]
    for more in got[1:]:
        out = out.unionAll(more)
    return out
