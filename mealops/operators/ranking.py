"""Sorting, top-k, keep-first and best-match selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import join_null_safe


def order_by(df: DataFrame, keys: list[str], nulls_last: bool = True) -> DataFrame:
    """Keys prefixed with ``-`` sort descending."""
    cols = []
    for k in keys:
        name, desc = k.lstrip("-"), k.startswith("-")
        c = F.col(name)
        if nulls_last:
            cols.append(c.desc_nulls_last() if desc else c.asc_nulls_last())
        else:
            cols.append(c.desc_nulls_first() if desc else c.asc_nulls_first())
    return df.orderBy(*cols)


def head(df: DataFrame, n: int, keys: list[str]) -> DataFrame:
    return order_by(df, keys).limit(n)


def kth_most_frequent(df: DataFrame, key: str, k: int = 1) -> DataFrame:
    """The k-th most frequent key with its count (ties: larger key first)."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.desc(key)).offset(k - 1).limit(1)


def _first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key set by ``order`` as a map-side aggregate, so a key with very many
    copies is never sorted or gathered. Order columns sort ascending, NULL last."""
    rank = F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"_n_{c}"), F.col(c).alias(f"_o_{c}"))])
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_r"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key set: the first under an explicit order ending in a unique column."""
    return _first_per(df, list(keys), list(order))


def best_match(df: DataFrame, by: list[str] = ("sup_id", "from_tel", "from_addr"),
               mode: str = "intended", tiebreak: list[str] = ("from_addr_xms",)) -> DataFrame:
    """Best scraped candidate per restaurant.

    ``intended`` keeps the one with the smallest long distance; ``as_written`` keeps every
    candidate with the highest ``match_rule`` (ties stay)."""
    by = list(by)
    if mode == "intended":
        return _first_per(df, by, ["adist_long", *tiebreak])
    if mode != "as_written":
        raise ValueError(mode)
    top = df.groupBy(*by).agg(F.max("match_rule").alias("_top"))
    return join_null_safe(df, top, by).filter(F.col("match_rule") == F.col("_top")).drop("_top")


def distinct_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return (df.select(*cols) if cols else df).distinct()
