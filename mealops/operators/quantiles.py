"""Exact interpolated quantiles of several columns without holding a group in one task.

One read gives the moments, ends and counts of every (group, column) pair. Pairs of few
values are collapsed to (pair, value, count) with map-side aggregation and ranked by the
counted ``percentile``. The others are cut into bins between their own ends: only bin counts
move, the bins that hold a needed rank are cut again, until each holds few values or one;
those alone are ranked. NaN counts as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.sinks import stage_shared
from .joins import join_null_safe

FEW_VALUES = 1_000_000  # distinct values that one task may rank
_BINS, _MAX_LEVELS = 4096, 30
_INF = float("inf")


def _bin(value: Column) -> Column:
    """Increasing map of a double to a few thousand whole numbers at most."""
    return F.floor(F.asinh(value) * 200)


def _number(c: str) -> Column:
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def column_moments(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """One row per group and column: ``_m_rows, _m_n, _m_mean, _m_sd, _m_min, _m_max``, from one shuffle of one row
    per group and task. ``_lo`` and ``_hi`` are the finite ends, ``_most`` bounds the number of
    distinct values. Staged, since it steers what is read next."""
    per = []
    for i, c in enumerate(cols):
        v = F.col(f"_c{i}")
        finite = F.when(F.abs(v) < _INF, v)
        n, lo, hi = F.count(v), F.min(finite), F.max(finite)
        whole = isinstance(df.schema[c].dataType, T.IntegralType)
        per.append(F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("_m_rows"), n.alias("_m_n"), F.avg(v).alias("_m_mean"),
            F.stddev_samp(v).alias("_m_sd"), F.min(v).alias("_m_min"), F.max(v).alias("_m_max"), lo.alias("_lo"), hi.alias("_hi"),
            (F.least(n.cast("double"), hi - lo + 1) if whole else n.cast("double")).alias("_most")))
    numbers = df.select(*by, *[_number(c).alias(f"_c{i}") for i, c in enumerate(cols)])
    wide = numbers.groupBy(*by).agg(F.array(*per).alias("_s"))
    return stage_shared(wide.select(*by, F.inline("_s")).filter(F.col("_m_rows") > 0), "moments")


def _ranked_counts(counts: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Quantiles of (keys, _v, _n) where a pair has few values."""
    at = F.percentile(F.col("_v"), [float(p) for p in probs.values()], F.col("_n"))
    return counts.groupBy(*keys).agg(at.alias("_q")).select(
        *keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)])


def _inside(long: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Values that lie in a cell, with it. A pair has at most two disjoint cells per probability,
    so they travel as one array in one row per pair."""
    open_ = cells.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in cells.columns if c not in keys])).alias("_open"))
    v = F.col("_v")
    hit = F.filter("_open", lambda c: (v >= c["_from"]) & (v <= c["_to"]))
    return (join_null_safe(long, open_, keys, "inner").select(*keys, "_v", F.get(hit, F.lit(0)).alias("_cell"))
            .filter(F.col("_cell").isNotNull()).select(*keys, "_v", "_cell.*"))


def _searched(long: DataFrame, pairs: DataFrame, keys: list[str], probs: dict[str, float],
              few: int) -> DataFrame:
    """Quantiles of pairs with many values; ``pairs`` has their n and finite ends."""
    cells = pairs.select(*keys, F.col("_m_n").alias("_total"), F.lit(0).cast("long").alias("_base"), F.lit(-_INF).alias("_from"),
                         F.lit(_INF).alias("_to"), "_lo", "_hi")
    cell = [*keys, "_from"]
    ranks = {name: (F.col("_total") - 1) * F.lit(float(p)) for name, p in probs.items()}
    for level in range(_MAX_LEVELS):
        # the first cut is nearly logarithmic, later ones even; halves keep the width finite
        scale = F.asinh if level == 0 else (lambda c: c / 2)
        share = F.try_divide(scale(F.col("_v")) - scale(F.col("_lo")), scale(F.col("_hi")) - scale(F.col("_lo")))
        at = (F.when(F.col("_v") == -_INF, F.lit(-1)).when(F.col("_v") == _INF, F.lit(_BINS + 1))
              .otherwise(F.floor(F.coalesce(share, F.lit(0.0)) * _BINS).cast("int")))
        bins = _inside(long, cells, keys).groupBy(*cell, at.alias("_bin")).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
            F.max("_base").alias("_b"), F.max("_total").alias("_total"))
        along = W.partitionBy(*cell).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)  # one row a bin
        bins = bins.withColumn("_base", F.col("_b") + F.coalesce(F.sum("_n").over(along), F.lit(0)))
        wanted = F.lit(False)
        for h in ranks.values():
            for rank in (F.floor(h), F.ceil(h)):
                wanted = wanted | ((rank >= F.col("_base")) & (rank < F.col("_base") + F.col("_n")))
        cells = stage_shared(bins.filter(wanted).select(
            *keys, "_total", "_base", F.col("_lo").alias("_from"), F.col("_hi").alias("_to"), "_lo", "_hi", "_n"), "cells")
        if cells.filter((F.col("_n") > few) & (F.col("_lo") < F.col("_hi"))).isEmpty():
            break
        cells = cells.drop("_n")
    counts = _inside(long, cells.drop("_n"), keys).groupBy(*cell, "_v").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_base").alias("_base"), F.max("_total").alias("_total"))
    before = F.sum("_n").over(W.partitionBy(*cell).orderBy("_v").rowsBetween(W.unboundedPreceding, -1))
    ranked = (counts.withColumn("_first", F.col("_base") + F.coalesce(before, F.lit(0)))
              .withColumn("_next", F.col("_first") + F.col("_n")))

    def value(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_first")) & (rank < F.col("_next")), F.col("_v")))

    ends = []
    for name, h in ranks.items():
        ends += [value(F.floor(h)).alias(f"_l_{name}"), value(F.ceil(h)).alias(f"_u_{name}")]
    picked = ranked.groupBy(*keys).agg(F.max("_total").alias("_total"), *ends)
    l, u = (lambda n: F.col(f"_l_{n}")), (lambda n: F.col(f"_u_{n}"))
    # two equal ends are the value itself, also where it is infinite
    return picked.select(*keys, *[F.when(l(n) == u(n), l(n)).otherwise(l(n) + (u(n) - l(n)) * (h - F.floor(h))).alias(n)
                                  for n, h in ranks.items()])


def column_quantiles(df: DataFrame, by: list[str], cols: list[str], probs: dict[str, float], *,
                     moments: DataFrame | None = None, few: int = FEW_VALUES) -> DataFrame:
    """One row per group and ``column`` with at least one value; ``probs`` maps output name to
    probability and interpolation is linear between the two closest ranks. ``moments`` are
    :func:`column_moments` where the caller has them. ``few`` changes the way, not the result."""
    keys = [*by, "column"]
    moments = column_moments(df, by, cols) if moments is None else moments
    many = moments.filter((F.col("_most") > few) & (F.col("_m_n") > 0))
    searched = [r["column"] for r in many.select("column").distinct().collect()]  # at most one per column
    long = long_values(df, by, cols).filter(F.col("_v").isNotNull())
    counted = join_null_safe(long, many.select(*keys), keys, "left_anti") if searched else long
    out = _ranked_counts(counted.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")), keys, probs)
    if searched:
        part = long_values(df, by, [c for c in cols if c in searched]).filter(F.col("_v").isNotNull())
        out = out.unionByName(_searched(part, many, keys, probs, few))
    return out


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float], *,
                    few: int = FEW_VALUES) -> DataFrame:
    """One row per group that has at least one value."""
    return column_quantiles(df, by, [value], probs, few=few).drop("column")


def long_values(df: DataFrame, by: list[str], cols: list[str], name: str = "column") -> DataFrame:
    """Unpivot numeric columns to (by, column, _v) so several columns share one job."""
    numbers = df.select(*by, *[_number(c).alias(f"_c{i}") for i, c in enumerate(cols)])
    return numbers.select(*by, F.inline(F.array(*[
        F.struct(F.lit(c).alias(name), F.col(f"_c{i}").alias("_v")) for i, c in enumerate(cols)])))
