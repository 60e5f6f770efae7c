"""Null-strict arithmetic, ratios, buckets and scoring expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = [
    "as_col", "pmin_strict", "pmax_strict", "safe_ratio", "dead_zone", "censor",
    "floor_bucket", "f_to_c", "to_currency", "near_cutpoints", "map_slack",
    "speed_columns", "linear_predictor", "price_transform", "inverse_price_transform",
    "has_value", "pair_key", "midpoint", "threshold_flag",
]


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _all_present(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])


def pmin_strict(*cols: str | Column) -> Column:
    """Row-wise minimum that is NULL as soon as one argument is NULL."""
    cs = [as_col(c) for c in cols]
    return F.when(_all_present(cs), F.least(*cs))


def pmax_strict(*cols: str | Column) -> Column:
    """Row-wise maximum that is NULL as soon as one argument is NULL."""
    cs = [as_col(c) for c in cols]
    return F.when(_all_present(cs), F.greatest(*cs))


def safe_ratio(num: str | Column, den: str | Column, guard: Column | None = None) -> Column:
    """``num/den``; NULL for a zero denominator or where ``guard`` is not true."""
    ratio = F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))
    return ratio if guard is None else F.when(guard, ratio)


def dead_zone(delay: str | Column, shift: float = 10, half_width: float = 5) -> Column:
    """``delay + shift`` with values strictly inside ±half_width flattened to 0."""
    shifted = as_col(delay) + F.lit(float(shift))
    return F.when(F.abs(shifted) < half_width, F.lit(0.0)).otherwise(shifted)


def censor(delay: str | Column, floor: float = 0.0) -> Column:
    """Left-censored value; NULL stays NULL."""
    return pmax_strict(F.lit(float(floor)), as_col(delay).cast("double"))


def floor_bucket(x: str | Column, width: float) -> Column:
    """Left edge of the fixed-width bucket holding ``x``."""
    return F.floor(as_col(x) / F.lit(float(width))) * F.lit(width)


def f_to_c(x: str | Column) -> Column:
    """Fahrenheit to whole Celsius, halves to even."""
    return F.bround((as_col(x).cast("double") - 32) * 5 / 9, 0)


def to_currency(cents: str | Column) -> Column:
    return as_col(cents) / F.lit(100.0)


def near_cutpoints(col: str | Column, cuts: list[float], half_width: float) -> Column:
    """True strictly inside ±half_width of any cut-point."""
    c = as_col(col)
    return reduce(lambda a, b: a | b,
                  [(c > cut - half_width) & (c < cut + half_width) for cut in cuts])


def threshold_flag(x: str | Column, cut: float) -> Column:
    """1 at or above the cut, 0 below it, NULL for NULL."""
    c = as_col(x)
    return F.when(c >= cut, F.lit(1)).when(c < cut, F.lit(0))


def map_slack(df: DataFrame, cut: float = 20) -> DataFrame:
    """Slack left after cooking and the mapped ride, with 0/1 cut flags.

    Needs ``prereq, prepare, left1`` in minutes and ``time`` (map ride) in minutes.
    """
    return (df
            .withColumn("left_m", F.col("left1"))
            .withColumn("left2", F.col("prereq") - (F.col("prepare") + F.col("time")))
            .withColumn("left2_m", F.col("left2"))
            .withColumn("left_20", threshold_flag("left_m", cut))
            .withColumn("left2_20", threshold_flag("left2_m", cut)))


def speed_columns(df: DataFrame, seconds: Column, dist: str = "dist", map_minutes: str = "time",
                  on_hand: str = "onhand", max_dist: float = 14000, max_speed: float = 30) -> DataFrame:
    """Speed, load-weighted speed and unexpected ride ratio, then the validity filter."""
    ride = F.when(seconds != 0, seconds.cast("double"))
    return (df
            .withColumn("speed", F.col(dist) / ride)
            .withColumn("speed_wt", F.col("speed") * F.col(on_hand))
            .withColumn("bdunexp", safe_ratio(ride, F.col(map_minutes)))
            .filter((F.col(dist) < max_dist) & (F.col("speed") < max_speed) & (F.col(map_minutes) > 0)))


def linear_predictor(coef: dict[str, float], intercept: str = "(Intercept)") -> Column:
    """Fitted linear index; a term ``a:b`` is the product of both columns."""
    out = F.lit(float(coef.get(intercept, 0.0)))
    for term, value in coef.items():
        if term != intercept:
            factors = [F.col(f).cast("double") for f in term.split(":")]
            out = out + F.lit(float(value)) * reduce(lambda a, b: a * b, factors)
    return out


def price_transform(price_cents: str | Column, ref: str | Column, u: str | Column) -> Column:
    """``(price / reference) ** u`` in currency units; NULL for a zero reference."""
    return F.pow(safe_ratio(to_currency(price_cents), ref), as_col(u))


def inverse_price_transform(f: str | Column, ref: str | Column, u: str | Column) -> Column:
    """Price implied by a scale ``f``: ``f ** (1/u) * reference``."""
    return F.pow(as_col(f), safe_ratio(F.lit(1.0), u)) * as_col(ref)


def has_value(c: str | Column) -> Column:
    return as_col(c).isNotNull()


def pair_key(a: str | Column, b: str | Column) -> Column:
    return F.concat_ws("_", as_col(a).cast("string"), as_col(b).cast("string"))


def midpoint(lo: str | Column, hi: str | Column) -> Column:
    return (as_col(lo) + as_col(hi)) / 2
