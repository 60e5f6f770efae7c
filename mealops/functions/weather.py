"""Present-weather code flags and condition lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col

__all__ = ["WEATHER_FLAGS", "DAY_RAIN_TERMS", "NIGHT_RAIN_TERMS", "weather_flags",
           "sudden_rain", "condition_flag"]

# Present-weather code ranges (inclusive) behind each flag.
WEATHER_FLAGS = {
    "precipitating": (50, 99),
    "drizzle": (50, 59),
    "rain": (60, 69),
    "srain": (70, 79),
    "shower": (80, 99),
    "shower_sl": (80, 80),
    "rain_sl_cnt": (61, 61),
    "rain_sl_itm": (60, 60),
    "mist": (10, 10),
    "haze": (5, 5),
}

# Wet conditions counted as bad weather by day and by night.
DAY_RAIN_TERMS = ["中到大雨", "阵雨", "中雨", "暴雨", "雷阵雨", "小到中雨", "小雨"]
NIGHT_RAIN_TERMS = ["阵雨", "中雨", "小雨", "暴雨", "大雨", "雷阵雨", "中雪"]


def weather_flags(*codes: str | Column) -> dict[str, Column]:
    """One boolean per flag: does any of the code columns fall in its range.
    Codes may be text; a missing or non-numeric code counts as false."""
    nums = [as_col(c).try_cast("int") for c in codes]

    def any_in(lo: int, hi: int) -> Column:
        hits = [F.coalesce(n.between(lo, hi), F.lit(False)) for n in nums]
        return reduce(lambda a, b: a | b, hits)

    return {name: any_in(lo, hi) for name, (lo, hi) in WEATHER_FLAGS.items()}


def sudden_rain(begin: str | Column, tm: str | Column) -> Column:
    """The episode starts at this very reading; no episode is false."""
    return F.coalesce(as_col(begin) == as_col(tm), F.lit(False))


def condition_flag(c: str | Column, terms: list[str]) -> Column:
    return F.coalesce(as_col(c).isin(terms), F.lit(False))
