"""Order life-cycle durations, half-hour slots, dayparts and calendar parts.

All differences go through whole seconds so the unit never depends on the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import as_col, pmin_strict

__all__ = [
    "seconds_between", "minutes_between", "hours_between", "epoch_seconds", "plus_minutes",
    "durations_min", "durations_sec", "half_hour_slot", "rolled_slot", "decimal_hour",
    "daypart", "meal_hours", "seconds_of_day", "days_left", "calendar_parts", "slack_at",
    "rain_elapsed", "business_reset", "day_or_night", "parse_stamp", "stamp_parts",
    "parse_cn_date", "floor_time",
]

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def seconds_between(start: str | Column, end: str | Column) -> Column:
    return F.timestamp_diff("SECOND", as_col(start), as_col(end))


def minutes_between(start: str | Column, end: str | Column) -> Column:
    return seconds_between(start, end) / F.lit(60.0)


def hours_between(start: str | Column, end: str | Column) -> Column:
    return seconds_between(start, end) / F.lit(3600.0)


def epoch_seconds(ts: str | Column) -> Column:
    return seconds_between(F.expr(EPOCH), ts)


def plus_minutes(ts: str | Column, minutes: Column | int) -> Column:
    mins = F.lit(minutes) if isinstance(minutes, int) else minutes.cast("int")
    return as_col(ts) + F.make_dt_interval(mins=mins)


def floor_time(ts: str | Column, unit: str) -> Column:
    return F.date_trunc(unit, as_col(ts)).cast("timestamp_ntz")


def durations_min(df: DataFrame) -> DataFrame:
    """Minutes: delay, pre-order lead, preparation (from dispatch), ride, time left to cook,
    placing-to-dispatch gap."""
    return (df
            .withColumn("delay", minutes_between("require_tm", "finish_tm"))
            .withColumn("prereq", minutes_between("place_tm", "require_tm"))
            .withColumn("prepare", minutes_between("dipatch_tm", "leave_tm"))
            .withColumn("ride", minutes_between("leave_tm", "finish_tm"))
            .withColumn("allow_cook", F.col("prereq") - F.col("ride"))
            .withColumn("left1", minutes_between("place_tm", "dipatch_tm")))


def durations_sec(df: DataFrame) -> DataFrame:
    """Seconds, with the other definitions used for the second city: preparation counts from
    receipt and the slack columns subtract cooking and riding from the lead.

    ``left2`` needs ``cook_tm``/``cookable_tm``, ``left3`` needs ``dish_longer`` (minutes);
    each is added only when its inputs exist.
    """
    out = (df
           .withColumn("delay", seconds_between("require_tm", "finish_tm"))
           .withColumn("prereq", seconds_between("place_tm", "require_tm"))
           .withColumn("prepare", seconds_between("receive_tm", "leave_tm"))
           .withColumn("ride", seconds_between("leave_tm", "finish_tm"))
           .withColumn("allow_cook", F.col("prereq") - F.col("ride"))
           .withColumn("left1", F.col("prereq") - (F.col("prepare") + F.col("ride"))))
    if {"cook_tm", "cookable_tm"} <= set(df.columns):
        out = (out.withColumn("cooka", seconds_between("cook_tm", "cookable_tm"))
               .withColumn("left2", F.col("prereq") - (F.col("cooka") + F.col("ride"))))
    if "dish_longer" in df.columns:
        out = out.withColumn("left3", F.col("prereq") - (F.col("dish_longer") * 60 + F.col("ride")))
    return out


def half_hour_slot(ts: str | Column) -> Column:
    """Nearest half hour as a decimal hour. 23:45 and later gives 24.0 on the same date."""
    c = as_col(ts)
    minute = F.minute(c)
    step = F.when(minute < 15, 0.0).when(minute < 45, 0.5).otherwise(1.0)
    return F.hour(c) + F.when(c.isNotNull(), step)


def rolled_slot(ts: str | Column) -> tuple[Column, Column]:
    """(date, slot) where 24.0 becomes 0.0 of the next date."""
    c, slot = as_col(ts), half_hour_slot(ts)
    over = slot >= 24
    return (F.when(over, F.date_add(F.to_date(c), 1)).otherwise(F.to_date(c)),
            F.when(over, F.lit(0.0)).otherwise(slot))


def decimal_hour(hour: str | Column, minute: str | Column) -> Column:
    return as_col(hour) + as_col(minute) / F.lit(60.0)


def daypart(slot: str | Column) -> Column:
    """lunch / dinner by half-hour slot; anything else, NULL included, is other."""
    c = as_col(slot)
    return (F.when(c.between(11.5, 14.5), "lunch")
            .when(c.between(17.5, 20.5), "dinner")
            .otherwise("other"))


def meal_hours(ts: str | Column) -> tuple[Column, Column]:
    """Clock-hour flags: lunch [10,14) and dinner [17,20)."""
    h = F.hour(as_col(ts))
    return (h >= 10) & (h < 14), (h >= 17) & (h < 20)


def seconds_of_day(ts: str | Column) -> Column:
    c = as_col(ts)
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def days_left(ts: str | Column) -> Column:
    """Days remaining until the end of the month."""
    c = as_col(ts)
    return F.day(F.last_day(F.to_date(c))) - F.day(c)


def calendar_parts(df: DataFrame, ts: str, prefix: str = "") -> DataFrame:
    c = F.col(ts)
    return (df.withColumn(f"{prefix}year", F.year(c)).withColumn(f"{prefix}month", F.month(c))
            .withColumn(f"{prefix}day", F.day(c)).withColumn(f"{prefix}date", F.to_date(c)))


def slack_at(require_tm: str | Column, ts: str | Column) -> Column:
    """Minutes left before the required time at moment ``ts``."""
    return minutes_between(ts, require_tm)


def business_reset(ts: str | Column, reset_hour: int = 6) -> Column:
    """Start of the business day: today's reset hour, or yesterday's before it."""
    c = as_col(ts)
    day = F.to_date(c)
    start = F.when(F.hour(c) >= reset_hour, day).otherwise(F.date_sub(day, 1))
    return start.cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(reset_hour))


def rain_elapsed(place_tm: str | Column, begin: str | Column,
                 reset_hour: int = 6) -> tuple[Column, Column]:
    """Hours since the rain episode began, measured at the order's half-hour slot, and the
    same capped by the hours since the business day began. NULL in, NULL out."""
    place, start = as_col(place_tm), as_col(begin)
    elapsed = (half_hour_slot(place) - decimal_hour(F.hour(start), F.minute(start))
               + F.datediff(F.to_date(place), F.to_date(start)) * 24)
    return elapsed, pmin_strict(elapsed, hours_between(business_reset(place, reset_hour), place))


def day_or_night(ts: str | Column, day: str | Column, night: str | Column, cut: int = 18) -> Column:
    return F.when(F.hour(as_col(ts)) > cut, as_col(night)).otherwise(as_col(day))


def parse_stamp(c: str | Column) -> Column:
    """Compact ``yyyyMMddHHmm`` stamps; unparsable text gives NULL."""
    return F.try_to_timestamp(as_col(c).cast("string"), F.lit("yyyyMMddHHmm")).cast("timestamp_ntz")


def stamp_parts(c: str | Column) -> dict[str, Column]:
    """Calendar parts cut by position out of a compact stamp."""
    s = as_col(c).cast("string")
    cuts = {"year": (1, 4), "month": (5, 2), "day": (7, 2), "hr": (9, 2), "min": (11, 2)}
    return {name: F.substring(s, pos, length).try_cast("int") for name, (pos, length) in cuts.items()}


def parse_cn_date(c: str | Column) -> Column:
    """``2015年07月01日`` style dates."""
    return F.to_date(F.try_to_timestamp(as_col(c), F.lit("yyyy年MM月dd日")))
