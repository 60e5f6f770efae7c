"""Orders to the derived feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import safe_ratio
from ..functions.timing import durations_min, half_hour_slot
from ..operators.aggregates import orders_per_slot, user_profile
from ..operators.joins import active_at_ticks, left_lookup
from ..operators.windows import (avg_on_hand, cumulative_shift_orders, experiences, shift_rollup, shifts)


def add_slots(df: DataFrame) -> DataFrame:
    return (df.withColumn("place_date", F.to_date("place_tm"))
            .withColumn("require_date", F.to_date("require_tm"))
            .withColumn("place_tmref", half_hour_slot("place_tm"))
            .withColumn("require_tmref", half_hour_slot("require_tm")))


def add_work_ratio(df: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """Riders on shift, orders and their ratio for the required half hour. ``roster`` is a
    stored roster table; without it shifts are derived from the same orders."""
    if roster is None:
        roster = active_at_ticks(shift_rollup(shifts(df.select("id", "rider_id", "read_tm", "finish_tm"))))
    ticks = roster.select(F.to_date("tm").alias("date"), half_hour_slot("tm").alias("tmref"), "avai_n30")
    out = left_lookup(df, ticks, {"require_date": "date", "require_tmref": "tmref"})
    out = left_lookup(out, orders_per_slot(df), {"require_date": "read_date", "require_tmref": "require_tmref"})
    return out.withColumn("ow_ratio", safe_ratio("order_n", "avai_n30"))


def feature_build(orders: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """Durations, slots, work ratio, experience, load on hand, shifts and user profile.

    The experience, shift and load columns are each computed from the stored orders on the
    few columns they need and meet again on the order id, so wide rows are not carried
    through every sort. Give a stored ``roster`` at scale: it is a table per day and half
    hour that need not be derived again.
    """
    df = add_work_ratio(add_slots(durations_min(orders)), roster)
    history = experiences(orders, {"user_exp": ("user_id", "place_tm"), "rider_exp": ("rider_id", "read_tm"),
                                   "sup_exp": ("sup_id", "read_tm")})
    shifted = shifts(orders.select("id", "rider_id", "read_tm", "finish_tm"))
    table = cumulative_shift_orders(shift_rollup(shifted)).drop("begin", "end")
    shifted = (left_lookup(shifted, table, ["rider_id", "read_date", "r_shift"], null_safe=True)
               .select("id", "read_date", "r_new_shift", "r_shift", "r_inshift_n", "r_exp_n"))
    for derived in (history, shifted, avg_on_hand(orders)):
        df = left_lookup(df, derived, "id")
    return left_lookup(df, user_profile(orders), "user_id")
