"""The analyses run on the model sample: descriptives, lateness regressions, instruments,
channels, repeat customers and the rider income threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import censor, dead_zone, f_to_c, floor_bucket, speed_columns
from ..functions.timing import days_left, meal_hours, seconds_between, slack_at
from ..functions.weather import sudden_rain
from ..operators.aggregates import (box_stats, distinct_summary, experience_range, slot_summary,
                                    summary_stats, trend)
from ..operators.filters import close_to_previous
from ..operators.models.regression import crossed, iv_2sls, ols_specs
from ..operators.windows import lag_orders, rider_month_running

# Regressor lists of the lateness models.
CONTROLS = ["prepare", "price", "rider_exp", "user_exp", "onhand", "ow_ratio", "rider_income", "dist"]
DELAY_SPECS = {
    "lm1ii": ["prereq", "price", "rider_income"],
    "lm1i": ["prereq", "prepare", "price", "rider_exp", "user_exp", "rider_income"],
    "lm1iii": ["prereq", "prepare", "price", "rider_exp", "user_exp", "onhand", "rider_income"],
    "lm1iv": ["prereq", "prepare", "price", "rider_exp", "user_exp", "onhand", "ow_ratio", "rider_income"],
    "lm1": ["prereq", *CONTROLS],
}
TEMPERATURE = ["temp_hqp", "temp_pdp"]
SUDDEN_RAIN = ["sudden_rain_hqp", "sudden_rain_pdp"]
FIRST_STAGE_SPECS = {"lm2": [*TEMPERATURE, *CONTROLS], "lm3": [*TEMPERATURE, *SUDDEN_RAIN, *CONTROLS]}
SLACK_SPEC = ["cpm", "prereq", *crossed("price", "menu_num")]


def with_outcomes(df: DataFrame) -> DataFrame:
    """Dead-zone and censored lateness and sudden-rain flags."""
    df = df.withColumn("disap", dead_zone("delay")).withColumn("delay_cens", censor("delay"))
    for station in ("hqp", "pdp"):
        df = df.withColumn(f"sudden_rain_{station}",
                           sudden_rain(f"pcp_begin_{station}", f"tm_{station}").cast("int"))
    return df


def descriptives(df: DataFrame) -> dict[str, DataFrame]:
    """Order, user, rider and restaurant summary tables (currency units for money)."""
    orders = df.withColumn("rider_income", F.col("rider_income") / 100).withColumn("price", F.col("price") / 100)
    users = ["u_delay_avg", "u_n_tt", "u_prereq_avg", "u_price_avg", "u_price_sd", "u_rinc_avg", "u_span"]
    riders = experience_range(df, "rider_id", exp="r_exp_n", orders="r_inshift_n")
    stores = experience_range(df, "sup_id", exp="sup_exp")
    return {
        "order": summary_stats(orders, ["prereq", "prepare", "ride", "delay", "rider_income", "price"]),
        "user": distinct_summary(df, ["user_id"], users),
        "rider": summary_stats(riders, ["exp_max", "exp_min", "orders_max", "orders_min"]),
        "restaurant": summary_stats(stores, ["exp_max", "exp_min"]),
    }


def delay_regressions(df: DataFrame, y: str = "delay", minute_mod: int | None = None) -> DataFrame:
    """The lateness specifications side by side, optionally only for whole required minutes."""
    if minute_mod:
        df = df.filter(F.minute("require_tm") % minute_mod == 0)
    return ols_specs(df, y, DELAY_SPECS)


def iv_regressions(df: DataFrame, y: str = "delay", rain: bool = True) -> DataFrame:
    """Lead instrumented by temperature (and sudden rain) at placing time."""
    return iv_2sls(df, y, ["prereq"], CONTROLS, [*TEMPERATURE, *(SUDDEN_RAIN if rain else [])])


def first_stages(df: DataFrame) -> DataFrame:
    return ols_specs(df, "prereq", FIRST_STAGE_SPECS)


def slack_regressions(df: DataFrame, slack: str, cuts: tuple[float, ...]) -> DataFrame:
    """Lateness on lead among orders with more than each amount of slack."""
    out = None
    for cut in cuts:
        one = ols_specs(df.filter(F.col(slack) > cut), "delay", {f"{slack}>{cut:g}": SLACK_SPEC})
        out = one if out is None else out.unionByName(one)
    return out


def channels(df: DataFrame) -> dict[str, DataFrame]:
    """Slots with short leads, and what an earlier call-in buys (box statistics)."""
    lead = df.withColumn("prereq_05m", floor_bucket("prereq", 5).cast("long"))
    lead = lead.withColumn("leav", slack_at("require_tm", "leave_tm")).withColumn(
        "rece", slack_at("require_tm", "receive_tm"))
    return {
        "slots": slot_summary(df, max_prereq=60),
        "after_leaving": box_stats(lead, "prereq_05m", "leav"),
        "after_receiving": box_stats(lead, "prereq_05m", "rece"),
        "delay": box_stats(lead, "prereq_05m", "delay"),
        "lead_by_minute": box_stats(df.withColumn("m", F.minute("require_tm")), "m", "prereq"),
        "lead_by_celsius": box_stats(df.filter(F.col("temp_pdp").isNotNull())
                                     .withColumn("celsius", f_to_c("temp_pdp")), "celsius", "prereq"),
    }


def repeat_customers(df: DataFrame) -> DataFrame:
    """Lunch orders with the same pair's previous order."""
    lunch = df.filter(F.col("tmref_cat") == "lunch")
    return lag_orders(lunch, ["user_id", "sup_id"], ["delay", "require_tm", "place_tm", "prereq"])


def lead_adjustment(lagged: DataFrame, occasion: int | None = None, noon: bool = False,
                    near_previous: bool = False, by_occasion: bool = False) -> DataFrame:
    """Change of lead against the previous lateness: straight-line fit."""
    df = lagged
    if noon:
        df = df.filter((F.hour("require_tm_lag1") == 12) & (F.minute("require_tm_lag1") == 5))
    if near_previous:
        df = close_to_previous(df, "require_tm", "require_tm_lag1", occ=None)
    if occasion:
        df = df.filter(F.col("occ") == occasion)
    if by_occasion:
        df = df.filter(F.col("occ") < 7)
    return trend(df, "delay_lag1", F.col("prereq") - F.col("prereq_lag1"), by=["occ"] if by_occasion else [])


def rider_income_table(orders: DataFrame, threshold: float = 3000) -> DataFrame:
    """Orders with speed, running month income, days left and meal-hour flags. Needs all
    orders with route and load columns (``dist``, ``time`` in minutes, ``onhand``; NULL where
    unknown): income, rank and month flags count every order, the validity filter comes
    after. Stage it before running several threshold analyses on it."""
    lunch, dinner = meal_hours("require_tm")
    run = rider_month_running(orders, threshold=threshold)
    return (speed_columns(run, seconds_between("leave_tm", "finish_tm"))
            .withColumn("remain_days", days_left("finish_tm"))
            .withColumn("lunch_hr", lunch).withColumn("dinner_hr", dinner))
