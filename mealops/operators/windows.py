"""Experience, shifts, orders on hand, weather regimes, lags, running income.

Anything ordered inside a user, rider or store goes through :mod:`.ordered`. Plain windows
remain only where a group is small by construction (a station's half hours, a rider's
shifts, the rows of one choice set, the seconds of a day).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.timing import decimal_hour, epoch_seconds, seconds_between, seconds_of_day
from .joins import attach_stats, join_null_safe, left_lookup
from .ordered import ordered, ordered_steps


def experience(df: DataFrame, key: str, time: str, id: str = "id", out: str = "exp") -> DataFrame:
    """How many orders this user/rider/store has had up to and including this one."""
    return ordered(df, [key], [time, id], running={out: F.lit(1)})


def prior_purchases(df: DataFrame, by: list[str] = ("user_id", "sup_id"), time: str = "finish_tm",
                    id: str = "id") -> DataFrame:
    """``ss`` earlier orders of the same user at the same store, ``ss_b4`` whether any."""
    return (ordered(df, list(by), [time, id], running={"_n": F.lit(1)})
            .withColumn("ss", F.col("_n") - 1)
            .withColumn("ss_b4", (F.col("_n") > 1).cast("int")).drop("_n"))


def lag_orders(df: DataFrame, by: list[str], cols: list[str], time: str = "place_tm",
               id: str = "id", drop_first: bool = True) -> DataFrame:
    """Previous order's columns (``<col>_lag1``), occasion number and pair total."""
    out = ordered(df, list(by), [time, id], lags={f"{c}_lag1": F.col(c) for c in cols},
                  running={"occ": F.lit(1)}, totals={"tt_order": F.lit(1)})
    return out.filter(F.col(f"{cols[0]}_lag1").isNotNull()) if drop_first else out


def experiences(df: DataFrame, keys: dict[str, tuple[str, str]], id: str = "id") -> DataFrame:
    """Several experience columns at once, ``{out: (key, time)}``: each is computed from the
    input on the three columns it needs and they meet on the id."""
    out = None
    for name, (key, time) in keys.items():
        one = experience(df.select(id, key, time), key, time, id, name).select(id, name)
        out = one if out is None else out.join(one, id)
    return out


# --- shifts ------------------------------------------------------------------------------

def shifts(df: DataFrame, rider: str = "rider_id", read_tm: str = "read_tm",
           finish_tm: str = "finish_tm", id: str = "id", gap_h: float = 1) -> DataFrame:
    """``read_date``, ``r_new_shift`` and ``r_shift``: within a rider's day a new shift starts
    when an order is read more than ``gap_h`` hours after the previous one was finished."""
    dated = df.withColumn("read_date", F.to_date(read_tm))
    return ordered_steps(dated, [rider, "read_date"], [read_tm, id], F.col(finish_tm),
                         lambda prev: seconds_between(prev, read_tm) > gap_h * 3600, [read_tm],
                         flag="r_new_shift", count="r_shift")


def shift_rollup(df: DataFrame, rider: str = "rider_id") -> DataFrame:
    """One row per shift: first read, last finish and number of orders."""
    return (df.groupBy(rider, "read_date", "r_shift")
            .agg(F.min("read_tm").alias("begin"), F.max("finish_tm").alias("end"),
                 F.count(F.lit(1)).alias("r_inshift_n")))


def cumulative_shift_orders(shift_table: DataFrame, rider: str = "rider_id") -> DataFrame:
    """Orders finished up to the end of each shift. A rider has at most 24 shifts a day
    (shifts are an hour apart), so a rider's window is bounded by the calendar."""
    w = W.partitionBy(rider).orderBy("read_date", "r_shift").rowsBetween(W.unboundedPreceding, 0)
    return shift_table.withColumn("r_exp_n", F.sum("r_inshift_n").over(w))


# --- orders on hand ----------------------------------------------------------------------

def to_events(df: DataFrame, ids: list[str], ts_cols: list[str], name: str = "action",
              value: str = "tm") -> DataFrame:
    """Wide life-cycle stamps to one event row per stamp."""
    return df.select(*ids, *ts_cols).unpivot(ids, ts_cols, name, value)


def _hand_events(df: DataFrame, rider: str, start: str, end: str, id: str) -> DataFrame:
    picked = df.filter(F.col(start).isNotNull())
    events = to_events(picked, [rider, id], [start, end])
    return (events.withColumn("delta", F.when(F.col("action") == start, 1).otherwise(-1))
            .withColumn("_end", F.col("action") == end))


def on_hand(df: DataFrame, rider: str = "rider_id", start: str = "arrive_tm",
            end: str = "finish_tm", id: str = "id") -> DataFrame:
    """Event rows with the number of orders the rider holds right after each event."""
    return ordered(_hand_events(df, rider, start, end, id), [rider], ["tm", "_end", id],
                   running={"onhand": F.col("delta")}).drop("_end")


def avg_on_hand(df: DataFrame, rider: str = "rider_id", start: str = "arrive_tm",
                end: str = "finish_tm", id: str = "id") -> DataFrame:
    """Per order: ``onhandXdur`` (order-minutes held between own start and end) and its
    time-weighted average ``onhand``; NULL when the order ends before or as it starts.

    With D the running sum of the ±1 events and M the running sum of event × time, the
    order-seconds held up to an event at time T are ``T*D - M``, so each order only needs
    the difference between its two own events; no overlap join.
    """
    events = _hand_events(df, rider, start, end, id).withColumn("_t", epoch_seconds("tm"))
    held = ordered(events, [rider], ["tm", "_end", id],
                   running={"_d": F.col("delta"), "_m": F.col("delta") * F.col("_t")})
    area = F.col("_t") * F.col("_d") - F.col("_m")
    at = lambda e, col: F.max(F.when(F.col("action") == e, col))
    ends = held.groupBy(id).agg(at(start, area).alias("_a0"), at(end, area).alias("_a1"),
                                at(start, F.col("_t")).alias("_t0"), at(end, F.col("_t")).alias("_t1"))
    seconds = F.col("_t1") - F.col("_t0")
    area_s = F.when(seconds > 0, F.col("_a1") - F.col("_a0"))
    return ends.select(id, (area_s / 60.0).alias("onhandXdur"), (area_s / seconds).alias("onhand"))


# --- weather -----------------------------------------------------------------------------

def regimes(df: DataFrame, station: str, tm: str, flag: str, out: str) -> DataFrame:
    """Number the alternating wet/dry runs of each station. A station reports on a fixed
    clock, so its window is bounded by the calendar. Readings of one stamp are ordered by
    their flag (NULL, dry, wet), so the numbers do not depend on the order of rows."""
    w = W.partitionBy(station).orderBy(tm, flag)
    flip = F.coalesce((F.col(flag) != F.lag(flag).over(w)).cast("int"), F.lit(1))
    return (df.withColumn("_flip", flip)
            .withColumn(out, F.sum("_flip").over(w.rowsBetween(W.unboundedPreceding, 0)))
            .drop("_flip"))


def episode_start(df: DataFrame, station: str, tm: str, regime: str, flag: str, out: str) -> DataFrame:
    """First reading of the run (``<out>``) and its decimal hour (``<out>ref``), only while
    the flag holds."""
    first = F.min(tm).over(W.partitionBy(station, regime))
    return (df.withColumn(out, F.when(F.col(flag), first))
            .withColumn(f"{out}ref", decimal_hour(F.hour(out), F.minute(out))))


# --- income, gaps ------------------------------------------------------------------------

def rider_month_running(df: DataFrame, threshold: float = 3000, subsidy: int = 300,
                        rider: str = "rider_id", finish_tm: str = "finish_tm", id: str = "id") -> DataFrame:
    """Within a rider's month, in finishing order: order rank, running income and running
    income with a per-order subsidy (cents), and whether the month ever passes the threshold
    (currency units) under either."""
    base = (df.withColumn("_y", F.year(finish_tm)).withColumn("month", F.month(finish_tm))
            .withColumn("ri_subs", F.col("rider_income") + subsidy))
    run = ordered(base, [rider, "_y", "month"], [finish_tm, id],
                  running={"count_atm": F.lit(1), "inc_atm": F.col("rider_income"),
                           "sinc_atm": F.col("ri_subs")},
                  peaks={"_pi": "inc_atm", "_ps": "sinc_atm"})
    return (run.withColumn("excel_month", F.col("_pi") / 100 > threshold)
            .withColumn("sexcel_month", F.col("_ps") / 100 > threshold).drop("_y", "_pi", "_ps"))


def gap_to_next(df: DataFrame, rider: str = "rider_id", finish: str = "finish_tm",
                max_s: int = 7200, id: str = "id") -> DataFrame:
    """Seconds until the rider's next finished order, kept below ``max_s``."""
    out = ordered(df, [rider], [finish, id], leads={"_next": F.col(finish)})
    return (out.withColumn("next_gap", seconds_between(finish, "_next")).drop("_next")
            .filter(F.col("next_gap") < max_s))


# --- distribution-based ------------------------------------------------------------------

def seconds_distribution(df: DataFrame, ts: str, by: list[str] = ()) -> DataFrame:
    """(by, place_sec) with count, min-rank, share at or below the rank and median second.
    At most 86,400 rows per group, which bounds every window here."""
    by = list(by)
    counts = (df.withColumn("place_sec", seconds_of_day(ts)).filter(F.col("place_sec").isNotNull())
              .groupBy(*by, "place_sec").agg(F.count(F.lit(1)).alias("n_at")))
    whole = W.partitionBy(*by)
    before = F.coalesce(F.sum("n_at").over(whole.orderBy("place_sec").rowsBetween(W.unboundedPreceding, -1)),
                        F.lit(0))
    ranked = counts.withColumn("_b", before).withColumn("n_total", F.sum("n_at").over(whole))
    mid = (F.col("n_total") - 1) / 2.0

    def at(rank: Column) -> Column:
        inside = (rank >= F.col("_b")) & (rank < F.col("_b") + F.col("n_at"))
        return F.max(F.when(inside, F.col("place_sec"))).over(whole)

    return (ranked.withColumn("place_med", (at(F.floor(mid)) + at(F.ceil(mid))) / 2.0)
            .withColumn("place_rank", F.col("_b") + 1)
            .withColumn("place_pct", F.col("place_rank") / F.col("n_total")).drop("_b"))


def time_of_day_percentile(df: DataFrame, ts: str, by: list[str] = ()) -> DataFrame:
    """Every row with its time-of-day rank and percentile position."""
    dist = seconds_distribution(df, ts, by)
    return join_null_safe(df.withColumn("place_sec", seconds_of_day(ts)), dist, [*by, "place_sec"])


def around_median(dist: DataFrame, earlier_s: int = 60, near_s: int | None = None) -> DataFrame:
    """Distribution rows at the median second and exactly ``earlier_s`` before it, or with
    ``near_s`` all rows less than that far from the median."""
    if near_s is not None:
        return dist.filter(F.abs(F.col("place_sec") - F.col("place_med")) < near_s)
    return dist.filter((F.col("place_sec") == F.col("place_med"))
                       | (F.col("place_sec") == F.col("place_med") - earlier_s))


# --- small groups and totals -------------------------------------------------------------

def choice_regret(df: DataFrame, id: str, ex_ante: str, realised: str) -> DataFrame:
    """Within one choice set (two rows by construction): mean expected and realised
    utility, the ex-ante best row and the realised loss against it."""
    w = W.partitionBy(id)
    best = F.col(ex_ante) == F.max(ex_ante).over(w)
    return (df.withColumn(f"{ex_ante}_avg", F.avg(ex_ante).over(w))
            .withColumn(f"{realised}_avg", F.avg(realised).over(w))
            .withColumn("best_ex_ante", best)
            .withColumn("util_loss", F.sum(F.when(F.col("best_ex_ante"), F.col(realised)).otherwise(0.0)).over(w)
                        - F.col(realised)))


def market_share(df: DataFrame, n: str = "n") -> DataFrame:
    """Market size and share on every row (scalar subquery, one value broadcast)."""
    return (df.withColumn("size", df.agg(F.sum(n)).scalar())
            .withColumn("shares", F.col(n) / F.col("size")))


def zscore(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns centred and scaled by the sample deviation (``<col>_z``); a constant column
    gives NULL."""
    stats = df.agg(F.struct(*[f(c).alias(f"{p}_{c}") for c in cols
                              for p, f in (("m", F.avg), ("s", F.stddev_samp))]).alias("z"))
    out = df.withColumn("_z", stats.scalar())
    return out.withColumns({f"{c}_z": F.try_divide(F.col(c) - F.col(f"_z.m_{c}"), F.col(f"_z.s_{c}"))
                            for c in cols}).drop("_z")


def demean(df: DataFrame, group: str, cols: list[str]) -> DataFrame:
    """Within-group deviations (``<col>_dm``)."""
    out = attach_stats(df, [group], **{f"_m_{c}": F.avg(c) for c in cols})
    return out.withColumns({f"{c}_dm": F.col(c) - F.col(f"_m_{c}") for c in cols}) \
              .drop(*[f"_m_{c}" for c in cols])


def with_count(df: DataFrame, by: list[str], out: str = "n") -> DataFrame:
    return attach_stats(df, list(by), **{out: F.count(F.lit(1))})


def user_lookup(df: DataFrame, profile: DataFrame, user: str = "user_id") -> DataFrame:
    return left_lookup(df, profile, user)
