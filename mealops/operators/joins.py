"""Lookups, slot-aligned weather joins, roster ticks and previous-store lookback.

Broadcast or shuffle is left to the runtime size check (adaptive execution); a hint appears
only where the right side has a fixed number of rows. Hot keys in shuffled joins are split
by the adaptive skew join, which :func:`mealops.session.configure` turns on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timing import half_hour_slot
from .ordered import ordered_steps
from .running import running_totals


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str] | dict[str, str],
                   how: str = "left") -> DataFrame:
    """Equi-join where NULL keys match NULL keys; the right key columns are dropped."""
    pairs = dict(on) if isinstance(on, dict) else {c: c for c in on}
    if not pairs:
        raise ValueError("a join needs keys")
    renamed = right.withColumnsRenamed({r: f"_rk_{r}" for r in pairs.values()})
    cond = reduce(lambda a, b: a & b,
                  [F.col(l).eqNullSafe(F.col(f"_rk_{r}")) for l, r in pairs.items()])
    return left.join(renamed, cond, how).drop(*[f"_rk_{r}" for r in pairs.values()])


def left_lookup(df: DataFrame, dim: DataFrame, on: str | list[str] | dict[str, str],
                null_safe: bool = False, salt: int | None = None) -> DataFrame:
    """Keep every row, attach matching lookup columns.

    ``on`` is a key, several keys, or ``{left name: right name}``. ``salt`` spreads each key
    over that many tasks by repeating the lookup; use it for a known hot key when the
    lookup is small per key and adaptive execution is off.
    """
    keys = {on: on} if isinstance(on, str) else (dict(on) if isinstance(on, dict) else {c: c for c in on})
    if salt:
        row_hash = F.xxhash64(*[F.col(c) for c in df.columns])
        df = df.withColumn("_salt", F.pmod(row_hash, F.lit(salt)).cast("int"))
        dim = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        return left_lookup(df, dim, {**keys, "_salt": "_salt"}, null_safe).drop("_salt")
    if null_safe:
        return join_null_safe(df, dim, keys, "left")
    renamed = dim.withColumnsRenamed({r: f"_rk_{r}" for r in keys.values()})
    cond = reduce(lambda a, b: a & b, [F.col(l) == F.col(f"_rk_{r}") for l, r in keys.items()])
    return df.join(renamed, cond, "left").drop(*[f"_rk_{r}" for r in keys.values()])


def inner_pairs(a: DataFrame, b: DataFrame, on: str | list[str]) -> DataFrame:
    return a.join(b, on, "inner")


def keep_keys(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is present (semi-join; the key list needs no dedupe)."""
    return df.join(keys, on, "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys, on, "left_anti")


def attach_stats(df: DataFrame, by: list[str], **aggs: Column) -> DataFrame:
    """Group aggregates on every row: map-side aggregate, then join back, so that a hot
    group is not gathered the way an unordered window would gather it."""
    stats = df.groupBy(*by).agg(*[e.alias(n) for n, e in aggs.items()])
    return join_null_safe(df, stats, by, "left")


# --- weather -----------------------------------------------------------------------------

def slot_weather(weather: DataFrame, dedupe: bool = True) -> DataFrame:
    """Readings keyed by (station, date, tmref); ``dedupe`` keeps the latest reading of a
    slot so the join cannot multiply orders."""
    keyed = (weather.withColumn("date", F.to_date("tm"))
             .withColumn("tmref", F.hour("tm") + F.minute("tm") / F.lit(60.0)))
    if not dedupe:
        return keyed
    keyed = keyed.withColumn("tmref", half_hour_slot("tm"))
    rest = [c for c in keyed.columns if c not in ("station", "date", "tmref")]
    latest = keyed.groupBy("station", "date", "tmref").agg(
        F.max_by(F.struct(*rest), F.struct("tm", *[c for c in rest if c != "tm"])).alias("_r"))
    return latest.select("station", "date", "tmref", "_r.*")


def join_slot_weather(orders: DataFrame, weather: DataFrame, stations: dict[str, int],
                      slots: dict[str, tuple[str, str]], dedupe: bool = True) -> DataFrame:
    """Attach each station's reading at several order moments.

    ``stations`` maps a suffix to a station id (``{"hq": 1, "pd": 2}``); ``slots`` maps a
    second suffix to the (date, slot) columns (``{"p": ("place_date", "place_tmref")}``).
    Columns are named ``<reading>_<station><moment>``. All stations of a moment come in one
    join: the readings are first laid side by side per (date, slot).
    """
    keyed = slot_weather(weather, dedupe).filter(F.col("station").isin(list(stations.values())))
    cols = [c for c in keyed.columns if c not in ("station", "date", "tmref")]
    out = orders
    for moment, (date_col, slot_col) in slots.items():
        if dedupe:
            wide = keyed.groupBy("date", "tmref").agg(*[
                F.max(F.when(F.col("station") == sid, F.struct(c))).getField(c).alias(f"{c}_{name}{moment}")
                for name, sid in stations.items() for c in cols])
            out = left_lookup(out, wide, {date_col: "date", slot_col: "tmref"})
        else:
            for name, sid in stations.items():
                one = keyed.filter(F.col("station") == sid).select(
                    "date", "tmref", *[F.col(c).alias(f"{c}_{name}{moment}") for c in cols])
                out = left_lookup(out, one, {date_col: "date", slot_col: "tmref"})
    return out


def join_daily_hourly_weather(orders: DataFrame, daily: DataFrame, hourly: DataFrame) -> DataFrame:
    """Daily weather on the required date, one station's readings on the placing slot."""
    o = (orders.withColumn("require_date", F.to_date("require_tm"))
         .withColumn("place_date", F.to_date("place_tm"))
         .withColumn("place_tmref", half_hour_slot("place_tm")))
    with_day = left_lookup(o, daily, {"require_date": "date"})
    return left_lookup(with_day, hourly, {"place_date": "date", "place_tmref": "tmref"})


# --- roster ------------------------------------------------------------------------------

def tick_grid(dates: DataFrame, date_col: str = "date", start_min: int = 570, end_min: int = 1350,
              step_min: int = 30) -> DataFrame:
    """Every date with its ticks (default 09:30 to 22:30 each half hour)."""
    minutes = F.explode(F.sequence(F.lit(start_min), F.lit(end_min), F.lit(step_min))).alias("_m")
    return (dates.select(F.col(date_col).alias("date")).distinct().select("date", minutes)
            .select("date", (F.col("date").cast("timestamp_ntz")
                             + F.make_dt_interval(mins=F.col("_m"))).alias("tm")))


def active_at_ticks(shifts: DataFrame, dates: DataFrame | None = None, end_margin_min: int = 5,
                    start_min: int = 570, end_min: int = 1350, step_min: int = 30) -> DataFrame:
    """Riders on shift at each tick of their shift's date: ``begin < t`` and
    ``t + margin < end``, zero where nobody is.

    A shift names the ticks it covers itself (two integer bounds), so this is an explode and
    a count, not an inequality join. ``shifts`` has ``read_date, begin, end``.
    """
    day = F.col("read_date").cast("timestamp_ntz")
    first_after = F.floor(F.timestamp_diff("SECOND", day, F.col("begin")) / (60.0 * step_min)) + 1
    last_before = F.ceil((F.timestamp_diff("SECOND", day, F.col("end")) - 60 * end_margin_min)
                         / (60.0 * step_min)) - 1
    lo = F.greatest(first_after, F.lit(-(-start_min // step_min)))
    hi = F.least(last_before, F.lit(end_min // step_min))
    phase = start_min % step_min
    if phase:
        raise ValueError("the first tick must fall on the step grid")
    covered = (shifts.filter(F.col("begin").isNotNull() & F.col("end").isNotNull())
               .withColumn("_lo", lo).withColumn("_hi", hi).filter(F.col("_lo") <= F.col("_hi"))
               .select("read_date", F.explode(F.sequence("_lo", "_hi")).alias("_t")))
    counts = (covered.groupBy("read_date", "_t").agg(F.count(F.lit(1)).alias("avai_n30"))
              .select((F.col("read_date").cast("timestamp_ntz")
                       + F.make_dt_interval(mins=(F.col("_t") * step_min).cast("int"))).alias("tm"),
                      "avai_n30"))
    source = dates if dates is not None else shifts.select(F.col("read_date").alias("date"))
    grid = tick_grid(source, "date", start_min, end_min, step_min)
    return (grid.join(counts, "tm", "left")
            .select("date", "tm", F.coalesce("avai_n30", F.lit(0)).alias("avai_n30")))


# --- lookback ----------------------------------------------------------------------------

def previous_distinct(df: DataFrame, user: str = "user_id", store: str = "sup_id",
                      time: str = "finish_tm", id: str = "id", out: str = "alt_id") -> DataFrame:
    """For each order the same user's latest earlier order at another store (its id and
    store), NULL when there is none."""
    here = F.struct(F.col(store).alias("s"), F.col(id).alias("i"))
    found = ordered_steps(df, [user], [time, id], here,
                          lambda prev: prev.isNotNull() & ~prev["s"].eqNullSafe(F.col(store)), [store],
                          carry="_alt")
    return (found.withColumn(out, F.col("_alt.i")).withColumn(f"{out}_store", F.col("_alt.s")).drop("_alt"))


# --- positional --------------------------------------------------------------------------

def numbered(df: DataFrame, order_by: str, out: str = "position") -> DataFrame:
    """Global 1-based position along a unique column, NULL last."""
    return running_totals(df, [F.col(order_by).asc_nulls_last()], {}, number=out)


def bind_by_position(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """Columns of two frames side by side, row by row in their explicit orders."""
    return (numbered(a, order_a, "_pos").join(numbered(b, order_b, "_pos"), "_pos", "full_outer")
            .drop("_pos"))
