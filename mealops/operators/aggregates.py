"""Grouped profiles, market tables, summaries, frequency and histogram tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.timing import minutes_between, seconds_between, seconds_of_day
from .joins import attach_stats, join_null_safe
from .quantiles import column_moments, column_quantiles, exact_quantiles

def _rows() -> Column:
    return F.count(F.lit(1))


# --- profiles ----------------------------------------------------------------------------

def user_profile(df: DataFrame) -> DataFrame:
    """Order count, income, lateness, lunch habit, lead, spend and span per user."""
    hour = F.avg(F.hour("require_tm"))
    return df.groupBy("user_id").agg(
        _rows().alias("u_n_tt"), F.avg("rider_income").alias("u_rinc_avg"),
        F.avg(minutes_between("require_tm", "finish_tm")).alias("u_delay_avg"),
        ((hour > 10) & (hour < 14)).alias("u_lunch_avg"),
        F.avg(minutes_between("place_tm", "require_tm")).alias("u_prereq_avg"),
        F.avg("price").alias("u_price_avg"), F.stddev_samp("price").alias("u_price_sd"),
        (seconds_between(F.min("finish_tm"), F.max("finish_tm")) / 86400.0).alias("u_span"))


def user_profile_cluster(df: DataFrame, max_n: int = 10, max_income: float = 1100,
                         max_price: float = 10000) -> DataFrame:
    """Profile used for clustering: required time as epoch seconds, span from first placing
    to last finish in seconds; light users only."""
    from ..functions.timing import epoch_seconds
    req = epoch_seconds("require_tm")
    return df.groupBy("user_id").agg(
        _rows().alias("u_n_tt"), F.avg("rider_income").alias("u_rinc_avg"),
        F.stddev_samp("rider_income").alias("u_rinc_sd"), F.avg(req).alias("u_req_avg"),
        F.stddev_samp(req).alias("u_req_sd"), F.avg("price").alias("u_price_avg"),
        F.stddev_samp("price").alias("u_price_sd"),
        seconds_between(F.min("place_tm"), F.max("finish_tm")).alias("u_span")).filter(
        (F.col("u_n_tt") <= max_n) & (F.col("u_rinc_avg") < max_income)
        & (F.col("u_price_avg") < max_price))


# Cuisine tags behind the market-table flags.
CUISINE_FLAGS = {"tag_cnfast": ["中式快餐简餐"], "tag_jp": ["日本菜", "寿司"], "tag_snack": ["甜点饮品"]}


def market_table(df: DataFrame, day: str | None = None, min_n: int = 5, id: str = "id") -> DataFrame:
    """One day's stores: orders, ratings, spend, cuisine flags and market share, stores with
    an expense range and at least ``min_n`` orders. Shares are of all orders of the day."""
    one_day = df.filter(F.to_date("require_tm") == F.lit(day).cast("date")) if day else df
    first = lambda c: F.min_by(c, id).alias(c)
    stores = one_day.groupBy("sup_id", "name").agg(
        _rows().alias("n"), *[first(c) for c in ("taste", "envir", "service", "avgexp_lo", "avgexp_up", "tag1")],
        (F.avg(F.col("price") + F.col("rider_income")) / 100).alias("actexp"),
        (F.avg("rider_income") / 100).alias("avgfee"), F.avg("dist").alias("avgdist"))
    total = one_day.agg(_rows()).scalar()
    return (stores.withColumn("avgexp", (F.col("avgexp_lo") + F.col("avgexp_up")) / 2)
            .withColumns({k: F.col("tag1").isin(v) for k, v in CUISINE_FLAGS.items()})
            .withColumn("size", total).withColumn("shares", F.col("n") / F.col("size"))
            .filter(F.col("avgexp_lo").isNotNull() & (F.col("n") >= min_n)))


def rider_month(df: DataFrame, subsidy: int = 300, min_income: float | None = None) -> DataFrame:
    """Income, subsidised income, orders, speed and complication per rider and month;
    ``min_income`` (currency) keeps riders above it."""
    out = df.groupBy("rider_id", F.month("finish_tm").alias("month")).agg(
        F.sum("rider_income").alias("inc"), F.sum(F.col("rider_income") + subsidy).alias("inc_subs"),
        _rows().alias("num"), F.avg("speed").alias("speed_avg"), F.stddev_samp("speed").alias("speed_sd"),
        F.avg("bdunexp").alias("bdunexp_avg"), F.stddev_samp("bdunexp").alias("bdunexp_sd"))
    return out if min_income is None else out.filter(F.col("inc_subs") / 100 > min_income)


def slot_summary(df: DataFrame, max_prereq: float | None = None) -> DataFrame:
    """Mean lead, orders and on-time orders per half-hour slot."""
    out = (df.groupBy("require_date", "require_tmref", "tmref_cat")
           .agg(F.avg("prereq").alias("avg_prereq"), _rows().alias("count"),
                F.count_if(F.col("delay") < 0).alias("count_ontime"))
           .withColumn("lunch", F.col("tmref_cat") == "lunch"))
    return out if max_prereq is None else out.filter(F.col("avg_prereq") < max_prereq)


def orders_per_slot(df: DataFrame) -> DataFrame:
    """Orders read per date and required slot."""
    return (df.groupBy(F.to_date("read_tm").alias("read_date"), "require_tmref")
            .agg(_rows().alias("order_n")))


def system_pressure(df: DataFrame) -> DataFrame:
    return (df.groupBy("require_tmref", "require_date").agg(F.avg("ow_ratio").alias("sys_pressure")))


def day_competition(df: DataFrame, by_slot: bool = False) -> DataFrame:
    """Per date and daypart (optionally slot): orders of the daypart, mean and median lead,
    mean and median placing second of the day."""
    day = ["require_date", "tmref_cat"]
    grain = day + (["require_tmref"] if by_slot else [])
    df = df.withColumn("place_sec", seconds_of_day("place_tm"))
    base = df.groupBy(*grain).agg(_rows().alias("_n"), F.avg("prereq").alias("prereq_avg"),
                                  F.avg("place_sec").alias("place_avg"))
    # the finer table has at most 49 rows per date and daypart
    base = base.withColumn("day_orders", F.sum("_n").over(W.partitionBy(*day))).drop("_n")
    med = column_quantiles(df, grain, ["prereq", "place_sec"], {"med": 0.5})
    wide = med.groupBy(*grain).agg(*[
        F.max(F.when(F.col("column") == c, F.col("med"))).alias(a)
        for c, a in (("prereq", "prereq_med"), ("place_sec", "place_med"))])
    return join_null_safe(base, wide, grain)


def experience_range(df: DataFrame, key: str, **cols: str) -> DataFrame:
    """``experience_range(df, "rider_id", exp="r_exp_n")`` → ``exp_max, exp_min`` per key."""
    aggs = []
    for alias, col in cols.items():
        aggs += [F.max(col).alias(f"{alias}_max"), F.min(col).alias(f"{alias}_min")]
    return df.groupBy(key).agg(*aggs)


def group_mean_median(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Mean and median of each column per group (wide)."""
    means = df.groupBy(*by).agg(*[F.avg(c).alias(f"{c}_mean") for c in cols])
    med = column_quantiles(df, by, cols, {"med": 0.5})
    wide = med.groupBy(*by).agg(*[F.max(F.when(F.col("column") == c, F.col("med"))).alias(f"{c}_median")
                                  for c in cols])
    return join_null_safe(means, wide, by)


# --- summaries ---------------------------------------------------------------------------

_QUANTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}


def summary_stats(df: DataFrame, cols: list[str], by: list[str] = (),
                  stats: tuple[str, ...] = ("n", "mean", "sd", "p25", "median", "p75", "max")) -> DataFrame:
    """One row per (group and) column with the requested statistics."""
    by, cols = list(by), list(cols)
    keys = [*by, "column"]
    out = moments = column_moments(df, by, cols)
    probs = {k: p for k, p in _QUANTILES.items() if k in stats}
    if probs:
        out = join_null_safe(out, column_quantiles(df, by, cols, probs, moments=moments), keys)
    return out.select(*keys, *[s if s in probs else F.col(f"_m_{s}").alias(s) for s in stats])


def six_number(df: DataFrame, cols: list[str] | str, where: Column | None = None,
               by: list[str] = (), with_n: bool = False) -> DataFrame:
    """min, p25, median, mean, p75, max and the number of NULLs per column."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    by = list(by)
    df = df.filter(where) if where is not None else df
    keys = [*by, "column"]
    moments = column_moments(df, by, cols)
    out = join_null_safe(moments, column_quantiles(df, by, cols, _QUANTILES, moments=moments), keys)
    m = lambda s: F.col(f"_m_{s}").alias(s)
    return out.select(*keys, *([F.col("_m_rows").alias("n")] if with_n else []), m("min"), "p25", "median", m("mean"),
                      "p75", m("max"), (F.col("_m_rows") - F.col("_m_n")).alias("nulls"))


def freq(df: DataFrame, a: str, b: str | None = None) -> DataFrame:
    """Counts of one column, or of pairs in long form."""
    return df.groupBy(*([a] if b is None else [a, b])).agg(_rows().alias("n"))


def freq_wide(df: DataFrame, a: str, b: str, levels: list) -> DataFrame:
    """Two-way table with the given levels of ``b`` as columns ``n_<level>``."""
    return df.groupBy(a).agg(*[F.count_if(F.col(b) == F.lit(v)).alias(f"n_{v}") for v in levels])


def proportions(df: DataFrame, by: list[str], within: list[str] | None = None) -> DataFrame:
    """Share of each key combination, overall or within the ``within`` keys. Windows run on
    the table of counts (one row per combination)."""
    counts = df.groupBy(*by).agg(_rows().alias("n"))
    if within:
        return attach_stats(counts, list(within), _t=F.sum("n")).withColumn(
            "prop", F.col("n") / F.col("_t")).drop("_t")
    return counts.withColumn("prop", F.col("n") / counts.agg(F.sum("n")).scalar())


def null_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """NULLs per column (long) and whether there are any."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "column", "nulls").withColumn("any_null", F.col("nulls") > 0)


def row_count(df: DataFrame, where: Column | None = None) -> DataFrame:
    return df.agg((_rows() if where is None else F.count_if(where)).alias("n"))


def distinct_summary(df: DataFrame, key_cols: list[str], cols: list[str], **kw) -> DataFrame:
    """Summary over distinct key/attribute combinations (one row per entity)."""
    return summary_stats(df.select(*key_cols, *cols).distinct(), cols, **kw)


def value_counts(df: DataFrame, col: str, lo: float | None = None, hi: float | None = None,
                 closed: tuple[bool, bool] = (True, True)) -> DataFrame:
    """Rows per distinct value inside a range."""
    c, parts = F.col(col), [F.col(col).isNotNull()]
    if lo is not None:
        parts.append(c >= lo if closed[0] else c > lo)
    if hi is not None:
        parts.append(c <= hi if closed[1] else c < hi)
    return df.filter(reduce(lambda a, b: a & b, parts)).groupBy(col).agg(_rows().alias("n"))


def histogram(df: DataFrame, col: str, binwidth: float, density: bool = False,
              by: list[str] = ()) -> DataFrame:
    """Bins ``(c-w/2, c+w/2]`` centred on multiples of the width; counts or density."""
    by = list(by)
    centre = F.ceil(F.col(col) / float(binwidth) - 0.5) * float(binwidth)
    bins = (df.filter(F.col(col).isNotNull()).groupBy(*by, centre.alias("bin")).agg(_rows().alias("n")))
    if not density:
        return bins
    if by:
        totals = attach_stats(bins, by, _t=F.sum("n"))
    else:
        totals = bins.withColumn("_t", bins.agg(F.sum("n")).scalar())
    return totals.withColumn("density", F.col("n") / (F.col("_t") * float(binwidth))).drop("_t")


def box_stats(df: DataFrame, bucket: str, value: str) -> DataFrame:
    """Quartiles, 1.5-IQR whiskers (most extreme values inside the fences) and number of
    outliers per bucket. The fences, one row a bucket, meet the rows by their measured size."""
    q = exact_quantiles(df, [bucket], value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    rows = df.select(bucket, v.alias("_v")).filter(F.col("_v").isNotNull())
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col("_v") >= F.col("q1") - 1.5 * iqr) & (F.col("_v") <= F.col("q3") + 1.5 * iqr)
    return join_null_safe(rows, q, [bucket]).groupBy(bucket, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("_v"))).alias("lower"), F.max(F.when(inside, F.col("_v"))).alias("upper"),
        F.count(F.lit(1)).alias("n"), F.count_if(~inside).alias("outliers"))


def trend(df: DataFrame, x: str | Column, y: str | Column, by: list[str] = ()) -> DataFrame:
    """Straight-line fit per group. As in the SQL, the slope of rows that share one ``x`` is NaN and
    the intercept NULL; where no row has both values the slope is NULL too."""
    cx = (F.col(x) if isinstance(x, str) else x).cast("double")
    cy = (F.col(y) if isinstance(y, str) else y).cast("double")
    return df.groupBy(*by).agg(
        F.coalesce(F.regr_slope(cy, cx), F.when(F.regr_count(cy, cx) > 0, F.lit(float("nan")))).alias("slope"),
        F.regr_intercept(cy, cx).alias("intercept"), F.regr_r2(cy, cx).alias("r2"), F.regr_count(cy, cx).alias("n"))


def leave_one_out_sum(df: DataFrame, cols: list[str], market: list[str] | None = None) -> DataFrame:
    """Sum over the other rows of the market (``oth_<col>``)."""
    if market:
        out = attach_stats(df, list(market), **{f"_t_{c}": F.sum(c) for c in cols})
        return out.withColumns({f"oth_{c}": F.col(f"_t_{c}") - F.col(c) for c in cols}) \
                  .drop(*[f"_t_{c}" for c in cols])
    totals = df.agg(F.struct(*[F.sum(c).alias(c) for c in cols])).scalar()
    return (df.withColumn("_t", totals)
            .withColumns({f"oth_{c}": F.col(f"_t.{c}") - F.col(c) for c in cols}).drop("_t"))


def choice_conflicts(df: DataFrame, id: str, chosen: str, utility: str) -> DataFrame:
    """Choice sets whose best alternative beats the chosen row. A row of the other side
    counts as zero, on both sides."""
    side = lambda flag: F.max(F.col(flag) * F.col(utility))
    return (df.withColumn("_alt", 1 - F.col(chosen)).groupBy(id)
            .agg(side(chosen).alias("chosen_u"), side("_alt").alias("alt_u"))
            .filter(F.col("chosen_u") < F.col("alt_u")))


def slot_traffic(df: DataFrame, slot: str = "require_tmref", num: str = "ride", den: str = "time") -> DataFrame:
    """Median ride ratio of the slot on every row. ``slot`` may be any column, so the measured
    size of the medians decides how they meet the rows."""
    ratio = df.withColumn("_r", F.try_divide(F.col(num).cast("double"), F.col(den).cast("double")))
    med = exact_quantiles(ratio, [slot], "_r", {"traffic": 0.5})
    return join_null_safe(df, med, [slot])


def ratio_of_sums(df: DataFrame, num: str, den: str, out: str = "ratio") -> DataFrame:
    return df.agg(F.try_divide(F.sum(num).cast("double"), F.sum(den).cast("double")).alias(out))
