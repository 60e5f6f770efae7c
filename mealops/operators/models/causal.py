"""Weighting, matching, balance and threshold comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..aggregates import freq, six_number
from ..ordered import ordered
from ..quantiles import _bin
from .matching import all_rows, att, att_error, match, matched_rows
from .regression import fe_ols, ols


# --- weighting ---------------------------------------------------------------------------

def ipw_weights(df: DataFrame, treat: str, p: str, out: str = "ipw_weights") -> DataFrame:
    """Inverse probability weights; NULL where the probability is exactly 0 or 1 on the
    wrong side."""
    w = F.when(F.col(treat) == 1, F.try_divide(F.lit(1.0), F.col(p))).otherwise(
        F.try_divide(F.lit(1.0), 1 - F.col(p)))
    return df.withColumn(out, w)


def ipw_ate(df: DataFrame, y: str, treat: str, p: str, xs: list[str] = ()) -> DataFrame:
    """Weighted regression of the outcome on treatment (and covariates); the ``treat`` term
    is the average treatment effect."""
    return ols(ipw_weights(df, treat, p, "_ipw"), y, [treat, *xs], weight="_ipw")


# --- matching ----------------------------------------------------------------------------

def match_att(df: DataFrame, y: str, treat: str, xs: list[str], weights: dict[str, float] | None = None,
              blocks: list[str] = (), **kw) -> DataFrame:
    """Average effect on the treated from nearest-neighbour matching with replacement;
    tied neighbours are averaged. One row: ``att, matched, unmatched, mean_dist``."""
    return att(match(df, y, treat, xs, weights, blocks, **kw))


def match_error(df: DataFrame, y: str, treat: str, xs: list[str], weights: dict[str, float] | None = None,
                blocks: list[str] = (), **kw) -> DataFrame:
    """The effect of :func:`match_att` with its standard error and t value."""
    return att_error(match(df, y, treat, xs, weights, blocks, **kw), blocks)


def balance_matched(df: DataFrame, y: str, treat: str, xs: list[str], weights: dict[str, float] | None = None,
                    blocks: list[str] = (), **kw) -> DataFrame:
    """Balance of the covariates ``before`` and ``after`` matching (column ``sample``); after, a
    control row weighs as often as it was used. Rows with a NULL covariate are in neither."""
    m = match(df, y, treat, xs, weights, blocks, **kw)
    both = [balance(rows, "_t", xs, "_weight").withColumn("sample", F.lit(name))
            for name, rows in (("before", all_rows(m, xs)), ("after", matched_rows(m, xs)))]
    return both[0].unionByName(both[1])


def balance(df: DataFrame, treat: str, xs: list[str], weight: str | None = None) -> DataFrame:
    """Per covariate: treated and control mean, difference, difference over the treated
    deviation, variance ratio and the Kolmogorov-Smirnov distance. ``weight`` gives the
    matched sample (for example how often a control was used)."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.col(treat).cast("int").alias("_t"), w.alias("_w"),
                     *[F.col(x).cast("double").alias(x) for x in xs])
    long = rows.unpivot(["_t", "_w"], list(xs), "column", "_v").filter(
        F.col("_v").isNotNull() & (F.col("_w") > 0))
    # one row per (column, value): everything below works on this collapsed table
    side = lambda t: F.sum(F.when(F.col("_t") == t, F.col("_w")).otherwise(0.0))
    values = long.groupBy("column", "_v").agg(side(1).alias("_w1"), side(0).alias("_w0"))
    mean = lambda t: F.sum(F.col("_v") * F.col(f"_w{t}")) / F.sum(f"_w{t}")
    means = values.groupBy("column").agg(mean(1).alias("mean_treated"), mean(0).alias("mean_control"),
                                         F.sum("_w1").alias("_s1"), F.sum("_w0").alias("_s0"))
    # one row per covariate
    joined = values.join(F.broadcast(means), "column")
    var = lambda t, m: F.sum(F.pow(F.col("_v") - F.col(m), 2) * F.col(f"_w{t}")) / (F.max(f"_s{t}") - 1)
    spread = joined.groupBy("column").agg(var(1, "mean_treated").alias("_v1"), var(0, "mean_control").alias("_v0"))
    run = ordered(joined, ["column"], ["_v"], slot=_bin(F.col("_v")),
                  running={"_c1": F.col("_w1"), "_c0": F.col("_w0")})
    ks = run.groupBy("column").agg(F.max(F.abs(F.col("_c1") / F.col("_s1") - F.col("_c0") / F.col("_s0"))).alias("ks"))
    diff = F.col("mean_treated") - F.col("mean_control")
    return (means.join(spread, "column").join(ks, "column").select(
        "column", "mean_treated", "mean_control", diff.alias("mean_diff"),
        F.try_divide(diff, F.sqrt("_v1")).alias("std_diff"),
        F.try_divide(F.col("_v1"), F.col("_v0")).alias("var_ratio"), "ks"))


# --- income threshold --------------------------------------------------------------------

def threshold_rows(df: DataFrame, windows: tuple[int, ...] = (3, 5, 7), cut: float = 3000, step: float = 100,
                   rider: str = "rider_id", running: str = "inc_atm", days: str = "remain_days") -> DataFrame:
    """Orders near the income threshold at month end, one copy per window w that they belong
    to: at most w days left, income within ±step*w of the cut, rider both near the cut in
    that window and over it at some time. ``over`` tells the side."""
    money = F.col(running) / 100
    wide = step * F.col("window")
    near = (df.filter((F.col(days) <= max(windows)) & (money >= cut - step * max(windows))
                      & (money < cut + step * max(windows)))
            .withColumn("window", F.explode(F.array(*[F.lit(w) for w in windows])))
            .filter((F.col(days) <= F.col("window")) & (money >= cut - wide) & (money < cut + wide)))
    passed = df.filter(money >= cut).select(rider).distinct()
    # riders near the cut in a window are exactly the riders of the rows kept above
    return near.join(passed, rider, "left_semi").withColumn("over", money >= cut)


def threshold_windows(df: DataFrame, value: str = "speed_wt", **kw) -> DataFrame:
    """Six-number summary of ``value`` and row count below and above the cut, per window."""
    return six_number(threshold_rows(df, **kw), value, by=["window", "over"], with_n=True).drop("column")


def threshold_meal_counts(df: DataFrame, **kw) -> DataFrame:
    """Lunch by dinner counts per window and side."""
    return threshold_rows(df, **kw).groupBy("window", "over", "lunch_hr", "dinner_hr").agg(
        F.count(F.lit(1)).alias("n"))


def threshold_fe(df: DataFrame, value: str = "speed_wt", rider: str = "rider_id", running: str = "inc_atm",
                 cut: float = 3000, **kw) -> DataFrame:
    """Rider fixed effects per window: value on passed, income (cents), its square, lunch."""
    rows = (threshold_rows(df, rider=rider, running=running, cut=cut, **kw)
            .withColumn("passed", (F.col(running) / 100 > cut).cast("int"))
            .withColumn(f"{running}2", F.pow(F.col(running).cast("double"), 2)))
    return fe_ols(rows, value, ["passed", running, f"{running}2", "lunch_hr"], rider, by=["window"])


def threshold_contrast(df: DataFrame, value: str, running: str = "inc_atm", month_flag: str = "excel_month",
                       cut: float = 3000) -> DataFrame:
    """Summary of a value by (month passes the cut) x (already past it), with counts."""
    rows = df.withColumn("past", F.col(running) / 100 >= cut)
    return six_number(rows, value, by=[month_flag, "past"], with_n=True).drop("column")


def threshold_table(df: DataFrame, running: str = "inc_atm", month_flag: str = "excel_month",
                    cut: float = 3000) -> DataFrame:
    return freq(df.withColumn("past", F.col(running) / 100 >= cut), month_flag, "past")
