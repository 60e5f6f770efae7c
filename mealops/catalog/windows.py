"""Window operators (W*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as win
from ..operators.aggregates import market_table
from ..plans.weather_slots import flagged_weather, weather_slots
from ..sources.fixtures import meal_orders, restaurants, station_weather
from .base import moving, query, sql, timed

c = F.col


@query("w01_experience", sql("""SELECT id, row_number() OVER (PARTITION BY user_id ORDER BY place_tm, id) AS user_exp,
  row_number() OVER (PARTITION BY rider_id ORDER BY read_tm, id) AS rider_exp,
  row_number() OVER (PARTITION BY sup_id ORDER BY read_tm, id) AS sup_exp FROM meal_orders""", "meal_orders"))
def _(spark, d):
    return win.experiences(meal_orders(spark, d), {
        "user_exp": ("user_id", "place_tm"), "rider_exp": ("rider_id", "read_tm"), "sup_exp": ("sup_id", "read_tm")})


@query("w02_shifts", sql("SELECT id, rider_id, read_date, r_new_shift, r_shift FROM shifted", "shifted"))
def _(spark, d):
    return win.shifts(meal_orders(spark, d)).select("id", "rider_id", "read_date", "r_new_shift", "r_shift")


@query("w03_cumulative_shift_orders", sql("""SELECT rider_id, read_date, r_shift, r_inshift_n,
  CAST(sum(r_inshift_n) OVER (PARTITION BY rider_id ORDER BY read_date, r_shift ROWS UNBOUNDED PRECEDING) AS BIGINT)
  AS r_exp_n FROM shift_table""", "shifted"))
def _(spark, d):
    return win.cumulative_shift_orders(win.shift_rollup(win.shifts(meal_orders(spark, d)))).drop("begin", "end")


@query("w04_on_hand", sql("SELECT rider_id, id, action, tm, onhand FROM ev2", "onhand"))
def _(spark, d):
    return win.on_hand(meal_orders(spark, d)).drop("delta")


@query("w05_avg_on_hand", sql("SELECT * FROM onhand", "onhand", rounds="onhandXdur onhand"))
def _(spark, d):
    return win.avg_on_hand(meal_orders(spark, d))


@query("w06_regimes", sql("SELECT station, tm, precipitating, shower, regime_pcp, regime_shw FROM weather_slots",
                          "weather weather_flagged"))
def _(spark, d):
    w = flagged_weather(station_weather(spark, d))
    w = win.regimes(w, "station", "tm", "precipitating", "regime_pcp")
    w = win.regimes(w, "station", "tm", "shower", "regime_shw")
    return w.select("station", "tm", "precipitating", "shower", "regime_pcp", "regime_shw")


@query("w07_episode_start", sql("""SELECT station, tm, pcp_begin, hour(pcp_begin)+minute(pcp_begin)/60e0 AS pcp_beginref,
  shw_begin, hour(shw_begin)+minute(shw_begin)/60e0 AS shw_beginref FROM weather_slots""", "weather weather_flagged",
                                rounds="pcp_beginref shw_beginref"))
def _(spark, d):
    return weather_slots(station_weather(spark, d)).select("station", "tm", "pcp_begin", "pcp_beginref",
                                                           "shw_begin", "shw_beginref")


@query("w08_lag_orders", sql("""SELECT id, delay_lag1, require_tm_lag1, place_tm_lag1, prereq_lag1, occ, tt_order
  FROM lagged WHERE delay_lag1 IS NOT NULL""", "lagged", rounds="delay_lag1 prereq_lag1"))
def _(spark, d):
    lunch = timed(spark, d).filter(c("tmref_cat") == "lunch")
    return win.lag_orders(lunch, ["user_id", "sup_id"], ["delay", "require_tm", "place_tm", "prereq"]).select(
        "id", "delay_lag1", "require_tm_lag1", "place_tm_lag1", "prereq_lag1", "occ", "tt_order")


@query("w09_prior_purchases", sql("""SELECT id, n-1 AS ss, CAST(n>1 AS INT) AS ss_b4 FROM (SELECT id,
  row_number() OVER (PARTITION BY user_id, sup_id ORDER BY finish_tm, id) AS n FROM meal_orders)""", "meal_orders"))
def _(spark, d):
    return win.prior_purchases(meal_orders(spark, d)).select("id", "ss", "ss_b4")


@query("w10_rider_month_running", sql("""SELECT id, month, count_atm, inc_atm, sinc_atm,
  max(inc_atm) OVER (PARTITION BY rider_id, y, month)/100e0 > 2500 AS excel_month,
  max(sinc_atm) OVER (PARTITION BY rider_id, y, month)/100e0 > 2500 AS sexcel_month FROM (SELECT id, rider_id,
  year(finish_tm) AS y, month(finish_tm) AS month, row_number() OVER w AS count_atm,
  CAST(sum(rider_income) OVER w AS BIGINT) AS inc_atm, CAST(sum(rider_income+300) OVER w AS BIGINT) AS sinc_atm
  FROM meal_orders WINDOW w AS (PARTITION BY rider_id, year(finish_tm), month(finish_tm) ORDER BY finish_tm, id
  ROWS UNBOUNDED PRECEDING))""", "meal_orders"))
def _(spark, d):
    return win.rider_month_running(meal_orders(spark, d), threshold=2500).select(
        "id", "month", "count_atm", "inc_atm", "sinc_atm", "excel_month", "sexcel_month")


_PCT = """p AS (SELECT id, hour(place_tm)*3600+minute(place_tm)*60+second(place_tm) AS place_sec FROM timed
  WHERE tmref_cat='lunch'),
  r AS (SELECT *, rank() OVER (ORDER BY place_sec) AS place_rank, count(*) OVER () AS n_total,
  (SELECT quantile_cont(place_sec, 0.5) FROM p)::DOUBLE AS place_med FROM p)"""


@query("w11_time_of_day_percentile", sql("""SELECT id, place_sec, place_rank, place_rank/n_total::DOUBLE AS place_pct,
  place_med FROM r""", "timed", _PCT, rounds="place_pct place_med"))
def _(spark, d):
    lunch = timed(spark, d).filter(c("tmref_cat") == "lunch")
    return win.time_of_day_percentile(lunch, "place_tm").select("id", "place_sec", "place_rank", "place_pct", "place_med")


@query("w11_percentile_by_day", sql("""SELECT id, rank() OVER (PARTITION BY require_date ORDER BY s) AS place_rank,
  rank() OVER (PARTITION BY require_date ORDER BY s)/(count(*) OVER (PARTITION BY require_date))::DOUBLE AS place_pct
  FROM (SELECT *, hour(place_tm)*3600+minute(place_tm)*60+second(place_tm) AS s FROM timed WHERE tmref_cat='lunch')""",
                                    "timed", rounds="place_pct"))
def _(spark, d):
    lunch = timed(spark, d).filter(c("tmref_cat") == "lunch")
    return win.time_of_day_percentile(lunch, "place_tm", ["require_date"]).select("id", "place_rank", "place_pct")


@query("w11_around_median", sql("""SELECT place_sec, n_at, n_total, place_rank, place_pct, place_med FROM (
  SELECT place_sec, count(*) AS n_at, max(n_total) AS n_total, min(place_rank) AS place_rank,
  min(place_rank)/max(n_total)::DOUBLE AS place_pct, max(place_med) AS place_med FROM r GROUP BY 1)
  WHERE abs(place_sec-place_med)<60""", "timed", _PCT, rounds="place_pct place_med"))
def _(spark, d):
    lunch = timed(spark, d).filter(c("tmref_cat") == "lunch")
    return win.around_median(win.seconds_distribution(lunch, "place_tm"), near_s=60)


@query("w12_choice_regret", sql("""SELECT id, chosen, avg(eu) OVER w AS eu_avg, avg(u) OVER w AS u_avg,
  eu = max(eu) OVER w AS best_ex_ante, sum(CASE WHEN eu=m THEN u ELSE 0e0 END) OVER w - u AS util_loss
  FROM (SELECT *, max(eu) OVER (PARTITION BY id) AS m FROM s) WINDOW w AS (PARTITION BY id)""", "prev_store",
                                """s AS (SELECT id, 1 AS chosen, sup_id/10e0 AS eu, sup_id/10e0+(id%7)/4e0 AS u FROM prev_store
  WHERE alt_id IS NOT NULL UNION ALL SELECT id, 0, alt_id_store/10e0, alt_id_store/10e0+(id%5)/4e0 FROM prev_store
  WHERE alt_id IS NOT NULL)""", rounds="eu_avg u_avg util_loss"))
def _(spark, d):
    from ..operators.joins import previous_distinct
    o = previous_distinct(meal_orders(spark, d)).filter(c("alt_id").isNotNull())
    side = lambda flag, store, m: o.select(
        "id", F.lit(flag).alias("chosen"), (c(store) / 10.0).alias("eu"),
        (c(store) / 10.0 + (c("id") % m) / 4.0).alias("u"))
    both = side(1, "sup_id", 7).unionByName(side(0, "alt_id_store", 5))
    return win.choice_regret(both, "id", "eu", "u").select(
        "id", "chosen", "eu_avg", "u_avg", "best_ex_ante", "util_loss")


@query("w13_market_share", sql("""SELECT sup_id, n, CAST(sum(n) OVER () AS BIGINT) AS size, n/(sum(n) OVER ())::DOUBLE AS shares
  FROM (SELECT sup_id, count(*) AS n FROM meal_orders GROUP BY 1)""", "meal_orders", rounds="shares"))
def _(spark, d):
    return win.market_share(meal_orders(spark, d).groupBy("sup_id").agg(F.count(F.lit(1)).alias("n")))


@query("w14_gap_to_next", sql("""SELECT id, next_gap FROM (SELECT id, date_diff('second', finish_tm,
  lead(finish_tm) OVER (PARTITION BY rider_id ORDER BY finish_tm, id)) AS next_gap FROM meal_orders)
  WHERE next_gap < 7200""", "meal_orders"))
def _(spark, d):
    return win.gap_to_next(meal_orders(spark, d)).select("id", "next_gap")


@query("w15_zscore", sql("""SELECT id, (price-avg(price) OVER ())/stddev_samp(price) OVER () AS price_z,
  (prereq-avg(prereq) OVER ())/stddev_samp(prereq) OVER () AS prereq_z FROM timed""", "timed", rounds="price_z prereq_z"))
def _(spark, d):
    return win.zscore(timed(spark, d), ["price", "prereq"]).select("id", "price_z", "prereq_z")


@query("w16_demean", sql("""SELECT id, delay-avg(delay) OVER w AS delay_dm, price-avg(price) OVER w AS price_dm FROM timed
  WINDOW w AS (PARTITION BY rider_id)""", "timed", rounds="delay_dm price_dm"))
def _(spark, d):
    return win.demean(timed(spark, d), "rider_id", ["delay", "price"]).select("id", "delay_dm", "price_dm")


@query("w17_with_count", sql("""SELECT id, count(*) OVER (PARTITION BY require_date, tmref_cat) AS day_orders FROM timed""",
                             "timed"))
def _(spark, d):
    return win.with_count(timed(spark, d), ["require_date", "tmref_cat"], "day_orders").select("id", "day_orders")


@query("e13_speed_columns", sql("SELECT id, dist, speed, speed*onhand AS speed_wt, bdunexp FROM moving", "moving",
                                rounds="speed speed_wt bdunexp"))
def _(spark, d):
    return moving(spark, d).select("id", "dist", "speed", "speed_wt", "bdunexp")
