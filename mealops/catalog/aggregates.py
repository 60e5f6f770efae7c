"""Aggregations (A*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as num
from ..functions.timing import minutes_between, slack_at
from ..operators import aggregates as agg
from ..operators.joins import left_lookup
from ..operators.windows import (cumulative_shift_orders, experience, lag_orders, rider_month_running,
                                 shift_rollup, shifts)
from ..plans.feature_build import add_work_ratio
from ..sources.fixtures import meal_orders, restaurants, station_weather
from .base import dist_of, moving, query, sql, timed

c = F.col

_USER = """up AS (SELECT user_id, count(*) AS u_n_tt, avg(rider_income) AS u_rinc_avg,
  avg(date_diff('second', require_tm, finish_tm)/60e0) AS u_delay_avg,
  avg(hour(require_tm))>10 AND avg(hour(require_tm))<14 AS u_lunch_avg,
  avg(date_diff('second', place_tm, require_tm)/60e0) AS u_prereq_avg, avg(price) AS u_price_avg,
  stddev_samp(price) AS u_price_sd, date_diff('second', min(finish_tm), max(finish_tm))/86400e0 AS u_span
  FROM meal_orders GROUP BY 1)"""


@query("a01_user_profile", sql("SELECT * FROM up", "meal_orders", _USER,
                               rounds="u_rinc_avg u_delay_avg u_prereq_avg u_price_avg u_price_sd u_span"))
def _(spark, d):
    return agg.user_profile(meal_orders(spark, d))


@query("a02_user_profile_cluster", sql("""SELECT * FROM (SELECT user_id, count(*) AS u_n_tt, avg(rider_income) AS u_rinc_avg,
  stddev_samp(rider_income) AS u_rinc_sd, avg(r) AS u_req_avg, stddev_samp(r) AS u_req_sd, avg(price) AS u_price_avg,
  stddev_samp(price) AS u_price_sd, date_diff('second', min(place_tm), max(finish_tm)) AS u_span
  FROM (SELECT *, date_diff('second', TIMESTAMP '1970-01-01', require_tm) AS r FROM meal_orders) GROUP BY 1)
  WHERE u_n_tt<=60 AND u_rinc_avg<560 AND u_price_avg<10000""", "meal_orders",
                                       rounds="u_rinc_avg u_rinc_sd u_req_avg u_req_sd u_price_avg u_price_sd", digits=4), digits=4)
def _(spark, d):
    return agg.user_profile_cluster(meal_orders(spark, d), max_n=60, max_income=560)


@query("a03_market_table", sql("""SELECT sup_id, name, n, taste, envir, service, avgexp_lo, avgexp_up, tag1, actexp, avgfee,
  avgdist, (avgexp_lo+avgexp_up)/2 AS avgexp, tag1='中式快餐简餐' AS tag_cnfast, tag1 IN ('日本菜','寿司') AS tag_jp,
  tag1='甜点饮品' AS tag_snack, size, n/size::DOUBLE AS shares FROM (
  SELECT sup_id, name, count(*) AS n, min(taste) AS taste, min(envir) AS envir, min(service) AS service,
  min(avgexp_lo) AS avgexp_lo, min(avgexp_up) AS avgexp_up, min(tag1) AS tag1, avg(price+rider_income)/100 AS actexp,
  avg(rider_income)/100 AS avgfee, avg(dist) AS avgdist, max(size) AS size FROM (
  SELECT o.*, s.*, dist, count(*) OVER () AS size FROM meal_orders o JOIN sup s ON o.sup_id=s.sup_id
  LEFT JOIN dist d ON d.id=o.id WHERE CAST(require_tm AS DATE)=DATE '2024-01-03') GROUP BY 1,2)
  WHERE n>=5""", "dist sup", rounds="taste envir service avgexp_lo avgexp_up actexp avgfee avgdist avgexp shares"))
def _(spark, d):
    o = left_lookup(left_lookup(meal_orders(spark, d), restaurants(spark, d), "sup_id"),
                    dist_of(spark, d).select("id", "dist"), "id")
    return agg.market_table(o, day="2024-01-03")


@query("a04_rider_month", sql("""SELECT * FROM (SELECT rider_id, month(finish_tm) AS month, CAST(sum(rider_income) AS BIGINT) AS inc,
  CAST(sum(rider_income+300) AS BIGINT) AS inc_subs, count(*) AS num, avg(speed) AS speed_avg,
  stddev_samp(speed) AS speed_sd, avg(bdunexp) AS bdunexp_avg, stddev_samp(bdunexp) AS bdunexp_sd
  FROM moving GROUP BY 1,2) WHERE inc_subs/100e0 > 3000""", "moving", rounds="speed_avg speed_sd bdunexp_avg bdunexp_sd"))
def _(spark, d):
    return agg.rider_month(moving(spark, d), min_income=3000)


@query("a05_slot_summary", sql("""SELECT require_date, require_tmref, tmref_cat, avg(prereq) AS avg_prereq, count(*) AS count,
  count(*) FILTER (delay<0) AS count_ontime, tmref_cat='lunch' AS lunch FROM timed GROUP BY 1,2,3""", "timed",
                               rounds="avg_prereq"))
def _(spark, d):
    return agg.slot_summary(timed(spark, d))


@query("a06_orders_per_slot", sql("""SELECT CAST(read_tm AS DATE) AS read_date, require_tmref, count(*) AS order_n
  FROM timed GROUP BY 1,2""", "timed"))
def _(spark, d):
    return agg.orders_per_slot(timed(spark, d))


@query("a07_shift_rollup", sql("SELECT * FROM shift_table", "shifted"))
def _(spark, d):
    return shift_rollup(shifts(meal_orders(spark, d)))


@query("a08_group_mean_median", sql("""SELECT left_20, avg(delay) AS delay_mean, median(delay) AS delay_median,
  avg(price) AS price_mean, median(price)::DOUBLE AS price_median, avg(ride) AS ride_mean, median(ride) AS ride_median
  FROM (SELECT *, CASE WHEN left1>=8 THEN 1 ELSE 0 END AS left_20 FROM timed) GROUP BY 1""", "timed",
                                    rounds="delay_mean delay_median price_mean price_median ride_mean ride_median"))
def _(spark, d):
    o = timed(spark, d).withColumn("left_20", num.threshold_flag("left1", 8))
    return agg.group_mean_median(o, ["left_20"], ["delay", "price", "ride"])


@query("a09_system_pressure", sql("""SELECT t.require_tmref, t.require_date, avg(n.order_n/nullif(r.avai_n30,0)::DOUBLE) AS sys_pressure
  FROM timed t LEFT JOIN roster r ON r.date=t.require_date AND hour(r.tm)+minute(r.tm)/60e0=t.require_tmref
  LEFT JOIN (SELECT CAST(read_tm AS DATE) AS read_date, require_tmref, count(*) AS order_n FROM timed GROUP BY 1,2) n
  ON t.require_date=n.read_date AND t.require_tmref=n.require_tmref GROUP BY 1,2""", "timed roster", rounds="sys_pressure"))
def _(spark, d):
    return agg.system_pressure(add_work_ratio(timed(spark, d)))


_PLACE = "(SELECT *, hour(place_tm)*3600+minute(place_tm)*60+second(place_tm) AS s FROM timed)"


@query("a10_day_competition", sql(f"""SELECT require_date, tmref_cat, count(*) AS day_orders, avg(prereq) AS prereq_avg,
  median(prereq) AS prereq_med, avg(s) AS place_avg, median(s)::DOUBLE AS place_med FROM {_PLACE} GROUP BY 1,2""", "timed",
                                  rounds="prereq_avg prereq_med place_avg place_med"))
def _(spark, d):
    return agg.day_competition(timed(spark, d))


@query("a10_day_competition_by_slot", sql(f"""SELECT *, CAST(sum(n) OVER (PARTITION BY require_date, tmref_cat) AS BIGINT) AS day_orders
  FROM (SELECT require_date, tmref_cat, require_tmref, count(*) AS n, avg(prereq) AS prereq_avg,
  median(prereq) AS prereq_med, avg(s) AS place_avg, median(s)::DOUBLE AS place_med FROM {_PLACE} GROUP BY 1,2,3)""", "timed",
                                          rounds="prereq_avg prereq_med place_avg place_med").replace("FROM (SELECT *, CAST", "FROM (SELECT * EXCLUDE (n), CAST"))
def _(spark, d):
    return agg.day_competition(timed(spark, d), by_slot=True)


@query("a11_experience_range", sql("""SELECT rider_id, max(r_exp_n) AS exp_max, min(r_exp_n) AS exp_min,
  max(r_inshift_n) AS orders_max, min(r_inshift_n) AS orders_min FROM (SELECT *, CAST(sum(r_inshift_n) OVER
  (PARTITION BY rider_id ORDER BY read_date, r_shift ROWS UNBOUNDED PRECEDING) AS BIGINT) AS r_exp_n FROM shift_table)
  GROUP BY 1""", "shifted"))
def _(spark, d):
    t = cumulative_shift_orders(shift_rollup(shifts(meal_orders(spark, d))))
    return agg.experience_range(t, "rider_id", exp="r_exp_n", orders="r_inshift_n")


@query("a11_store_experience_range", sql("""SELECT sup_id, count(*) AS exp_max, 1::BIGINT AS exp_min FROM meal_orders GROUP BY 1""",
                                         "meal_orders"))
def _(spark, d):
    return agg.experience_range(experience(meal_orders(spark, d), "sup_id", "read_tm", out="sup_exp"), "sup_id", exp="sup_exp")


def _stat_sql(cols: list[str], src: str, body: str) -> str:
    return " UNION ALL ".join(f"SELECT '{x}' AS \"column\", {body.replace('@', x)} FROM {src}" for x in cols)


_SUM = """count(@) AS n, avg(@) AS mean, stddev_samp(@) AS sd, quantile_cont(@::DOUBLE, 0.25) AS p25,
  quantile_cont(@::DOUBLE, 0.5) AS median, quantile_cont(@::DOUBLE, 0.75) AS p75, max(@)::DOUBLE AS max"""


@query("a12_summary_stats", sql(_stat_sql(["prereq", "prepare", "ride", "delay", "rider_income", "price"], "timed", _SUM),
                                "timed", rounds="mean sd p25 median p75 max", digits=5), digits=5)
def _(spark, d):
    return agg.summary_stats(timed(spark, d), ["prereq", "prepare", "ride", "delay", "rider_income", "price"])


_SIX = """min(@)::DOUBLE AS min, quantile_cont(@::DOUBLE, 0.25) AS p25, quantile_cont(@::DOUBLE, 0.5) AS median, avg(@) AS mean,
  quantile_cont(@::DOUBLE, 0.75) AS p75, max(@)::DOUBLE AS max, count(*)-count(@) AS nulls"""


@query("a13_six_number", sql(_stat_sql(["dist", "time", "delay"], "s", _SIX), "timed dist",
                             """s AS (SELECT t.delay, d.dist, d.time FROM timed t LEFT JOIN dist d USING (id) WHERE delay<30)""",
                             rounds="min p25 median mean p75 max"))
def _(spark, d):
    o = left_lookup(timed(spark, d), dist_of(spark, d).select("id", "dist", "time"), "id")
    return agg.six_number(o, ["dist", "time", "delay"], where=c("delay") < 30)


@query("a13_six_number_speed", sql(_stat_sql(["speed", "bdunexp"], "moving", _SIX), "moving",
                                   rounds="min p25 median mean p75 max"))
def _(spark, d):
    return agg.six_number(moving(spark, d), ["speed", "bdunexp"])


@query("a14_freq", sql("SELECT require_tmref, count(*) AS n FROM timed GROUP BY 1", "timed"))
def _(spark, d):
    return agg.freq(timed(spark, d), "require_tmref")


@query("a14_freq_two_way", sql("""SELECT tmref_cat, hour(place_tm) AS h, count(*) AS n FROM timed GROUP BY 1,2""", "timed"))
def _(spark, d):
    return agg.freq(timed(spark, d).withColumn("h", F.hour("place_tm")), "tmref_cat", "h")


@query("a14_freq_wide", sql("""SELECT sup_id, count(*) FILTER (tmref_cat='lunch') AS n_lunch,
  count(*) FILTER (tmref_cat='dinner') AS n_dinner, count(*) FILTER (tmref_cat='other') AS n_other
  FROM timed GROUP BY 1""", "timed"))
def _(spark, d):
    return agg.freq_wide(timed(spark, d), "sup_id", "tmref_cat", ["lunch", "dinner", "other"])


@query("a14_weather_codes", sql("""SELECT station, code, count(*) AS n FROM (SELECT station, mw AS code FROM weather
  UNION ALL SELECT station, mw_1 FROM weather WHERE mw_1 IS NOT NULL) GROUP BY 1,2""", "weather"))
def _(spark, d):
    w = station_weather(spark, d).select("station", "mw", "mw_1")
    codes = w.unpivot(["station"], ["mw", "mw_1"], "slot", "code").filter(c("code").isNotNull())
    return agg.freq(codes, "station", "code")


@query("a15_proportions", sql("""SELECT tmref_cat, count(*) AS n, count(*)/(SELECT count(*) FROM timed)::DOUBLE AS prop
  FROM timed GROUP BY 1""", "timed", rounds="prop"))
def _(spark, d):
    return agg.proportions(timed(spark, d), ["tmref_cat"])


@query("a15_proportions_within", sql("""SELECT left_20, tmref_cat, n, n/(sum(n) OVER (PARTITION BY left_20))::DOUBLE AS prop FROM (
  SELECT CASE WHEN left1>=8 THEN 1 ELSE 0 END AS left_20, tmref_cat, count(*) AS n FROM timed GROUP BY 1,2)""", "timed",
                                     rounds="prop"))
def _(spark, d):
    o = timed(spark, d).withColumn("left_20", num.threshold_flag("left1", 8))
    return agg.proportions(o, ["left_20", "tmref_cat"], within=["left_20"])


@query("a16_null_counts", sql("""SELECT 'dist' AS "column", count(*)-count(dist) AS nulls, count(*)>count(dist) AS any_null FROM s
  UNION ALL SELECT 'price', count(*)-count(price), count(*)>count(price) FROM s""", "dist",
                              "s AS (SELECT price, dist FROM meal_orders LEFT JOIN dist USING (id))"))
def _(spark, d):
    o = left_lookup(meal_orders(spark, d), dist_of(spark, d).select("id", "dist"), "id")
    return agg.null_counts(o, ["dist", "price"])


@query("a17_distinct_summary", sql(_stat_sql(["u_n_tt", "u_price_avg", "u_span"], "up", _SUM), "meal_orders", _USER,
                                   rounds="mean sd p25 median p75 max", digits=5), digits=5)
def _(spark, d):
    o = meal_orders(spark, d)
    return agg.distinct_summary(left_lookup(o, agg.user_profile(o), "user_id"), ["user_id"],
                                ["u_n_tt", "u_price_avg", "u_span"])


@query("a17_distinct_count", sql("SELECT count(DISTINCT require_date) AS days, count(DISTINCT user_id) AS users FROM timed", "timed"))
def _(spark, d):
    return timed(spark, d).agg(F.count_distinct("require_date").alias("days"), F.count_distinct("user_id").alias("users"))


@query("a18_value_counts", sql("SELECT prereq, count(*) AS n FROM timed WHERE prereq>=30 AND prereq<=70 GROUP BY 1", "timed",
                               rounds="prereq"))
def _(spark, d):
    return agg.value_counts(timed(spark, d), "prereq", 30, 70)


@query("a19_histogram", sql("""SELECT bin, count(*) AS n, count(*)/((SELECT count(*) FROM timed)*5e0) AS density FROM
  (SELECT ceil(delay/5-0.5)*5e0 AS bin FROM timed) GROUP BY 1""", "timed", rounds="bin density"))
def _(spark, d):
    return agg.histogram(timed(spark, d), "delay", 5, density=True)


@query("a19_histogram_by", sql("""SELECT month, bin, count(*) AS n FROM (SELECT month(finish_tm) AS month,
  ceil(price/500e0-0.5)*500e0 AS bin FROM timed) GROUP BY 1,2""", "timed", rounds="bin"))
def _(spark, d):
    return agg.histogram(timed(spark, d).withColumn("month", F.month("finish_tm")), "price", 500, by=["month"])


def _box_sql(bucket: str, value: str, src: str) -> tuple[str, str]:
    ctes = f"""b AS (SELECT {bucket} AS bucket, ({value})::DOUBLE AS v FROM {src}),
  q AS (SELECT bucket, quantile_cont(v,0.25) AS q1, quantile_cont(v,0.5) AS median, quantile_cont(v,0.75) AS q3 FROM b GROUP BY 1)"""
    return ctes, """SELECT bucket, q1, median, q3, min(v) FILTER (ok) AS lower, max(v) FILTER (ok) AS upper, count(*) AS n,
  count(*) FILTER (NOT ok) AS outliers FROM (SELECT b.bucket, v, q1, median, q3,
  v>=q1-1.5e0*(q3-q1) AND v<=q3+1.5e0*(q3-q1) AS ok FROM b JOIN q ON b.bucket IS NOT DISTINCT FROM q.bucket) GROUP BY 1,2,3,4"""


for _name, _bucket, _value, _src, _make in (
    ("a20_box_leave_by_lead", "CAST(floor(prereq/5)*5 AS BIGINT)", "date_diff('second', leave_tm, require_tm)/60e0", "timed",
     lambda o: (num.floor_bucket("prereq", 5).cast("long"), slack_at("require_tm", "leave_tm"))),
    ("a20_box_price_by_minute", "minute(require_tm)", "price", "timed",
     lambda o: (F.minute("require_tm"), c("price"))),
    ("a20_box_lead_by_celsius", "round_even((50+(id*7)%40-32)*5/9e0, 0)", "prereq", "timed",
     lambda o: (num.f_to_c(50 + (c("id") * 7) % 40), c("prereq"))),
):
    _ctes, _body = _box_sql(_bucket, _value, _src)

    @query(_name, sql(_body, "timed", _ctes, rounds="q1 median q3 lower upper"))
    def _(spark, d, make=_make):
        bucket, value = make(None)
        o = timed(spark, d).select(bucket.alias("bucket"), value.cast("double").alias("value"))
        return agg.box_stats(o, "bucket", "value")


_REGR = "regr_slope({y},{x}) AS slope, regr_intercept({y},{x}) AS intercept, regr_r2({y},{x}) AS r2, regr_count({y},{x})::BIGINT AS n"


@query("a21_trend", sql(f"""SELECT {_REGR.format(y='prereq-prereq_lag1', x='delay_lag1')} FROM lagged WHERE delay_lag1 IS NOT NULL""",
                        "lagged", rounds="slope intercept r2"))
def _(spark, d):
    lagged = lag_orders(timed(spark, d).filter(c("tmref_cat") == "lunch"), ["user_id", "sup_id"], ["delay", "prereq"])
    return agg.trend(lagged, "delay_lag1", c("prereq") - c("prereq_lag1"))


@query("a21_trend_by_occasion", sql(f"""SELECT occ, {_REGR.format(y='prereq-prereq_lag1', x='delay_lag1')} FROM lagged
  WHERE delay_lag1 IS NOT NULL AND occ<4 GROUP BY 1""", "lagged", rounds="slope intercept r2"))
def _(spark, d):
    lagged = lag_orders(timed(spark, d).filter(c("tmref_cat") == "lunch"), ["user_id", "sup_id"], ["delay", "prereq"])
    return agg.trend(lagged.filter(c("occ") < 4), "delay_lag1", c("prereq") - c("prereq_lag1"), by=["occ"])


@query("a21_trend_day_competition", sql(f"""SELECT tmref_cat, {_REGR.format(y='prereq_avg', x='day_orders')} FROM (
  SELECT require_date, tmref_cat, count(*) AS day_orders, avg(prereq) AS prereq_avg FROM timed GROUP BY 1,2)
  WHERE tmref_cat<>'other' GROUP BY 1""", "timed", rounds="slope intercept r2"))
def _(spark, d):
    days = agg.day_competition(timed(spark, d)).filter(c("tmref_cat") != "other")
    return agg.trend(days, "day_orders", "prereq_avg", by=["tmref_cat"])


@query("a22_leave_one_out", sql("""SELECT sup_id, tag1, sum(envir) OVER ()-envir AS oth_envir, sum(n) OVER ()-n AS oth_n,
  sum(service) OVER (PARTITION BY tag1)-service AS oth_service FROM s""", "sup",
                                "s AS (SELECT * FROM sup JOIN (SELECT sup_id, count(*)::DOUBLE AS n FROM meal_orders GROUP BY 1) USING (sup_id))",
                                rounds="oth_envir oth_n oth_service"))
def _(spark, d):
    n = meal_orders(spark, d).groupBy("sup_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    s = restaurants(spark, d).join(n, "sup_id")
    s = agg.leave_one_out_sum(s, ["envir", "n"])
    return agg.leave_one_out_sum(s, ["service"], market=["tag1"]).select("sup_id", "tag1", "oth_envir", "oth_n", "oth_service")


@query("a23_choice_conflicts", sql("""SELECT * FROM (SELECT id, max(chosen*u) AS chosen_u, max((1-chosen)*u) AS alt_u FROM s GROUP BY 1)
  WHERE chosen_u<alt_u""", "prev_store", """s AS (SELECT id, 1 AS chosen, (sup_id-20)/10e0 AS u FROM prev_store
  UNION ALL SELECT id, 0, (alt_id_store-20)/10e0 FROM prev_store WHERE alt_id IS NOT NULL)""", rounds="chosen_u alt_u"))
def _(spark, d):
    from ..operators.joins import previous_distinct
    o = previous_distinct(meal_orders(spark, d))
    a = o.select("id", F.lit(1).alias("chosen"), ((c("sup_id") - 20) / 10.0).alias("u"))
    b = o.filter(c("alt_id").isNotNull()).select("id", F.lit(0).alias("chosen"), ((c("alt_id_store") - 20) / 10.0).alias("u"))
    return agg.choice_conflicts(a.unionByName(b), "id", "chosen", "u")


@query("a24_slot_traffic", sql("""SELECT t.id, m.traffic FROM timed t LEFT JOIN (SELECT require_tmref,
  quantile_cont(ride/(d.time/60e0), 0.5) AS traffic FROM timed JOIN dist d USING (id) GROUP BY 1) m
  USING (require_tmref)""", "timed dist", rounds="traffic"))
def _(spark, d):
    o = left_lookup(timed(spark, d), dist_of(spark, d).select("id", (c("time") / 60.0).alias("time")), "id")
    return agg.slot_traffic(o).select("id", "traffic")


@query("a25_ratio_of_sums", sql("SELECT sum(rider_income)/sum(price)::DOUBLE AS ratio FROM meal_orders", "meal_orders", rounds="ratio"))
def _(spark, d):
    return agg.ratio_of_sums(meal_orders(spark, d), "rider_income", "price")


@query("a26_row_count", sql("SELECT count(*) FILTER (left1>=0 AND left1<60 AND delay<0) AS n FROM timed", "timed"))
def _(spark, d):
    return agg.row_count(timed(spark, d), (c("left1") >= 0) & (c("left1") < 60) & (c("delay") < 0))
