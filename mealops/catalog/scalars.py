"""Scalar expressions (E*) and projections, filters, samples (P*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as num
from ..functions import timing as tm
from ..functions import weather as wx
from ..functions.text import coalesce_blank
from ..operators import filters as flt
from ..operators.aggregates import user_profile
from ..operators.joins import left_lookup
from ..operators.windows import experience, lag_orders
from ..plans.weather_slots import flagged_weather, weather_slots
from ..sources.fixtures import meal_orders, restaurants, station_weather, table
from .base import dist_of, query, sql, timed

c = F.col

# --- E: scalar expressions -----------------------------------------------------------------


@query("e01_durations_min", sql("SELECT id, delay, prereq, prepare, ride, allow_cook, left1 FROM timed",
                                "timed", rounds="delay prereq prepare ride allow_cook left1"))
def _(spark, d):
    return timed(spark, d).select("id", "delay", "prereq", "prepare", "ride", "allow_cook", "left1")


@query("e02_durations_sec", sql("""SELECT id, delay, prereq, prepare, ride, prereq-ride AS allow_cook,
  prereq-(prepare+ride) AS left1, cooka, prereq-(cooka+ride) AS left2,
  prereq-(dish_longer*60+ride) AS left3 FROM s""", "meal_orders", """s AS (SELECT *,
  date_diff('second', require_tm, finish_tm) AS delay, date_diff('second', place_tm, require_tm) AS prereq,
  date_diff('second', receive_tm, leave_tm) AS prepare, date_diff('second', leave_tm, finish_tm) AS ride,
  CAST((3+k%7)*60 AS BIGINT) AS cooka FROM meal_orders)"""))
def _(spark, d):
    o = meal_orders(spark, d).withColumn("cook_tm", c("receive_tm"))
    o = o.withColumn("cookable_tm", tm.plus_minutes("receive_tm", 3 + c("k") % 7))
    return tm.durations_sec(o).select("id", "delay", "prereq", "prepare", "ride", "allow_cook",
                                      "left1", "cooka", "left2", "left3")


@query("e03_map_slack", sql("""SELECT id, left_m, left2, left2 AS left2_m,
  CASE WHEN left_m>=20 THEN 1 WHEN left_m<20 THEN 0 END AS left_20,
  CASE WHEN left2>=20 THEN 1 WHEN left2<20 THEN 0 END AS left2_20 FROM s""", "timed dist",
                            """s AS (SELECT t.id, left1 AS left_m, prereq-(prepare+d.time/60e0) AS left2
  FROM timed t LEFT JOIN dist d USING (id))""", rounds="left_m left2 left2_m"))
def _(spark, d):
    routes = dist_of(spark, d).select("id", (c("time") / 60.0).alias("time"))
    return num.map_slack(left_lookup(timed(spark, d), routes, "id")).select(
        "id", "left_m", "left2", "left2_m", "left_20", "left2_20")


@query("e04_half_hour_slot", sql("""SELECT id, place_tmref, require_tmref,
  CASE WHEN require_tmref>=24 THEN 0e0 ELSE require_tmref END AS rolled_slot,
  CASE WHEN require_tmref>=24 THEN require_date + 1 ELSE require_date END AS rolled_date FROM timed""", "timed"))
def _(spark, d):
    date, slot = tm.rolled_slot("require_tm")
    return timed(spark, d).select("id", "place_tmref", "require_tmref",
                                  slot.alias("rolled_slot"), date.alias("rolled_date"))


@query("e05_decimal_hour", sql("SELECT id, hour(place_tm) + minute(place_tm)/60e0 AS place_hour FROM meal_orders",
                               "meal_orders", rounds="place_hour"))
def _(spark, d):
    return meal_orders(spark, d).select("id", tm.decimal_hour(F.hour("place_tm"), F.minute("place_tm")).alias("place_hour"))


@query("e06_daypart", sql("SELECT id, tmref_cat FROM timed", "timed"))
def _(spark, d):
    return timed(spark, d).select("id", "tmref_cat")


@query("e07_meal_hours", sql("""SELECT id, hour(require_tm) BETWEEN 10 AND 13 AS lunch_hr,
  hour(require_tm) BETWEEN 17 AND 19 AS dinner_hr FROM meal_orders""", "meal_orders"))
def _(spark, d):
    lunch, dinner = tm.meal_hours("require_tm")
    return meal_orders(spark, d).select("id", lunch.alias("lunch_hr"), dinner.alias("dinner_hr"))


_FLAG_SQL = ", ".join(
    f"coalesce(mw BETWEEN {lo} AND {hi}, false) OR coalesce(mw_1 BETWEEN {lo} AND {hi}, false) AS {name}"
    for name, (lo, hi) in wx.WEATHER_FLAGS.items())


@query("e08_weather_flags", sql(f"SELECT station, tm, {_FLAG_SQL} FROM weather", "weather"))
def _(spark, d):
    flags = wx.weather_flags("mw", "mw_1")
    return station_weather(spark, d).select("station", "tm", *[e.alias(n) for n, e in flags.items()])


@query("e09_sudden_rain", sql("""SELECT station, tm, coalesce(pcp_begin = tm, false) AS sudden_rain,
  coalesce(shw_begin = tm, false) AS sudden_shower FROM weather_slots""", "weather weather_flagged"))
def _(spark, d):
    return weather_slots(station_weather(spark, d)).select(
        "station", "tm", wx.sudden_rain("pcp_begin", "tm").alias("sudden_rain"),
        wx.sudden_rain("shw_begin", "tm").alias("sudden_shower"))


@query("e10_rain_elapsed", sql("""SELECT id, pcp_dur, rel_tm, CASE WHEN pcp_dur IS NOT NULL THEN
  least(pcp_dur, date_diff('second', rel_tm, place_tm)/3600e0) END AS pcp_rdur FROM s""",
                               "timed weather weather_flagged", """s AS (SELECT t.id, t.place_tm,
  t.place_tmref - (hour(pcp_begin)+minute(pcp_begin)/60e0)
    + 24*date_diff('day', CAST(pcp_begin AS DATE), t.place_date) AS pcp_dur,
  CAST(CASE WHEN hour(place_tm)>=6 THEN t.place_date ELSE t.place_date - 1 END AS TIMESTAMP) + to_hours(6) AS rel_tm
  FROM timed t LEFT JOIN weather_slots w ON w.station=0 AND CAST(w.tm AS DATE)=t.place_date
    AND hour(w.tm)+minute(w.tm)/60e0 = t.place_tmref)""", rounds="pcp_dur pcp_rdur"))
def _(spark, d):
    slots = (weather_slots(station_weather(spark, d)).filter(c("station") == 0)
             .select(F.to_date("tm").alias("date"), tm.half_hour_slot("tm").alias("tmref"), "pcp_begin"))
    o = left_lookup(timed(spark, d), slots, {"place_date": "date", "place_tmref": "tmref"})
    dur, rdur = tm.rain_elapsed("place_tm", "pcp_begin")
    return o.select("id", dur.alias("pcp_dur"), tm.business_reset("place_tm").alias("rel_tm"),
                    rdur.alias("pcp_rdur"))


@query("e11_dead_zone_censor", sql("""SELECT id, CASE WHEN abs(delay+10)<5 THEN 0e0 ELSE delay+10 END AS disap,
  CASE WHEN delay<0 THEN 0e0 ELSE delay END AS delay_cens FROM timed""", "timed", rounds="disap delay_cens"))
def _(spark, d):
    return timed(spark, d).select("id", num.dead_zone("delay").alias("disap"),
                                  num.censor("delay").alias("delay_cens"))


@query("e12_safe_ratios", sql("""SELECT t.id, CASE WHEN d.time>0 THEN ride/(d.time/60e0) END AS complic,
  CASE WHEN price>=paid THEN paid::DOUBLE/nullif(price,0) END AS paid_ratio,
  rider_income::DOUBLE/nullif(d.dist,0) AS cpm, rider_income::DOUBLE/nullif(price,0) AS dlv_perc
  FROM timed t LEFT JOIN dist d USING (id)""", "timed dist", rounds="complic paid_ratio cpm dlv_perc"))
def _(spark, d):
    o = left_lookup(timed(spark, d), dist_of(spark, d).select("id", "dist", (c("time") / 60.0).alias("time")), "id")
    return o.select("id", num.safe_ratio("ride", "time", c("time") > 0).alias("complic"),
                    num.safe_ratio("paid", "price", c("price") >= c("paid")).alias("paid_ratio"),
                    num.safe_ratio("rider_income", "dist").alias("cpm"),
                    num.safe_ratio("rider_income", "price").alias("dlv_perc"))


@query("e14_days_left", sql("""SELECT id, day(last_day(CAST(finish_tm AS DATE))) - day(finish_tm) AS remain_days
  FROM meal_orders""", "meal_orders"))
def _(spark, d):
    return meal_orders(spark, d).select("id", tm.days_left("finish_tm").alias("remain_days"))


@query("e15_seconds_of_day", sql("""SELECT id, hour(place_tm)*3600+minute(place_tm)*60+second(place_tm) AS place_sec,
  (hour(require_tm)*3600+minute(require_tm)*60+second(require_tm))
  - (hour(place_tm)*3600+minute(place_tm)*60+second(place_tm)) AS sec_gap FROM meal_orders""", "meal_orders"))
def _(spark, d):
    return meal_orders(spark, d).select("id", tm.seconds_of_day("place_tm").alias("place_sec"),
                                        (tm.seconds_of_day("require_tm") - tm.seconds_of_day("place_tm")).alias("sec_gap"))


@query("e16_buckets", sql("""SELECT o.id, CAST(floor(prereq/5)*5 AS BIGINT) AS prereq_05m,
  round_even((50+(o.id*7)%40-32)*5/9e0, 0) AS celsius, minute(require_tm)%5 = 0 AS whole_5min FROM timed o""", "timed"))
def _(spark, d):
    return timed(spark, d).select(
        "id", num.floor_bucket("prereq", 5).cast("long").alias("prereq_05m"),
        num.f_to_c(50 + (c("id") * 7) % 40).alias("celsius"),
        (F.minute("require_tm") % 5 == 0).alias("whole_5min"))


@query("e17_day_or_night", sql("""SELECT id, CASE WHEN hour(require_tm)>18 THEN 'night' || k%3
  ELSE 'day' || k%4 END AS weather FROM meal_orders""", "meal_orders"))
def _(spark, d):
    day = F.concat(F.lit("day"), (c("k") % 4).cast("string"))
    night = F.concat(F.lit("night"), (c("k") % 3).cast("string"))
    return meal_orders(spark, d).select("id", tm.day_or_night("require_tm", day, night).alias("weather"))


_TERMS = ["小雨", "多云", "雷阵雨", "大雨", "中雪", "晴"]


@query("e18_condition_flag", sql(f"""SELECT id, coalesce(w IN {tuple(wx.DAY_RAIN_TERMS)}, false) AS day_bad,
  coalesce(w IN {tuple(wx.NIGHT_RAIN_TERMS)}, false) AS night_bad FROM s""", "meal_orders",
                                 f"s AS (SELECT id, list_extract({_TERMS}, k%7+1) AS w FROM meal_orders)"))
def _(spark, d):
    w = F.get(F.array(*[F.lit(t) for t in _TERMS]), c("k") % 7)
    return meal_orders(spark, d).select("id", wx.condition_flag(w, wx.DAY_RAIN_TERMS).alias("day_bad"),
                                        wx.condition_flag(w, wx.NIGHT_RAIN_TERMS).alias("night_bad"))


@query("e19_parse_stamps", sql("""SELECT id, date_trunc('minute', place_tm) AS tm, year(place_tm) AS year,
  month(place_tm) AS month, day(place_tm) AS day, hour(place_tm) AS hr, minute(place_tm) AS min,
  CAST(place_tm AS DATE) AS cn_date FROM meal_orders""", "meal_orders"))
def _(spark, d):
    text = meal_orders(spark, d).select(
        "id", F.date_format("place_tm", "yyyyMMddHHmm").alias("stamp"),
        F.date_format("place_tm", "yyyy年MM月dd日").alias("cn"))
    return text.select("id", tm.parse_stamp("stamp").alias("tm"),
                       *[e.alias(n) for n, e in tm.stamp_parts("stamp").items()],
                       tm.parse_cn_date("cn").alias("cn_date"))


@query("e20_calendar_parts", sql("""SELECT id, year(place_tm) AS pl_year, month(place_tm) AS pl_month,
  day(place_tm) AS pl_day, CAST(place_tm AS DATE) AS pl_date FROM meal_orders""", "meal_orders"))
def _(spark, d):
    return tm.calendar_parts(meal_orders(spark, d), "place_tm", "pl_").select(
        "id", "pl_year", "pl_month", "pl_day", "pl_date")


@query("e21_has_value", sql("SELECT m.id, d.id IS NOT NULL AS memo FROM meal_orders m LEFT JOIN dist d USING (id)",
                            "dist"))
def _(spark, d):
    o = left_lookup(meal_orders(spark, d), dist_of(spark, d).select("id", c("dist").alias("memo_text")), "id")
    return o.select("id", num.has_value("memo_text").alias("memo"))


@query("e22_price_transform", sql("""SELECT id, avgexp, f2, pow(f2, 1/u)*avgexp AS p_sim FROM (
  SELECT id, u, avgexp, pow(price/100e0/avgexp, u) AS f2 FROM (
  SELECT o.id, o.price, (avgexp_lo+avgexp_up)/2 AS avgexp, 1+(o.id%5)/10e0 AS u
  FROM meal_orders o JOIN sup USING (sup_id)) WHERE price > 0)""", "sup", rounds="avgexp f2 p_sim"))
def _(spark, d):
    o = meal_orders(spark, d).filter(c("price") > 0).join(
        restaurants(spark, d).select("sup_id", num.midpoint("avgexp_lo", "avgexp_up").alias("avgexp")), "sup_id")
    o = o.withColumn("u", 1 + (c("id") % 5) / 10.0).withColumn("f2", num.price_transform("price", "avgexp", "u"))
    return o.select("id", "avgexp", "f2", num.inverse_price_transform("f2", "avgexp", "u").alias("p_sim"))


_COEF = {"(Intercept)": -1.25, "taste": 0.3, "envir": 0.1, "avgexp_lo": -0.02, "u_price_avg": 0.0005,
         "avgexp_lo:u_price_avg": 0.00001}


@query("e23_linear_predictor", sql("""SELECT o.id, -1.25e0 + 0.3e0*taste + 0.1e0*envir - 0.02e0*avgexp_lo
  + 0.0005e0*u_price_avg + 0.00001e0*avgexp_lo*u_price_avg AS eu FROM meal_orders o JOIN sup USING (sup_id)
  JOIN (SELECT user_id, avg(price) AS u_price_avg FROM meal_orders GROUP BY 1) u USING (user_id)""", "sup", rounds="eu"))
def _(spark, d):
    o = meal_orders(spark, d)
    o = left_lookup(left_lookup(o, restaurants(spark, d), "sup_id"), user_profile(o), "user_id")
    return o.select("id", num.linear_predictor(_COEF).alias("eu"))


@query("e24_coalesce_blank", sql("""SELECT p_partkey, CASE WHEN p_size%3=0 THEN p_type ELSE p_brand END AS tel
  FROM part"""))
def _(spark, d):
    p = table(spark, d, "part").withColumn("a", F.when(c("p_size") % 3 != 0, c("p_brand")).otherwise(""))
    return p.select("p_partkey", coalesce_blank("a", "p_type").alias("tel"))


@query("e25_to_currency", sql("SELECT id, price/100e0 AS price, rider_income/100e0 AS rider_income FROM meal_orders",
                              "meal_orders", rounds="price rider_income"))
def _(spark, d):
    return meal_orders(spark, d).select("id", num.to_currency("price").alias("price"),
                                        num.to_currency("rider_income").alias("rider_income"))


@query("e26_slack_at", sql("""SELECT id, date_diff('second', receive_tm, require_tm)/60e0 AS rece,
  date_diff('second', leave_tm, require_tm)/60e0 AS leav FROM meal_orders""", "meal_orders", rounds="rece leav"))
def _(spark, d):
    return meal_orders(spark, d).select("id", tm.slack_at("require_tm", "receive_tm").alias("rece"),
                                        tm.slack_at("require_tm", "leave_tm").alias("leav"))


@query("e27_pair_key", sql("SELECT id, user_id || '_' || sup_id AS pair_id FROM meal_orders", "meal_orders"))
def _(spark, d):
    return meal_orders(spark, d).select("id", num.pair_key("user_id", "sup_id").alias("pair_id"))


# --- P: projections, filters, samples ------------------------------------------------------

@query("p01_pick", sql("SELECT id, user_id, sup_id, place_tm, require_tm, dipatch_tm, read_tm, receive_tm, "
                       "arrive_tm, leave_tm FROM meal_orders", "meal_orders"))
def _(spark, d):
    return flt.pick(meal_orders(spark, d), ["id:sup_id"], drop=["finish_tm"], suffix="_tm")


@query("p02_rename_block", sql("SELECT station, tm AS ymdhm_hq, mw AS mw_hq, temp AS tmp_hq FROM weather", "weather"))
def _(spark, d):
    w = station_weather(spark, d).select("station", "tm", "mw", "temp")
    return flt.rename_block(w, {"tm": "ymdhm", "temp": "tmp"}, suffix="_hq", block=["ymdhm", "mw", "tmp"])


_SENT = {"precip_24h": ["*****", "T*****"], "visib": ["****"], "MW": ["**"]}


@query("p03_null_sentinels", sql("""SELECT event_id, CASE WHEN k%5=0 THEN NULL WHEN k%7=0 THEN NULL
  ELSE CAST(k AS VARCHAR) END AS precip_24h, CASE WHEN k%3=0 THEN NULL ELSE '0' || k END AS visib,
  CASE WHEN k%4=0 THEN NULL ELSE '*' END AS "MW" FROM s""",
                                 ctes="s AS (SELECT event_id, CAST(json_extract(props,'$.k') AS INT) AS k FROM events)"))
def _(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    raw = table(spark, d, "events").select(
        "event_id",
        F.when(k % 5 == 0, "*****").when(k % 7 == 0, "T*****").otherwise(k.cast("string")).alias("precip_24h"),
        F.when(k % 3 == 0, "****").otherwise(F.concat(F.lit("0"), k.cast("string"))).alias("visib"),
        F.when(k % 4 == 0, "**").otherwise("*").alias("MW"))
    return flt.null_sentinels(raw, _SENT)


@query("p04_valid_orders", sql("""SELECT id, price, prereq FROM timed WHERE price>0 AND prereq>40 AND prereq<75
  AND year(require_tm)=2024""", "timed", rounds="prereq"))
def _(spark, d):
    return flt.valid_orders(timed(spark, d), prereq_range=(40, 75), year=2024).select("id", "price", "prereq")


@query("p05_analysis_sample", sql("""SELECT id, delay, prereq, user_exp FROM s WHERE delay<100 AND prereq>0
  AND prereq<100 AND left1<240 AND price>0 AND price<=15000 AND paid<=15000 AND rider_income<=1300 AND ride<=1500
  AND dist<=140000 AND time<=200 AND user_exp<75 AND u_price_avg<15000 AND ow_ratio<3""", "timed dist",
                                  """s AS (SELECT t.*, d.dist, d.time/60e0 AS time,
  row_number() OVER (PARTITION BY user_id ORDER BY place_tm, t.id) AS user_exp,
  avg(price) OVER (PARTITION BY user_id) AS u_price_avg, (k%40)/nullif(k%11,0)::DOUBLE AS ow_ratio
  FROM timed t LEFT JOIN dist d ON t.id=d.id)""", rounds="delay prereq"))
def _(spark, d):
    o = timed(spark, d).withColumn("ow_ratio", num.safe_ratio(c("k") % 40, c("k") % 11))
    o = left_lookup(o, dist_of(spark, d).select("id", "dist", (c("time") / 60.0).alias("time")), "id")
    o = left_lookup(experience(o, "user_id", "place_tm", out="user_exp"),
                    user_profile(o).select("user_id", "u_price_avg"), "user_id")
    return flt.analysis_sample(o.withColumn("left_m", c("left1"))).select("id", "delay", "prereq", "user_exp")


@query("p06_sample_seconds_era", sql("""SELECT id, prereq, left_m FROM (SELECT t.id, prereq*60 AS prereq, left1 AS left_m,
  d.dist, row_number() OVER (PARTITION BY user_id ORDER BY place_tm, t.id) AS user_exp
  FROM timed t LEFT JOIN dist d ON t.id=d.id) WHERE prereq>2400 AND prereq<3600 AND left_m>=-120 AND left_m<120
  AND dist<=140000 AND user_exp<200""", "timed dist", rounds="prereq left_m"))
def _(spark, d):
    o = experience(timed(spark, d), "user_id", "place_tm", out="user_exp")
    o = left_lookup(o, dist_of(spark, d).select("id", "dist"), "id")
    o = o.withColumn("prereq", c("prereq") * 60).withColumn("left_m", c("left1"))
    return flt.analysis_sample(o, flt.BOUNDS_SECONDS_ERA).select("id", "prereq", "left_m")


@query("p07_null_outside_box", sql("""SELECT id, CASE WHEN lat BETWEEN 31.1e0 AND 31.5e0 THEN lat END AS d_lat,
  CASE WHEN lon BETWEEN 121.3e0 AND 121.7e0 THEN lon END AS d_lon FROM (SELECT id,
  CAST(split_part(d_cords,',',1) AS DOUBLE) AS lat, CAST(split_part(d_cords,',',2) AS DOUBLE) AS lon FROM dist)""",
                                   "dist", rounds="d_lat d_lon"))
def _(spark, d):
    from ..functions.text import split_coords
    coords = split_coords(dist_of(spark, d), "d_cords", "d_lat", "d_lon")
    return flt.null_outside_box(coords, {"d_lat": flt.CITY_BOX["lat"], "d_lon": flt.CITY_BOX["lon"]}).select(
        "id", "d_lat", "d_lon")


@query("p08_complete_cases", sql("""SELECT o.id, taste FROM meal_orders o LEFT JOIN sup USING (sup_id)
  WHERE taste IS NOT NULL AND from_tel IS NOT NULL""", "sup", rounds="taste"))
def _(spark, d):
    o = left_lookup(meal_orders(spark, d), restaurants(spark, d), "sup_id")
    return flt.complete_cases(o, ["taste", "from_tel"]).select("id", "taste")


@query("p09_sample_rows", sql("""SELECT id, user_id, price FROM meal_orders
  ORDER BY md5(CAST(id AS VARCHAR) || '|715'), id LIMIT 1000""", "meal_orders"))
def _(spark, d):
    return flt.sample_rows(meal_orders(spark, d), 1000, seed=715).select("id", "user_id", "price")


@query("p10_sample_entities", sql("""SELECT id, sup_id, price FROM meal_orders WHERE sup_id IN (SELECT sup_id FROM
  (SELECT DISTINCT sup_id FROM meal_orders) ORDER BY md5(CAST(sup_id AS VARCHAR) || '|715'), sup_id LIMIT 10)""", "meal_orders"))
def _(spark, d):
    return flt.sample_entities(meal_orders(spark, d), "sup_id", 10, seed=715).select("id", "sup_id", "price")


@query("p11_row_slice", sql("""SELECT id, price FROM (SELECT id, price, row_number() OVER (ORDER BY id) AS r
  FROM meal_orders) WHERE r BETWEEN 201 AND 500""", "meal_orders"))
def _(spark, d):
    return flt.row_slice(meal_orders(spark, d), 201, 500).select("id", "price")


@query("p12_on_calendar", sql("""SELECT id, require_tm, 'noon' AS kind FROM meal_orders
  WHERE hour(require_tm)=12 AND minute(require_tm)<=30
  UNION ALL SELECT id, require_tm, 'five' FROM meal_orders WHERE minute(require_tm)%5=0
  UNION ALL SELECT id, require_tm, 'day' FROM meal_orders WHERE month(require_tm)=1 AND day(require_tm)=3
  UNION ALL SELECT id, require_tm, 'yday' FROM meal_orders WHERE dayofyear(require_tm)=20""", "meal_orders"))
def _(spark, d):
    o = meal_orders(spark, d).select("id", "require_tm")
    parts = {"noon": dict(hour=12, max_minute=30), "five": dict(minute_mod=5),
             "day": dict(month=1, day=3), "yday": dict(day_of_year=20)}
    from ..sources.readers import append_frames
    return append_frames(*[flt.on_calendar(o, "require_tm", **kw).withColumn("kind", F.lit(n))
                           for n, kw in parts.items()], strict=True)


@query("p13_near_cutpoints", sql("""SELECT id, dist, (dist>1950 AND dist<2050) OR (dist>2950 AND dist<3050)
  OR (dist>3950 AND dist<4050) AS m_100 FROM dist""", "dist"))
def _(spark, d):
    return dist_of(spark, d).select("id", "dist", num.near_cutpoints("dist", [2000, 3000, 4000], 50).alias("m_100"))


@query("p14_close_to_previous", sql("""SELECT id, delay_lag1 FROM lagged WHERE occ=2 AND delay_lag1 IS NOT NULL
  AND abs(date_diff('second', require_tm_lag1, require_tm)) <= 900*60""", "lagged", rounds="delay_lag1"))
def _(spark, d):
    lagged = lag_orders(timed(spark, d).filter(c("tmref_cat") == "lunch"), ["user_id", "sup_id"],
                        ["delay", "require_tm"])
    return flt.close_to_previous(lagged, "require_tm", "require_tm_lag1", max_min=900).select("id", "delay_lag1")


@query("p15_cohort_pairs", sql("""SELECT l.id, l.user_id, l.sup_id, l.occ FROM lagged l SEMI JOIN
  (SELECT user_id, sup_id FROM lagged WHERE occ=2 AND hour(require_tm)=12 AND minute(require_tm)<=30
   AND delay_lag1 IS NOT NULL) q ON l.user_id=q.user_id AND l.sup_id=q.sup_id
  WHERE delay_lag1 IS NOT NULL""", "lagged"))
def _(spark, d):
    lagged = lag_orders(timed(spark, d).filter(c("tmref_cat") == "lunch"), ["user_id", "sup_id"], ["delay"])
    noon = (c("occ") == 2) & (F.hour("require_tm") == 12) & (F.minute("require_tm") <= 30)
    return flt.cohort_pairs(lagged, noon).select("id", "user_id", "sup_id", "occ")
