"""Joins (J*), enrichment (K*), unions and reshapes (U*), sorts and top-k (T*)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import joins as jn
from ..operators import ranking as rk
from ..operators.aggregates import orders_per_slot
from ..operators.choice import choice_set
from ..operators.enrich import enrich_by_key, enrich_resumable, fetch_resumable
from ..operators.filters import complete_cases
from ..operators.windows import shift_rollup, shifts, to_events
from ..functions.timing import half_hour_slot
from ..functions.numeric import safe_ratio
from ..plans.weather_slots import weather_slots
from ..sources.fixtures import branches, with_branch, meal_orders, restaurants, route_lookup, station_weather, table
from ..sources.readers import append_frames
from ..sources.sinks import shared_path
from .base import dist_of, query, sql, timed

c = F.col


@query("j01_left_lookup", sql("SELECT o.id, sup_id, dist, time FROM meal_orders o LEFT JOIN dist d USING (id)", "dist"))
def _(spark, d):
    return jn.left_lookup(meal_orders(spark, d), dist_of(spark, d).select("id", "dist", "time"), "id").select(
        "id", "sup_id", "dist", "time")


@query("j02_left_lookup_multi", sql("""SELECT o.id, s.name, s.tag1 FROM
  (SELECT id, sup_id, CASE WHEN sup_id%7<>0 THEN '021-' || (5000+sup_id) END AS from_tel,
   'road ' || sup_id AS from_addr FROM meal_orders) o LEFT JOIN sup s
  ON o.sup_id IS NOT DISTINCT FROM s.sup_id AND o.from_tel IS NOT DISTINCT FROM s.from_tel
  AND o.from_addr IS NOT DISTINCT FROM s.from_addr""", "sup"))
def _(spark, d):
    o = meal_orders(spark, d).select(
        "id", "sup_id", F.concat(F.lit("road "), c("sup_id").cast("string")).alias("from_addr"),
        F.when(c("sup_id") % 7 != 0, F.concat(F.lit("021-"), (5000 + c("sup_id")).cast("string"))).alias("from_tel"))
    dim = restaurants(spark, d).select("sup_id", "from_tel", "from_addr", "name", "tag1")
    return jn.left_lookup(o, dim, ["sup_id", "from_tel", "from_addr"], null_safe=True).select("id", "name", "tag1")


@query("j03_left_lookup_renamed", sql("""SELECT t.id, n.order_n FROM timed t LEFT JOIN
  (SELECT CAST(read_tm AS DATE) AS read_date, require_tmref, count(*) AS order_n FROM timed GROUP BY 1,2) n
  ON t.require_date=n.read_date AND t.require_tmref=n.require_tmref""", "timed"))
def _(spark, d):
    o = timed(spark, d)
    return jn.left_lookup(o, orders_per_slot(o), {"require_date": "read_date", "require_tmref": "require_tmref"}
                          ).select("id", "order_n")


_SLOTW = """sw AS (SELECT station, CAST(tm AS DATE) AS date, hour(tm)+minute(tm)/60e0 AS tmref, tm, temp, precipitating,
  pcp_begin FROM weather_slots)"""


@query("j04_slot_weather", sql("""SELECT t.id, a.temp AS temp_hqp, b.temp AS temp_pdp, e.temp AS temp_hqr, f.temp AS temp_pdr,
  a.tm AS tm_hqp, f.pcp_begin AS pcp_begin_pdr FROM timed t
  LEFT JOIN sw a ON a.station=1 AND a.date=t.place_date AND a.tmref=t.place_tmref
  LEFT JOIN sw b ON b.station=2 AND b.date=t.place_date AND b.tmref=t.place_tmref
  LEFT JOIN sw e ON e.station=1 AND e.date=t.require_date AND e.tmref=t.require_tmref
  LEFT JOIN sw f ON f.station=2 AND f.date=t.require_date AND f.tmref=t.require_tmref""",
                               "timed weather weather_flagged", _SLOTW))
def _(spark, d):
    w = weather_slots(station_weather(spark, d)).select("station", "tm", "temp", "precipitating", "pcp_begin")
    out = jn.join_slot_weather(timed(spark, d), w, {"hq": 1, "pd": 2},
                               {"p": ("place_date", "place_tmref"), "r": ("require_date", "require_tmref")})
    return out.select("id", "temp_hqp", "temp_pdp", "temp_hqr", "temp_pdr", "tm_hqp", "pcp_begin_pdr")


@query("j05_daily_hourly_weather", sql("""SELECT t.id, y.temp_max, y.wet, w.temp FROM timed t
  LEFT JOIN (SELECT date, max(temp) AS temp_max, bool_or(precipitating) AS wet FROM sw WHERE station=0 GROUP BY 1) y
    ON y.date=t.require_date
  LEFT JOIN sw w ON w.station=0 AND w.date=t.place_date AND w.tmref=t.place_tmref""",
                                       "timed weather weather_flagged", _SLOTW))
def _(spark, d):
    w = jn.slot_weather(weather_slots(station_weather(spark, d)).filter(c("station") == 0)
                        .select("station", "tm", "temp", "precipitating"))
    daily = w.groupBy("date").agg(F.max("temp").alias("temp_max"), F.bool_or("precipitating").alias("wet"))
    return jn.join_daily_hourly_weather(meal_orders(spark, d), daily, w.select("date", "tmref", "temp")).select(
        "id", "temp_max", "wet", "temp")


@query("j06_inner_pairs", sql("""SELECT a.id, o_cords, d_cords FROM (SELECT id, o_cords FROM dist WHERE id%3<>0) a
  JOIN (SELECT id, d_cords FROM dist WHERE id%5<>0) b ON a.id=b.id""", "dist"))
def _(spark, d):
    r = dist_of(spark, d)
    return jn.inner_pairs(r.filter(c("id") % 3 != 0).select("id", "o_cords"),
                          r.filter(c("id") % 5 != 0).select("id", "d_cords"), "id")


@query("j07_active_at_ticks", sql("SELECT date, tm, avai_n30 FROM roster", "roster"))
def _(spark, d):
    return jn.active_at_ticks(shift_rollup(shifts(meal_orders(spark, d))))


@query("j07_work_ratio", sql("""SELECT t.id, n.order_n, r.avai_n30, n.order_n/nullif(r.avai_n30,0)::DOUBLE AS ow_ratio
  FROM timed t LEFT JOIN roster r ON r.date=t.require_date AND hour(r.tm)+minute(r.tm)/60e0=t.require_tmref
  LEFT JOIN (SELECT CAST(read_tm AS DATE) AS read_date, require_tmref, count(*) AS order_n FROM timed GROUP BY 1,2) n
  ON t.require_date=n.read_date AND t.require_tmref=n.require_tmref""", "timed roster", rounds="ow_ratio"))
def _(spark, d):
    from ..plans.feature_build import add_work_ratio
    return add_work_ratio(timed(spark, d)).select("id", "order_n", "avai_n30", "ow_ratio")


@query("j08_tick_grid", sql("""SELECT date, CAST(date AS TIMESTAMP) + to_minutes(m) AS tm
  FROM (SELECT DISTINCT CAST(read_tm AS DATE) AS date FROM meal_orders), range(570, 1351, 30) AS r(m)""", "meal_orders"))
def _(spark, d):
    return jn.tick_grid(meal_orders(spark, d).select(F.to_date("read_tm").alias("date")))


@query("j09_keep_keys", sql("""SELECT id, rider_id FROM meal_orders WHERE
  rider_id IN (SELECT rider_id FROM meal_orders GROUP BY 1 HAVING sum(rider_income)>300000)
  AND sup_id IN (SELECT sup_id FROM sup WHERE taste > 7)""", "sup"))
def _(spark, d):
    o = meal_orders(spark, d)
    rich = o.groupBy("rider_id").agg(F.sum("rider_income").alias("s")).filter(c("s") > 300000)
    tasty = restaurants(spark, d).filter(c("taste") > 7)
    return jn.keep_keys(jn.keep_keys(o, rich, "rider_id"), tasty, "sup_id").select("id", "rider_id")


@query("j10_drop_keys", sql("SELECT id FROM meal_orders WHERE id NOT IN (SELECT id FROM dist)", "dist"))
def _(spark, d):
    return jn.drop_keys(meal_orders(spark, d), dist_of(spark, d), "id").select("id")


@query("j11_previous_distinct", sql("SELECT id, alt_id, alt_id_store FROM prev_store", "prev_store"))
def _(spark, d):
    return jn.previous_distinct(meal_orders(spark, d)).select("id", "alt_id", "alt_id_store")


@query("j12_bind_by_position", sql("""SELECT a.id, b.o_orderkey FROM
  (SELECT id, row_number() OVER (ORDER BY id) AS r FROM meal_orders) a FULL JOIN
  (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) b ON a.r=b.r""", "meal_orders"))
def _(spark, d):
    return jn.bind_by_position(meal_orders(spark, d).select("id"), table(spark, d, "orders").select("o_orderkey"),
                               "id", "o_orderkey")


# --- K: enrichment ---------------------------------------------------------------------

def _stub_geocode(batch: pd.DataFrame) -> pd.DataFrame:
    n = batch["address"].str.extract(r"(\d+)$")[0].astype("int64")
    return pd.DataFrame({"lat": 31.0 + (n % 50) / 100, "lon": 121.0 + (n % 70) / 100}).where(n % 10 != 3)


def _stub_route(batch: pd.DataFrame) -> pd.DataFrame:
    o, t = batch["o_cords"].str.len(), batch["d_cords"].str[3:5].astype("int64")
    return pd.DataFrame({"dist": (o * 100 + t).astype("int64"), "time": (t * 3).astype("int64")})


_GEO = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
_ROUTE = T.StructType([T.StructField("dist", T.LongType()), T.StructField("time", T.LongType())])


@query("k01_geocode", sql("""SELECT id, address, CASE WHEN n%10<>3 THEN 31e0+(n%50)/100e0 END AS lat,
  CASE WHEN n%10<>3 THEN 121e0+(n%70)/100e0 END AS lon FROM
  (SELECT id, 'road ' || user_id AS address, user_id AS n FROM meal_orders)""", "meal_orders", rounds="lat lon"))
def _(spark, d):
    o = meal_orders(spark, d).select("id", F.concat(F.lit("road "), c("user_id").cast("string")).alias("address"))
    return enrich_by_key(o, ["address"], _stub_geocode, _GEO)


@query("k01_geocode_resumed", sql("""SELECT id, address, CASE WHEN n%10<>3 AND n%100<>77 THEN 31e0+(n%50)/100e0 END AS lat,
  CASE WHEN n%10<>3 AND n%100<>77 THEN 121e0+(n%70)/100e0 END AS lon,
  CASE WHEN n%100=77 THEN 'LookupError: no such road' END AS error FROM
  (SELECT id, 'road ' || user_id AS address, user_id AS n FROM meal_orders)""", "meal_orders", rounds="lat lon"))
def _(spark, d):
    """Orders looked up in two runs over one store; the second asks the keys the first left."""
    def fetch(batch):
        if batch["address"].str.endswith("77").any():
            raise LookupError("no such road")
        return _stub_geocode(batch)

    o = meal_orders(spark, d).select("id", F.concat(F.lit("road "), c("user_id").cast("string")).alias("address"))
    store = shared_path(spark, "geocodes")
    fetch_resumable(o.filter(c("id") % 2 == 0), ["address"], fetch, _GEO, store, batches=2)
    return enrich_resumable(o, ["address"], fetch, _GEO, store, batches=2)


@query("k02_route", sql("""SELECT id, o_cords, d_cords, length(o_cords)*100+CAST(d_cords[4:5] AS BIGINT) AS dist,
  CAST(d_cords[4:5] AS BIGINT)*3 AS time FROM dist""", "dist"))
def _(spark, d):
    o = dist_of(spark, d).select("id", "o_cords", "d_cords")
    known = (o.filter(c("o_cords").startswith("31.1")).select("o_cords", "d_cords").distinct()
             .withColumn("dist", (F.length("o_cords") * 100 + F.substring("d_cords", 4, 2).cast("int")).cast("long"))
             .withColumn("time", (F.substring("d_cords", 4, 2).cast("int") * 3).cast("long")))
    return enrich_by_key(o, ["o_cords", "d_cords"], _stub_route, _ROUTE, cache=known)


# --- U: unions and reshapes, S2/S3 ------------------------------------------------------

@query("u01_append_loose", sql("""SELECT id, price, NULL::BIGINT AS dist FROM meal_orders
  UNION ALL SELECT id, NULL, dist FROM dist""", "dist"))
def _(spark, d):
    return append_frames(meal_orders(spark, d).select("id", "price"), dist_of(spark, d).select("id", "dist"))


@query("u02_append_strict", sql("""SELECT id, price FROM meal_orders WHERE id%2=0
  UNION ALL SELECT id, price FROM meal_orders WHERE id%3=0""", "meal_orders"))
def _(spark, d):
    o = meal_orders(spark, d)
    return append_frames(o.filter(c("id") % 2 == 0).select("id", "price"),
                         o.filter(c("id") % 3 == 0).select("price", "id"), strict=True)


@query("u03_choice_set", sql("""SELECT id, sup_id, from_addr, chosen, taste, avgexp, u_n_tt FROM (
  SELECT *, max(chosen) OVER (PARTITION BY id) AS hi, min(chosen) OVER (PARTITION BY id) AS lo
  FROM b WHERE taste IS NOT NULL AND avgexp IS NOT NULL) WHERE hi=1 AND lo=0""", "prev_store branch", """un AS (SELECT user_id, count(*) AS u_n_tt FROM meal_orders GROUP BY 1),
  br AS (SELECT *, sup_id AS s, (avgexp_lo+avgexp_up)/2 AS avgexp FROM branch),
  here AS (SELECT *, CASE WHEN sup_id%7<>0 THEN '021-' || (5000+sup_id+100*CASE WHEN sup_id%5=0 THEN k%2 ELSE 0 END) END AS from_tel,
    'road ' || sup_id || CASE WHEN sup_id%5=0 AND k%2=1 THEN ' b' ELSE '' END AS from_addr FROM prev_store),
  b AS (SELECT p.id, p.sup_id, p.from_addr, 1 AS chosen, s.taste, s.avgexp, u_n_tt FROM here p JOIN un USING (user_id)
    LEFT JOIN br s ON s.s=p.sup_id AND s.from_tel IS NOT DISTINCT FROM p.from_tel AND s.from_addr=p.from_addr WHERE u_n_tt>1
  UNION ALL SELECT p.id, q.sup_id, q.from_addr, 0, s.taste, s.avgexp, u_n_tt FROM here p JOIN un USING (user_id) JOIN here q ON q.id=p.alt_id
    LEFT JOIN br s ON s.s=q.sup_id AND s.from_tel IS NOT DISTINCT FROM q.from_tel AND s.from_addr=q.from_addr WHERE u_n_tt>1)""", rounds="taste avgexp"))
def _(spark, d):
    from ..plans.choices import store_choices
    return store_choices(with_branch(meal_orders(spark, d)), branches(spark, d)).select(
        "id", "sup_id", "from_addr", "chosen", "taste", "avgexp", "u_n_tt")


@query("u04_to_events", sql("""SELECT rider_id, id, 'arrive_tm' AS action, arrive_tm AS tm FROM meal_orders
  UNION ALL SELECT rider_id, id, 'finish_tm', finish_tm FROM meal_orders""", "meal_orders"))
def _(spark, d):
    return to_events(meal_orders(spark, d), ["rider_id", "id"], ["arrive_tm", "finish_tm"])


# --- T: sorts, top-k, dedupe -------------------------------------------------------------

@query("t01_order_by", sql("""SELECT sup_id, taste, n FROM (SELECT sup_id, count(*) AS n FROM meal_orders GROUP BY 1)
  JOIN sup USING (sup_id) ORDER BY taste DESC NULLS LAST, n, sup_id""", "sup", rounds="taste"))
def _(spark, d):
    n = meal_orders(spark, d).groupBy("sup_id").agg(F.count(F.lit(1)).alias("n"))
    return rk.order_by(n.join(restaurants(spark, d).select("sup_id", "taste"), "sup_id"), ["-taste", "n", "sup_id"])


@query("t02_kth_most_frequent", sql("""SELECT sup_id, n FROM (SELECT sup_id, count(*) AS n FROM meal_orders GROUP BY 1)
  ORDER BY n DESC, sup_id DESC LIMIT 1 OFFSET 2""", "meal_orders"))
def _(spark, d):
    return rk.kth_most_frequent(meal_orders(spark, d), "sup_id", 3)


_CAND = """cand AS (SELECT l_suppkey AS sup_id, l_orderkey AS cid, l_linenumber AS ln, l_quantity/50e0 AS adist_long,
  CASE WHEN l_quantity/50e0>0.7 AND l_discount*20>=1 THEN 0 ELSE 1 END AS match_rule FROM lineitem)"""


def _candidates(spark, d):
    from ..functions.text import match_rule
    li = table(spark, d, "lineitem")
    return li.select(c("l_suppkey").alias("sup_id"), c("l_orderkey").alias("cid"), c("l_linenumber").alias("ln"),
                     (c("l_quantity") / 50.0).alias("adist_long"),
                     match_rule(c("l_quantity") / 50.0, c("l_discount") * 20).alias("match_rule"))


@query("t03_best_match", sql("""SELECT sup_id, cid, ln, adist_long FROM (SELECT *, row_number() OVER
  (PARTITION BY sup_id ORDER BY adist_long, cid, ln) AS r FROM cand) WHERE r=1""", ctes=_CAND, rounds="adist_long"))
def _(spark, d):
    return rk.best_match(_candidates(spark, d), ["sup_id"], tiebreak=["cid", "ln"]).drop("match_rule")


@query("t03_best_match_as_written", sql("""SELECT sup_id, cid, ln, match_rule FROM (SELECT *, rank() OVER
  (PARTITION BY sup_id ORDER BY match_rule DESC) AS r FROM cand) WHERE r=1""", ctes=_CAND))
def _(spark, d):
    return rk.best_match(_candidates(spark, d), ["sup_id"], mode="as_written").drop("adist_long")


@query("t04_keep_first", sql("""SELECT user_id, sup_id, id, price FROM (SELECT *, row_number() OVER
  (PARTITION BY user_id, sup_id ORDER BY place_tm, id) AS r FROM meal_orders) WHERE r=1""", "meal_orders"))
def _(spark, d):
    o = meal_orders(spark, d).select("user_id", "sup_id", "place_tm", "id", "price")
    return rk.keep_first(o, ["user_id", "sup_id"], ["place_tm", "id"]).drop("place_tm")


@query("t05_distinct_rows", sql("SELECT DISTINCT sup_id, rider_id FROM meal_orders", "meal_orders"))
def _(spark, d):
    return rk.distinct_rows(meal_orders(spark, d), ["sup_id", "rider_id"])


@query("t06_head", sql("SELECT id, finish_tm, price FROM meal_orders ORDER BY price DESC, id LIMIT 20", "meal_orders"))
def _(spark, d):
    return rk.head(meal_orders(spark, d).select("id", "finish_tm", "price"), 20, ["-price", "id"])
