"""End-to-end table builds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import results
from ..plans.feature_build import feature_build
from ..plans.model_table import model_table, sample
from ..plans.weather_slots import weather_slots
from ..sources.fixtures import branches, meal_orders, station_weather, with_branch
from ..sources.sinks import stage_shared
from .aggregates import _USER
from .base import dist_of, query, sql

_FEAT = _USER + """,
  rr AS (SELECT t.*, r.avai_n30, n.order_n, n.order_n/nullif(r.avai_n30,0)::DOUBLE AS ow_ratio FROM timed t
    LEFT JOIN roster r ON r.date=t.require_date AND hour(r.tm)+minute(r.tm)/60e0=t.require_tmref
    LEFT JOIN (SELECT CAST(read_tm AS DATE) AS read_date, require_tmref, count(*) AS order_n FROM timed GROUP BY 1,2) n
    ON t.require_date=n.read_date AND t.require_tmref=n.require_tmref),
  feat AS (SELECT rr.*, h.onhand, s.r_shift, st.r_inshift_n, st.r_exp_n, u_n_tt, u_price_avg, u_delay_avg,
    row_number() OVER (PARTITION BY rr.user_id ORDER BY rr.place_tm, rr.id) AS user_exp,
    row_number() OVER (PARTITION BY rr.rider_id ORDER BY rr.read_tm, rr.id) AS rider_exp,
    row_number() OVER (PARTITION BY rr.sup_id ORDER BY rr.read_tm, rr.id) AS sup_exp
    FROM rr LEFT JOIN onhand h ON h.id=rr.id LEFT JOIN shifted s ON s.id=rr.id
    LEFT JOIN (SELECT *, CAST(sum(r_inshift_n) OVER (PARTITION BY rider_id ORDER BY read_date, r_shift ROWS UNBOUNDED PRECEDING) AS BIGINT)
      AS r_exp_n FROM shift_table) st ON st.rider_id=s.rider_id AND st.read_date=s.read_date AND st.r_shift=s.r_shift
    LEFT JOIN up ON up.user_id=rr.user_id)"""
_COLS = ("id", "delay", "prereq", "prepare", "ride", "left1", "avai_n30", "order_n", "ow_ratio", "user_exp", "rider_exp",
         "sup_exp", "onhand", "r_shift", "r_inshift_n", "r_exp_n", "u_n_tt", "u_price_avg", "u_delay_avg")


@query("build_features", sql(f"SELECT {', '.join(_COLS)} FROM feat", "timed roster onhand", _FEAT,
                             rounds="delay prereq prepare ride left1 ow_ratio onhand u_price_avg u_delay_avg"))
def _(spark, d):
    # the build reads its orders in many branches: store them first
    return feature_build(stage_shared(meal_orders(spark, d), "orders")).select(*_COLS)


_MODEL = """, mt AS (SELECT f.*, d.dist, d.time/60e0 AS time, sup.taste, a.temp AS temp_hqp, b.temp AS temp_pdp,
    e.pcp_begin AS pcp_begin_hqr, prereq-(prepare+d.time/60e0) AS left2, CAST(split_part(o_cords,',',1) AS DOUBLE) AS o_lat
    FROM feat f LEFT JOIN dist d ON d.id=f.id LEFT JOIN branch sup ON sup.sup_id=f.sup_id
      AND sup.from_addr='road ' || f.sup_id || CASE WHEN f.sup_id%5=0 AND f.k%2=1 THEN ' b' ELSE '' END
    LEFT JOIN weather_slots a ON a.station=1 AND CAST(a.tm AS DATE)=f.place_date AND hour(a.tm)+minute(a.tm)/60e0=f.place_tmref
    LEFT JOIN weather_slots b ON b.station=2 AND CAST(b.tm AS DATE)=f.place_date AND hour(b.tm)+minute(b.tm)/60e0=f.place_tmref
    LEFT JOIN weather_slots e ON e.station=1 AND CAST(e.tm AS DATE)=f.require_date AND hour(e.tm)+minute(e.tm)/60e0=f.require_tmref
    WHERE delay<100 AND prereq>0 AND prereq<100 AND left1<240 AND price>0 AND price<=15000 AND paid<=15000
      AND rider_income<=1300 AND ride<=1500 AND d.dist<=140000 AND d.time/60e0<=200 AND user_exp<75 AND u_price_avg<15000
      AND ow_ratio<3)"""


def _model_sample(spark, d):
    feats = feature_build(stage_shared(with_branch(meal_orders(spark, d)), "orders"))
    return sample(model_table(feats, dist_of(spark, d), branches(spark, d), weather_slots(station_weather(spark, d))))


@query("build_model_sample", sql("""SELECT id, dist, time, taste, temp_hqp, temp_pdp, pcp_begin_hqr, left2,
  CASE WHEN left2>=20 THEN 1 WHEN left2<20 THEN 0 END AS left2_20, tmref_cat,
  CASE WHEN o_lat BETWEEN 31.1e0 AND 31.5e0 THEN o_lat END AS o_lat FROM mt""",
                                 "timed roster onhand dist branch weather weather_flagged", _FEAT + _MODEL,
                                 rounds="time taste left2 o_lat"))
def _(spark, d):
    return _model_sample(spark, d).select("id", "dist", "time", "taste", "temp_hqp", "temp_pdp", "pcp_begin_hqr",
                                          "left2", "left2_20", "tmref_cat", "o_lat")


@query("build_delay_regression", sql("""SELECT 'prereq' AS term, regr_slope(delay, prereq) AS estimate, count(*) AS n FROM mt""",
                                     "timed roster onhand dist branch weather weather_flagged", _FEAT + _MODEL, rounds="estimate"))
def _(spark, d):
    from ..operators.models.regression import ols
    return ols(_model_sample(spark, d), "delay", ["prereq"]).filter(F.col("term") == "prereq").select("term", "estimate", "n")


@query("build_iv_regression", digits=4)
def _(spark, d):
    return results.iv_regressions(results.with_outcomes(_model_sample(spark, d)))
