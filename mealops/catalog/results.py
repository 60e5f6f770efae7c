"""Result tables on the analysis table: all orders with a route and a work ratio."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.models.regression import INTERCEPT
from ..plans import results
from ..plans.feature_build import feature_build
from ..plans.model_table import model_table
from ..plans.weather_slots import weather_slots
from ..sources.fixtures import branches, meal_orders, station_weather, with_branch
from ..sources.sinks import stage_shared
from .aggregates import _REGR, _SUM, _box_sql, _stat_sql
from .base import dist_of, query, sql
from .builds import _FEAT, _MODEL

_NEEDS = "timed roster onhand dist branch weather weather_flagged"
_CRT = (_FEAT + _MODEL[:_MODEL.index("WHERE delay<100")].replace("prereq-(prepare", """
    CASE WHEN a.pcp_begin=a.tm THEN 1 ELSE 0 END AS sudden_rain_hqp, CASE WHEN b.pcp_begin=b.tm THEN 1 ELSE 0 END AS sudden_rain_pdp,
    f.rider_income/d.dist::DOUBLE AS cpm, prereq-(prepare""") + "WHERE d.dist IS NOT NULL AND ow_ratio IS NOT NULL)")


def _analysis(spark, d, cols: list[str]) -> DataFrame:
    """The columns ``cols`` of the analysis table; what derives no other is not computed."""
    feats = feature_build(stage_shared(with_branch(meal_orders(spark, d)), "orders"))
    table = model_table(feats, dist_of(spark, d), branches(spark, d), weather_slots(station_weather(spark, d)))
    kept = results.with_outcomes(table.filter("dist is not null and ow_ratio is not null"))
    return stage_shared(kept.withColumn("cpm", F.col("rider_income") / F.col("dist")).select(*dict.fromkeys(cols)), "analysis")


def _spec_columns(y: str, specs: dict[str, list[str]]) -> list[str]:
    return [y, *(c for xs in specs.values() for x in xs for c in x.split(":"))]


# --- descriptives ------------------------------------------------------------------------

_USERS = ["u_delay_avg", "u_n_tt", "u_prereq_avg", "u_price_avg", "u_price_sd", "u_rinc_avg", "u_span"]
_TABLES = {
    "order": (["prereq", "prepare", "ride", "delay", "rider_income", "price"],
              "(SELECT * REPLACE (rider_income/100e0 AS rider_income, price/100e0 AS price) FROM mt)"),
    "user": (_USERS, "(SELECT * FROM up WHERE user_id IN (SELECT user_id FROM mt))"),
    "rider": (["exp_max", "exp_min", "orders_max", "orders_min"],
              """(SELECT max(r_exp_n) AS exp_max, min(r_exp_n) AS exp_min, max(r_inshift_n) AS orders_max,
               min(r_inshift_n) AS orders_min FROM mt GROUP BY rider_id)"""),
    "restaurant": (["exp_max", "exp_min"], "(SELECT max(sup_exp) AS exp_max, min(sup_exp) AS exp_min FROM mt GROUP BY sup_id)"),
}


@query("build_descriptives", sql(" UNION ALL ".join(
    f"SELECT '{name}' AS \"table\", * FROM ({_stat_sql(cols, src, _SUM)})" for name, (cols, src) in _TABLES.items()),
    _NEEDS, _CRT, rounds="mean sd p25 median p75 max", digits=5), digits=5)
def _(spark, d):
    cols = [*_TABLES["order"][0], *_USERS, "user_id", "rider_id", "r_exp_n", "r_inshift_n", "sup_id", "sup_exp"]
    tables = results.descriptives(_analysis(spark, d, cols))
    return reduce(DataFrame.unionByName, [t.withColumn("table", F.lit(name)) for name, t in tables.items()])


# --- channels ----------------------------------------------------------------------------

_LEAD = "CAST(floor(prereq/5)*5 AS BIGINT)"
_BOXES = {
    "after_leaving": (_LEAD, "date_diff('second', leave_tm, require_tm)/60e0", "mt"),
    "after_receiving": (_LEAD, "date_diff('second', receive_tm, require_tm)/60e0", "mt"),
    "delay": (_LEAD, "delay", "mt"),
    "lead_by_minute": ("minute(require_tm)", "prereq", "mt"),
    "lead_by_celsius": ("round_even((temp_pdp-32)*5/9e0, 0)", "prereq", "(SELECT * FROM mt WHERE temp_pdp IS NOT NULL)"),
}


def _channel_sql() -> str:
    parts = []
    for name, spec in _BOXES.items():
        ctes, body = _box_sql(*spec)
        parts.append(f"SELECT '{name}' AS channel, * REPLACE (bucket::DOUBLE AS bucket) FROM (WITH {ctes} {body})")
    return " UNION ALL ".join(parts)


@query("build_channels", sql(_channel_sql(), _NEEDS, _CRT, rounds="q1 median q3 lower upper"))
def _(spark, d):
    tables = results.channels(_analysis(spark, d, ["prereq", "delay", "require_tm", "leave_tm", "receive_tm",
                                                   "require_date", "require_tmref", "tmref_cat", "temp_pdp"]))
    boxes = [tables[name].withColumnRenamed(tables[name].columns[0], "bucket").withColumn("bucket", F.col("bucket").cast("double"))
             .withColumn("channel", F.lit(name)) for name in _BOXES]
    return reduce(DataFrame.unionByName, boxes)


# --- regressions, by their first-order conditions ----------------------------------------

def _product(term: str):
    return reduce(lambda a, b: a * b, [F.col(c).cast("double") for c in term.split(":")])


def residual_scores(df: DataFrame, fits: DataFrame, y: str, specs: dict[str, list[str]],
                    where: dict[str, str] | None = None) -> DataFrame:
    """Per specification and term: rows it is complete for and the size of the correlation of
    its residual with the term (uncentred), 0 where the fit is least squares. One read for all;
    ``fits`` has one row per specification and term."""
    found = {(r["spec"], r["term"]): r["estimate"] or 0.0 for r in fits.select("spec", "term", "estimate").collect()}
    out = []
    for spec, xs in specs.items():
        terms = {INTERCEPT: F.lit(1.0), **{x: _product(x) for x in xs}}
        e = F.col(y).cast("double") - sum((F.lit(found.get((spec, t), 0.0)) * x for t, x in terms.items()), F.lit(0.0))
        if where:
            e = F.when(F.expr(where[spec]), e)
        full = F.when(e.isNotNull(), F.col(y).cast("double"))
        for t, x in terms.items():
            kept = F.when(e.isNotNull(), x)
            size = F.sqrt(F.sum(kept * kept) * F.sum(full * full))
            out.append(F.struct(F.lit(spec).alias("spec"), F.lit(t).alias("term"), F.count(e).alias("n"),
                                F.abs(F.try_divide(F.sum(e * x), size)).alias("score")))
    return df.agg(F.array(*out).alias("_a")).select(F.inline("_a")).filter(F.col("n") > 0)


def _cases_sql(y: str, specs: dict[str, list[str]], where: dict[str, str] | None = None) -> str:
    parts = []
    for spec, xs in specs.items():
        names = dict.fromkeys([y, *(c for x in xs for c in x.split(":"))])
        cond = " AND ".join([f"{c} IS NOT NULL" for c in names] + ([where[spec]] if where else []))
        terms = ", ".join(f"'{t}'" for t in [INTERCEPT, *xs])
        parts.append(f"SELECT '{spec}' AS spec, unnest([{terms}]) AS term, n, 0e0 AS score FROM "
                     f"(SELECT count(*) AS n FROM mt WHERE {cond}) WHERE n > 0")
    return " UNION ALL ".join(parts)


@query("build_lateness_specs", sql(_cases_sql("delay", results.DELAY_SPECS), _NEEDS, _CRT))
def _(spark, d):
    df = _analysis(spark, d, _spec_columns("delay", results.DELAY_SPECS))
    return residual_scores(df, results.delay_regressions(df), "delay", results.DELAY_SPECS)


@query("build_first_stages", sql(_cases_sql("prereq", results.FIRST_STAGE_SPECS), _NEEDS, _CRT))
def _(spark, d):
    df = _analysis(spark, d, _spec_columns("prereq", results.FIRST_STAGE_SPECS))
    return residual_scores(df, results.first_stages(df), "prereq", results.FIRST_STAGE_SPECS)


_CUTS = (-10.0, 0.0, 10.0)
_SLACK = {f"left2>{cut:g}": results.SLACK_SPEC for cut in _CUTS}
_ABOVE = {spec: spec for spec in _SLACK}


@query("build_slack_specs", sql(_cases_sql("delay", _SLACK, _ABOVE), _NEEDS, _CRT))
def _(spark, d):
    df = _analysis(spark, d, ["left2", *_spec_columns("delay", _SLACK)])
    return residual_scores(df, results.slack_regressions(df, "left2", _CUTS), "delay", _SLACK, _ABOVE)


# --- repeat customers --------------------------------------------------------------------

_ADJUST = _REGR.format(y="prereq-prereq_lag1", x="delay_lag1")
_LAGGED = """, lg AS (SELECT * FROM (SELECT *, lag(delay) OVER w AS delay_lag1, lag(prereq) OVER w AS prereq_lag1,
    row_number() OVER w AS occ FROM mt WHERE tmref_cat='lunch' WINDOW w AS (PARTITION BY user_id, sup_id ORDER BY place_tm, id))
    WHERE delay_lag1 IS NOT NULL)"""


@query("build_lead_adjustment", sql(f"""SELECT 'all' AS part, CAST(NULL AS BIGINT) AS occ, {_ADJUST} FROM lg
  UNION ALL SELECT 'second', NULL, {_ADJUST} FROM lg WHERE occ=2
  UNION ALL SELECT 'by occasion', occ, {_ADJUST} FROM lg WHERE occ<7 GROUP BY occ""",
                                    _NEEDS, _CRT + _LAGGED, rounds="slope intercept r2"))
def _(spark, d):
    lagged = results.repeat_customers(_analysis(
        spark, d, ["id", "user_id", "sup_id", "place_tm", "require_tm", "delay", "prereq", "tmref_cat"]))
    parts = {"all": results.lead_adjustment(lagged), "second": results.lead_adjustment(lagged, occasion=2),
             "by occasion": results.lead_adjustment(lagged, by_occasion=True)}
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                  [t.withColumn("part", F.lit(name)) for name, t in parts.items()])
