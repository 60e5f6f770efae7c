"""Statistical models (M*). Closed forms serve as oracles where one exists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import floor_bucket, threshold_flag
from ..functions.timing import days_left, meal_hours
from ..operators.joins import left_lookup
from ..operators.models import causal, clusters, learners, robust
from ..operators.models import regression as reg
from ..operators.windows import rider_month_running
from ..sources.fixtures import meal_orders, restaurants
from ..sources.sinks import stage_shared
from .base import dist_of, moving, query, sql, timed

c = F.col


def routed(spark, d):
    """Timed orders with route columns and a short-slack treatment flag."""
    o = left_lookup(timed(spark, d), dist_of(spark, d).select("id", "dist", (c("time") / 60.0).alias("time")), "id")
    return o.withColumn("treat", threshold_flag("left1", 8))


@query("m01_design_columns", sql("""SELECT id, CAST(tmref_cat='lunch' AS INT) AS tmref_catlunch,
  CAST(tmref_cat='other' AS INT) AS tmref_catother, rider_income*d.dist::DOUBLE AS rider_income_x_dist
  FROM timed JOIN dist d USING (id)""", "timed dist"))
def _(spark, d):
    df, added = reg.design_columns(routed(spark, d), {"tmref_cat": ["dinner", "lunch", "other"]},
                                   ["rider_income:dist"], complete=["delay", "dist"])
    return df.select("id", *added)


_FIT1 = """SELECT {g} '(Intercept)' AS term, a AS estimate, sqrt(s2*(1/{n}+mx*mx/sxx)) AS std_error,
  a/sqrt(s2*(1/{n}+mx*mx/sxx)) AS t_value, n, n-2 AS df_resid, r2 FROM {t}
  UNION ALL SELECT {g} '{x}', b, sqrt(s2/sxx), b/sqrt(s2/sxx), n, n-2, r2 FROM {t}"""


@query("m02_ols_one", sql(_FIT1.format(g="", x="prereq", t="fit", n="n"), "timed", """fit AS (SELECT regr_slope(delay,prereq) AS b,
  regr_intercept(delay,prereq) AS a, avg(prereq) AS mx, regr_sxx(delay,prereq) AS sxx, count(*) AS n,
  regr_syy(delay,prereq)*(1-regr_r2(delay,prereq))/(count(*)-2) AS s2, regr_r2(delay,prereq) AS r2 FROM timed)""",
                          rounds="estimate std_error t_value r2", digits=5), digits=5)
def _(spark, d):
    return reg.ols(timed(spark, d), "delay", ["prereq"]).drop("p_value")


_S2 = """s AS (SELECT count(*) AS n, avg(delay) AS my, avg(x1) AS m1, avg(x2) AS m2, count(*)*var_pop(x1) AS s11,
  count(*)*var_pop(x2) AS s22, count(*)*covar_pop(x1,x2) AS s12, count(*)*covar_pop(x1,delay) AS s1y,
  count(*)*covar_pop(x2,delay) AS s2y FROM (SELECT delay, prereq AS x1, price::DOUBLE AS x2 FROM timed)),
  b AS (SELECT *, (s22*s1y-s12*s2y)/(s11*s22-s12*s12) AS b1, (s11*s2y-s12*s1y)/(s11*s22-s12*s12) AS b2 FROM s)"""


@query("m02_ols_two", sql("""SELECT '(Intercept)' AS term, my-b1*m1-b2*m2 AS estimate, n FROM b
  UNION ALL SELECT 'prereq', b1, n FROM b UNION ALL SELECT 'price', b2, n FROM b""", "timed", _S2, rounds="estimate"))
def _(spark, d):
    return reg.ols(timed(spark, d), "delay", ["prereq", "price"]).select("term", "estimate", "n")


_RESID = """ft AS (SELECT regr_slope(delay,prereq) AS b, regr_intercept(delay,prereq) AS a, avg(prereq) AS mx,
  regr_sxx(delay,prereq) AS sxx, count(*) AS n FROM timed),
  rs AS (SELECT rider_id, delay-a-b*prereq AS e, 1e0/n-mx*(prereq-mx)/sxx AS ha, (prereq-mx)/sxx AS hb FROM timed, ft)"""


@query("m02_ols_robust", sql("""SELECT '(Intercept)' AS term, a AS estimate, sqrt(n/(n-2e0)*va) AS std_error, n, n-2 AS df_resid
  FROM ft, (SELECT sum(e*e*ha*ha) AS va FROM rs) UNION ALL
  SELECT 'prereq', b, sqrt(n/(n-2e0)*vb), n, n-2 FROM ft, (SELECT sum(e*e*hb*hb) AS vb FROM rs)""", "timed", _RESID,
                             rounds="estimate std_error"))
def _(spark, d):
    return robust.ols_robust(timed(spark, d), "delay", ["prereq"]).select("term", "estimate", "std_error", "n", "df_resid")


@query("m02_ols_clustered", sql("""SELECT '(Intercept)' AS term, a AS estimate, sqrt(g/(g-1e0)*(n-1)/(n-2)*va) AS std_error, n, g-1 AS df_resid
  FROM ft, cl UNION ALL SELECT 'prereq', b, sqrt(g/(g-1e0)*(n-1)/(n-2)*vb), n, g-1 FROM ft, cl""", "timed", _RESID + """,
  cl AS (SELECT count(*) AS g, sum(a*a) AS va, sum(b*b) AS vb FROM (SELECT sum(e*ha) AS a, sum(e*hb) AS b FROM rs GROUP BY rider_id))""",
                                rounds="estimate std_error"))
def _(spark, d):
    return robust.ols_robust(timed(spark, d), "delay", ["prereq"], cluster="rider_id").select(
        "term", "estimate", "std_error", "n", "df_resid")


@query("m02_ols_specs")
def _(spark, d):
    o, _ = reg.design_columns(routed(spark, d), {"tmref_cat": ["dinner", "lunch", "other"]})
    meals = ["tmref_catlunch", "tmref_catother"]
    return reg.ols_specs(o, "delay", {
        "lm1": ["prereq", "price", *meals], "lm2": ["prereq", "prepare", "price", *meals],
        "lm4": ["prereq", "prepare", "price", *meals, *reg.crossed("rider_income", "time", "dist")]})


_CASES = {"lead": "prereq", "far": "dist", "way": "time", "load": "menu_num"}


@query("m02_specs_cases", sql(" UNION ALL ".join(
    f"SELECT '{k}' AS spec, '(Intercept)' AS term, a AS estimate, sqrt(s2*(1e0/n+mx*mx/sxx)) AS std_error, n, r2 FROM fit WHERE spec='{k}' "
    f"UNION ALL SELECT '{k}', '{x}', b, sqrt(s2/sxx), n, r2 FROM fit WHERE spec='{k}'" for k, x in _CASES.items()), "timed dist",
    "xs AS (SELECT t.id, t.delay, t.prereq, t.menu_num, d.dist, d.time/60e0 AS time FROM timed t LEFT JOIN dist d USING (id)), one AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS spec, delay AS y, {x}::DOUBLE AS x FROM xs WHERE {x} IS NOT NULL" for k, x in _CASES.items())
    + """), fit AS (SELECT spec, regr_slope(y,x) AS b, regr_intercept(y,x) AS a, avg(x) AS mx, regr_sxx(y,x) AS sxx, count(*) AS n,
  regr_syy(y,x)*(1-regr_r2(y,x))/(count(*)-2) AS s2, regr_r2(y,x) AS r2 FROM one WHERE y IS NOT NULL GROUP BY spec)""",
    rounds="estimate std_error r2", digits=5), digits=5)
def _(spark, d):
    """Specifications with complete cases of their own, fitted in one pass."""
    return reg.ols_specs(routed(spark, d), "delay", {k: [x] for k, x in _CASES.items()}).select(
        "spec", "term", "estimate", "std_error", "n", "r2")


@query("m03_weighted_ls", sql("""SELECT '(Intercept)' AS term, (swy-b*swx)/sw AS estimate, n FROM q
  UNION ALL SELECT 'prereq', b, n FROM q""", "timed", """q AS (SELECT *, (swxy-swx*swy/sw)/(swxx-swx*swx/sw) AS b FROM (
  SELECT count(*) AS n, sum(w) AS sw, sum(w*prereq) AS swx, sum(w*delay) AS swy, sum(w*prereq*delay) AS swxy,
  sum(w*prereq*prereq) AS swxx FROM (SELECT *, 1e0+k%5 AS w FROM timed)))""", rounds="estimate"))
def _(spark, d):
    o = timed(spark, d).withColumn("w", 1.0 + c("k") % 5)
    return reg.ols(o, "delay", ["prereq"], weight="w").select("term", "estimate", "n")


@query("m04_fixed_effects", sql("""SELECT 'prereq' AS term, regr_slope(y,x) AS estimate,
  sqrt(regr_syy(y,x)*(1-regr_r2(y,x))/(count(*)-1-count(DISTINCT rider_id))/regr_sxx(y,x)) AS std_error, count(*) AS n,
  count(*)-1-count(DISTINCT rider_id) AS df_resid FROM (SELECT rider_id, delay-avg(delay) OVER w AS y,
  prereq-avg(prereq) OVER w AS x FROM timed WINDOW w AS (PARTITION BY rider_id))""", "timed", rounds="estimate std_error"))
def _(spark, d):
    return reg.fe_ols(timed(spark, d), "delay", ["prereq"], "rider_id").select(
        "term", "estimate", "std_error", "n", "df_resid")


@query("m05_iv_2sls", sql("""SELECT 'prereq' AS term, covar_pop(z,delay)/covar_pop(z,prereq) AS estimate, count(*) AS n
  FROM (SELECT *, (k%9)::DOUBLE AS z FROM timed)""", "timed", rounds="estimate"))
def _(spark, d):
    o = timed(spark, d).withColumn("z", (c("k") % 9).cast("double"))
    return reg.iv_2sls(o, "delay", ["prereq"], [], ["z"]).filter(c("term") == "prereq").select("term", "estimate", "n")


@query("m05_iv_overidentified")
def _(spark, d):
    o = routed(spark, d).withColumn("z1", (c("k") % 9).cast("double")).withColumn("z2", (c("k") % 7).cast("double"))
    return reg.iv_2sls(o, "delay", ["prereq"], ["prepare", "price", "dist"], ["z1", "z2"])


@query("m06_huber", digits=3)
def _(spark, d):
    return reg.huber(timed(spark, d), "delay", ["prereq", "prepare", "price"])


@query("m07_logit", digits=4)
def _(spark, d):
    coefs, _ = learners.logit(routed(spark, d), "treat", ["prepare", "price", "rider_income"])
    return coefs


_P = """p AS (SELECT *, CAST(left1>=8 AS INT) AS treat, 0.2e0+(k%6)/10e0 AS pihat FROM timed),
  w AS (SELECT *, CASE WHEN treat=1 THEN 1/pihat ELSE 1/(1-pihat) END AS ipw_weights FROM p)"""


@query("m08_ipw_weights", sql("SELECT id, treat, ipw_weights FROM w", "timed", _P, rounds="ipw_weights"))
def _(spark, d):
    o = timed(spark, d).withColumn("treat", threshold_flag("left1", 8)).withColumn("pihat", 0.2 + (c("k") % 6) / 10.0)
    return causal.ipw_weights(o, "treat", "pihat").select("id", "treat", "ipw_weights")


@query("m08_ipw_ate", sql("""SELECT 'treat' AS term, sum(delay*ipw_weights) FILTER (treat=1)/sum(ipw_weights) FILTER (treat=1)
  - sum(delay*ipw_weights) FILTER (treat=0)/sum(ipw_weights) FILTER (treat=0) AS estimate, count(*) AS n FROM w""",
                          "timed", _P, rounds="estimate"))
def _(spark, d):
    o = timed(spark, d).withColumn("treat", threshold_flag("left1", 8)).withColumn("pihat", 0.2 + (c("k") % 6) / 10.0)
    return causal.ipw_ate(o, "delay", "treat", "pihat").filter(c("term") == "treat").select("term", "estimate", "n")


@query("m09_match_att", sql("""SELECT sum(t.sy - t.n*m.csy/m.cn)/sum(t.n) AS att, CAST(sum(t.n) AS BIGINT) AS matched,
  0::BIGINT AS unmatched, sum(m.dist*t.n)/sum(t.n) AS mean_dist FROM t JOIN m USING (tmref_cat, a, b)""", "timed",
                            """x AS (SELECT *, CAST(left1>=8 AS INT) AS treat, ride AS x1, menu_num::DOUBLE AS x2 FROM timed),
  sd AS (SELECT stddev_samp(x1) AS s1, stddev_samp(x2) AS s2 FROM x),
  z AS (SELECT tmref_cat, treat, delay, x1/s1 AS a, x2/s2*sqrt(2e0) AS b FROM x, sd),
  t AS (SELECT tmref_cat, a, b, count(*) AS n, sum(delay) AS sy FROM z WHERE treat=1 GROUP BY 1,2,3),
  u AS (SELECT tmref_cat, a, b, count(*) AS n, sum(delay) AS sy FROM z WHERE treat=0 GROUP BY 1,2,3),
  pr AS (SELECT t.tmref_cat, t.a, t.b, u.n, u.sy, sqrt((t.a-u.a)*(t.a-u.a)+(t.b-u.b)*(t.b-u.b)) AS dist
    FROM t JOIN u ON t.tmref_cat=u.tmref_cat),
  m AS (SELECT tmref_cat, a, b, max(md) AS dist, sum(n) AS cn, sum(sy) AS csy FROM (
    SELECT *, min(dist) OVER (PARTITION BY tmref_cat, a, b) AS md FROM pr) WHERE dist<=md+1e-9 GROUP BY 1,2,3)""",
                            rounds="att mean_dist"))
def _(spark, d):
    o = timed(spark, d).withColumn("treat", threshold_flag("left1", 8))
    return causal.match_att(o, "delay", "treat", ["ride", "menu_num"], weights={"menu_num": 2.0},
                            blocks=["tmref_cat"])


# treatment on daypart alone: the fitted probability is each daypart's share, and the weighted
# regression on treatment and dayparts is one within dayparts
_FITTED = """s AS (SELECT *, CAST(left1>=8 AS INT) AS treat, avg(CAST(left1>=8 AS INT)) OVER (PARTITION BY tmref_cat) AS p FROM timed),
  w AS (SELECT *, CASE WHEN treat=1 THEN 1/p ELSE 1/(1-p) END AS w FROM s),
  v AS (SELECT w, treat-sum(w*treat) OVER g/sum(w) OVER g AS t, delay-sum(w*delay) OVER g/sum(w) OVER g AS y FROM w
    WINDOW g AS (PARTITION BY tmref_cat)),
  q AS (SELECT sum(w*t*y)/sum(w*t*t) AS b, sum(w*t*t) AS stt, count(*) AS n FROM v)"""


@query("m08_ipw_fitted", sql("""SELECT 'treat' AS term, any_value(b) AS estimate,
  sqrt(any_value(n)/(any_value(n)-4e0)*sum(pow(w*t*(y-b*t), 2)))/any_value(stt) AS std_error, any_value(n) AS n FROM v, q""",
                             "timed", _FITTED, rounds="estimate std_error"))
def _(spark, d):
    o, added = reg.design_columns(timed(spark, d).withColumn("treat", threshold_flag("left1", 8)), {"tmref_cat": ["dinner", "lunch", "other"]})
    return robust.ipw_effect(o, "delay", "treat", added).filter(c("term") == "treat").select("term", "estimate", "std_error", "n")


_CHAIN = ["prepare", "price", "ride", "rider_income", "menu_num", "dist"]


@query("m08_propensity_scores", "SELECT unnest(['(Intercept)', 'prepare', 'price', 'ride', 'rider_income', 'menu_num', 'dist']) AS term, "
                                "true AS solved, true AS converged, false AS separated", digits=4)
def _(spark, d):
    """The fit on continuous covariates solves the score equations."""
    coefs, _ = robust.logit_irls(routed(spark, d), "treat", _CHAIN)
    return coefs.select("term", (c("score") < 1e-6).alias("solved"), "converged", "separated")


@query("m08_ipw_chain", digits=4)
def _(spark, d):
    """Covariates to fitted propensity to weighted effect with clustered errors."""
    return robust.ipw_effect(routed(spark, d), "delay", "treat", _CHAIN, cluster="rider_id")


_MATCH = """x AS (SELECT *, CAST(left1>=8 AS INT) AS treat, CAST(tmref_cat='lunch' AS INT) AS catlunch,
    CAST(tmref_cat='other' AS INT) AS catother FROM timed JOIN dist d USING (id) WHERE d.dist IS NOT NULL),
  sd AS (SELECT {sds} FROM x),
  z AS (SELECT row_number() OVER (ORDER BY id) AS i, {block} AS blk, treat, delay, {raw}, {zs} FROM x, sd),
  pr AS (SELECT t.i, u.i AS j, u.delay AS dj, sqrt({apart}) AS dist FROM z t JOIN z u ON t.blk=u.blk WHERE t.treat=1 AND u.treat=0),
  mt AS (SELECT i, j, dj, dist, 1e0/count(*) OVER (PARTITION BY i) AS w FROM (
    SELECT *, min(dist) OVER (PARTITION BY i) AS md FROM pr) WHERE dist<=md+1e-9),
  ef AS (SELECT z.i, any_value(delay)-sum(w*dj) AS e, min(mt.dist) AS dist FROM z JOIN mt USING (i) GROUP BY 1),
  us AS (SELECT j, sum(w) AS k, sum(w*w) AS kk FROM mt GROUP BY 1)"""


def _matching(xs: list[str], block: str = "0", weights: dict[str, float] = {}) -> str:  # noqa: B006
    """CTEs of matching by all pairs inside a block."""
    return _MATCH.format(
        sds=", ".join(f"stddev_samp({x}::DOUBLE) AS s{k}" for k, x in enumerate(xs)), block=block,
        raw=", ".join(f"{x}::DOUBLE AS {x}" for x in xs),
        zs=", ".join(f"{x}::DOUBLE/s{k}*sqrt({weights.get(x, 1.0)}e0) AS z{k}" for k, x in enumerate(xs)),
        apart="+".join(f"(t.z{k}-u.z{k})*(t.z{k}-u.z{k})" for k in range(len(xs))))


def _sides(spark, d):
    return routed(spark, d).filter(c("dist").isNotNull())


@query("m09_match_se", sql("""SELECT avg(e) AS att, (sqrt(sum((e-m)*(e-m)) + any_value(v))/count(*)) AS std_error,
  avg(e)/(sqrt(sum((e-m)*(e-m)) + any_value(v))/count(*)) AS t_value, count(*) AS matched
  FROM (SELECT *, avg(e) OVER () AS m FROM ef), (SELECT sum((k*k-kk)*s2) AS v FROM us JOIN cv USING (j))""", "timed dist",
                           _matching(["ride", "menu_num"], "tmref_cat", {"menu_num": 2.0}) + """,
  cp AS (SELECT t.i AS j, t.delay, u.delay AS dj, sqrt((t.z0-u.z0)*(t.z0-u.z0)+(t.z1-u.z1)*(t.z1-u.z1)) AS dist
    FROM (SELECT * FROM z WHERE i IN (SELECT j FROM us)) t JOIN z u ON t.blk=u.blk AND t.i<>u.i WHERE u.treat=0),
  cv AS (SELECT j, count(*)/(count(*)+1e0)*pow(any_value(delay)-avg(dj), 2) AS s2 FROM (
    SELECT *, min(dist) OVER (PARTITION BY j) AS md FROM cp) WHERE dist<=md+1e-9 GROUP BY 1)""", rounds="att std_error t_value"))
def _(spark, d):
    return causal.match_error(_sides(spark, d), "delay", "treat", ["ride", "menu_num"], {"menu_num": 2.0}, ["tmref_cat"])


_NINE = ["prepare", "price", "catlunch", "catother", "prereq", "ride", "rider_income", "menu_num", "dist"]


@query("m09_match_nine", sql("""SELECT avg(e) AS att, count(*) AS matched, 0::BIGINT AS unmatched, avg(dist) AS mean_dist FROM ef""",
                             "timed dist", _matching(_NINE), rounds="att mean_dist"))
def _(spark, d):
    o, _ = reg.design_columns(_sides(spark, d), {"tmref_cat": ["dinner", "lunch", "other"]})
    return causal.match_att(o.withColumnsRenamed({"tmref_catlunch": "catlunch", "tmref_catother": "catother"}), "delay", "treat", _NINE)


_MOVED = """SELECT '{s}' AS "sample", '{x}' AS "column", avg(v) FILTER (treat=1) AS mean_treated, m0 AS mean_control,
  avg(v) FILTER (treat=1)-m0 AS mean_diff, (avg(v) FILTER (treat=1)-m0)/stddev_samp(v) FILTER (treat=1) AS std_diff,
  var_samp(v) FILTER (treat=1)/(sum(w*(v-m0)*(v-m0)) FILTER (treat=0)/(sum(w) FILTER (treat=0)-1)) AS var_ratio, any_value(ks) AS ks
  FROM (SELECT *, (sum(w*v) FILTER (treat=0) OVER ())/(sum(w) FILTER (treat=0) OVER ()) AS m0 FROM (SELECT treat, {x} AS v, {w} AS w FROM {t}) WHERE w>0),
  (SELECT max(abs(c1-c0)) AS ks FROM (SELECT sum(n1) OVER (ORDER BY v)/sum(n1) OVER () AS c1, sum(n0) OVER (ORDER BY v)/sum(n0) OVER () AS c0
   FROM (SELECT {x} AS v, coalesce(sum({w}) FILTER (treat=1), 0) AS n1, coalesce(sum({w}) FILTER (treat=0), 0) AS n0 FROM {t} GROUP BY 1))) GROUP BY m0"""
_USED = "(SELECT z.*, coalesce(k, 0e0) AS k FROM z LEFT JOIN us ON us.j=z.i)"


@query("m10_balance_matched", sql(" UNION ALL ".join(
    f"({_MOVED.format(s=s, x=x, w=w, t=t)})" for x in ("ride", "menu_num")
    for s, w, t in (("before", "1e0", "z"), ("after", "CASE WHEN treat=1 THEN 1e0 ELSE k END", _USED))),
    "timed dist", _matching(["ride", "menu_num"], "tmref_cat"), rounds="mean_treated mean_control mean_diff std_diff var_ratio ks"))
def _(spark, d):
    return causal.balance_matched(_sides(spark, d), "delay", "treat", ["ride", "menu_num"], blocks=["tmref_cat"])


def _bal(x: str) -> str:
    return f"""SELECT '{x}' AS "column", avg({x}) FILTER (treat=1) AS mean_treated, avg({x}) FILTER (treat=0) AS mean_control,
  avg({x}) FILTER (treat=1)-avg({x}) FILTER (treat=0) AS mean_diff,
  (avg({x}) FILTER (treat=1)-avg({x}) FILTER (treat=0))/stddev_samp({x}) FILTER (treat=1) AS std_diff,
  var_samp({x}) FILTER (treat=1)/var_samp({x}) FILTER (treat=0) AS var_ratio,
  (SELECT max(abs(c1-c0)) FROM (SELECT sum(n1) OVER (ORDER BY v)/sum(n1) OVER ()::DOUBLE AS c1,
   sum(n0) OVER (ORDER BY v)/sum(n0) OVER ()::DOUBLE AS c0 FROM (SELECT {x} AS v, count(*) FILTER (treat=1) AS n1,
   count(*) FILTER (treat=0) AS n0 FROM p GROUP BY 1))) AS ks FROM p"""


@query("m10_balance", sql(_bal("prepare") + " UNION ALL " + _bal("price"), "timed", _P,
                          rounds="mean_treated mean_control mean_diff std_diff var_ratio ks"))
def _(spark, d):
    return causal.balance(timed(spark, d).withColumn("treat", threshold_flag("left1", 8)), "treat", ["prepare", "price"])


@query("m11_pca", digits=4)
def _(spark, d):
    return learners.pca(routed(spark, d).dropna(subset=["dist"]),
                        ["prereq", "prepare", "ride", "time", "dist", "price", "rider_income"], 3)


def _users(spark, d):
    from ..operators.aggregates import user_profile
    from ..operators.windows import zscore
    cols = ["u_n_tt", "u_rinc_avg", "u_price_avg"]
    users = zscore(user_profile(meal_orders(spark, d)).select("user_id", *cols), cols)
    return users, [f"{x}_z" for x in cols]


@query("m12_kmeans")
def _(spark, d):
    users, cols = _users(spark, d)
    return learners.cluster_sizes(learners.kmeans(users, cols, 5, seed=715))


@query("m13_k_selection", digits=3)
def _(spark, d):
    users, cols = _users(spark, d)
    return clusters.k_selection(users, cols, [2, 5, 9], seed=715)


@query("m13_centres", sql("""SELECT unnest([2, 5, 9]) AS k, unnest([2, 5, 9])::BIGINT AS clusters,
  (SELECT count(*) FROM (SELECT user_id FROM meal_orders GROUP BY 1 HAVING count(price)>0 AND count(rider_income)>0)) AS n,
  true AS centred, true AS counted, true AS converged""", "meal_orders"))
def _(spark, d):
    """Every centre is the mean of the points nearest to it, and its count is theirs."""
    users, cols = _users(spark, d)
    users = stage_shared(users, "users")
    fit = stage_shared(clusters.kmeans_many(users, cols, [2, 5, 9], seed=715), "centres")
    held = fit.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("cluster", *cols))).alias("cs"))
    held = held.agg(F.map_from_entries(F.collect_list(F.struct("k", "cs")))).scalar()  # sixteen centres
    apart = lambda p: sum(((p[x] - c(x)) * (p[x] - c(x)) for x in cols), F.lit(0.0))
    near = (users.dropna(subset=cols).select(*cols, F.explode(held).alias("k", "cs"))
            .withColumn("cluster", F.array_min(F.transform("cs", lambda p: F.struct(apart(p).alias("d"), p["cluster"].alias("j"))))["j"]))
    means = near.groupBy("k", "cluster").agg(F.count(F.lit(1)).alias("m"), *[F.avg(x).alias(f"_{x}") for x in cols])
    off = F.greatest(*[F.abs(c(x) - c(f"_{x}")) for x in cols])
    return fit.join(means, ["k", "cluster"], "left").groupBy("k").agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("n"), F.min(off < 1e-5).alias("centred"),
        F.min(c("n") == c("m")).alias("counted"), F.min("converged").alias("converged"))


def incomes(spark, d, threshold=2600):
    """Moving orders with the month's running income of all orders and days left."""
    lunch, dinner = meal_hours("require_tm")
    every = stage_shared(rider_month_running(stage_shared(timed(spark, d), "timed"), threshold=threshold), "incomes")
    return (stage_shared(moving(spark, d, every), "moving")
            .withColumn("remain_days", days_left("finish_tm"))
            .withColumn("lunch_hr", lunch).withColumn("dinner_hr", dinner))


# income, rank and month flags of all orders come first, the validity filter after
_INC = """inc0 AS (SELECT id AS oid, CAST(sum(rider_income) OVER w AS BIGINT) AS inc_atm,
  CAST(sum(rider_income+300) OVER w AS BIGINT) AS sinc_atm, rider_id AS r, year(finish_tm) AS y, month(finish_tm) AS month
  FROM timed WINDOW w AS (PARTITION BY rider_id, year(finish_tm), month(finish_tm) ORDER BY finish_tm, id ROWS UNBOUNDED PRECEDING)),
  inc1 AS (SELECT *, max(inc_atm) OVER (PARTITION BY r, y, month)/100e0>2600 AS excel_month,
    max(sinc_atm) OVER (PARTITION BY r, y, month)/100e0>2600 AS sexcel_month FROM inc0),
  inc AS (SELECT m.*, inc_atm, sinc_atm, month, excel_month, sexcel_month,
    day(last_day(CAST(finish_tm AS DATE)))-day(finish_tm) AS remain_days, speed*onhand AS speed_wt,
    hour(require_tm) BETWEEN 10 AND 13 AS lunch_hr, hour(require_tm) BETWEEN 17 AND 19 AS dinner_hr
    FROM moving m JOIN inc1 ON inc1.oid=m.id),
  thr AS (SELECT i.*, w.w AS "window", inc_atm/100e0>=2600 AS over FROM inc i, (VALUES (3),(5),(7)) AS w(w)
  WHERE remain_days<=w.w AND inc_atm/100e0>=2600-100*w.w AND inc_atm/100e0<2600+100*w.w
  AND rider_id IN (SELECT rider_id FROM inc WHERE inc_atm/100e0>=2600))"""


@query("m14_threshold_windows", sql("""SELECT "window", over, count(*) AS n, min(speed_wt) AS min, quantile_cont(speed_wt,0.25) AS p25,
  quantile_cont(speed_wt,0.5) AS median, avg(speed_wt) AS mean, quantile_cont(speed_wt,0.75) AS p75, max(speed_wt) AS max,
  count(*)-count(speed_wt) AS nulls FROM thr GROUP BY 1,2""", "moving", _INC, rounds="min p25 median mean p75 max"))
def _(spark, d):
    return causal.threshold_windows(incomes(spark, d), cut=2600)


@query("m14_threshold_meals", sql("""SELECT "window", over, lunch_hr, dinner_hr, count(*) AS n FROM thr GROUP BY 1,2,3,4""",
                                  "moving", _INC))
def _(spark, d):
    return causal.threshold_meal_counts(incomes(spark, d), cut=2600)


@query("m14_threshold_fe", digits=12)
def _(spark, d):
    return causal.threshold_fe(incomes(spark, d), cut=2600).select("window", "term", "estimate", "std_error", "n", "df_resid")


@query("m14_threshold_passed", sql("""SELECT "window", 'passed' AS term, regr_slope(y,x) AS estimate,
  sqrt(regr_syy(y,x)*(1-regr_r2(y,x))/(count(*)-1-count(DISTINCT rider_id))/regr_sxx(y,x)) AS std_error, count(*) AS n FROM (
  SELECT "window", rider_id, speed_wt-avg(speed_wt) OVER w AS y, p-avg(p) OVER w AS x FROM (
    SELECT *, (inc_atm/100e0>2600)::INT AS p FROM thr WHERE speed_wt IS NOT NULL) WINDOW w AS (PARTITION BY "window", rider_id))
  GROUP BY 1""", "moving", _INC, rounds="estimate std_error", digits=4), digits=4)
def _(spark, d):
    rows = causal.threshold_rows(incomes(spark, d), cut=2600).withColumn("passed", (c("inc_atm") / 100 > 2600).cast("int"))
    return reg.fe_ols(rows, "speed_wt", ["passed"], "rider_id", by=["window"]).select("window", "term", "estimate", "std_error", "n")


@query("m15_discontinuity", sql("""SELECT 'jump' AS term, max(a) FILTER (side=1) - max(a) FILTER (side=0) AS estimate,
  CAST(sum(n) AS BIGINT) AS n FROM (SELECT side, n, (swy-(swxy-swx*swy/sw)/(swxx-swx*swx/sw)*swx)/sw AS a FROM (
  SELECT CAST(x>=0 AS INT) AS side, count(*) AS n, sum(w) AS sw, sum(w*x) AS swx, sum(w*delay) AS swy, sum(w*x*delay) AS swxy,
  sum(w*x*x) AS swxx FROM (SELECT delay, dist-2000e0 AS x, 1-abs(dist-2000e0)/600e0 AS w FROM timed JOIN dist USING (id))
  WHERE w>0 GROUP BY 1))""", "timed dist", rounds="estimate"))
def _(spark, d):
    return reg.rd_estimate(routed(spark, d), "delay", "dist", 2000, 600).filter(c("term") == "jump").select(
        "term", "estimate", "n")


@query("m15_discontinuity_robust", sql("""SELECT 'jump' AS term, max(a) FILTER (side=1) - max(a) FILTER (side=0) AS estimate,
  sqrt(sum(n)/(sum(n)-4e0)*sum(v)) AS std_error, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT side, any_value(a) AS a, count(*) AS n, sum(pow(w*(delay-a-b*x)*(1/sw-mx*(x-mx)/sxx), 2)) AS v FROM r JOIN k USING (side) GROUP BY 1)""",
                                       "timed dist", """r AS (SELECT delay, dist-2000e0 AS x, CAST(dist>=2000 AS INT) AS side,
  1-abs(dist-2000e0)/600e0 AS w FROM timed JOIN dist USING (id) WHERE abs(dist-2000e0)<600e0),
  k AS (SELECT *, swy/sw-b*mx AS a FROM (SELECT side, sw, swy, swx/sw AS mx, swxx-swx*swx/sw AS sxx, (swxy-swx*swy/sw)/(swxx-swx*swx/sw) AS b
    FROM (SELECT side, sum(w) AS sw, sum(w*x) AS swx, sum(w*delay) AS swy, sum(w*x*delay) AS swxy, sum(w*x*x) AS swxx FROM r GROUP BY 1)))""",
                                       rounds="estimate std_error"))
def _(spark, d):
    return reg.rd_estimate(routed(spark, d), "delay", "dist", 2000, 600, fit=robust.ols_robust).filter(c("term") == "jump").select(
        "term", "estimate", "std_error", "n")


@query("m16_ols_by_hour", sql(_FIT1.format(g="hour,", x="prereq", t="fit", n="n"), "timed", """fit AS (SELECT hour(require_tm) AS hour, regr_slope(delay,prereq) AS b,
  regr_intercept(delay,prereq) AS a, avg(prereq) AS mx, regr_sxx(delay,prereq) AS sxx, count(*) AS n,
  regr_syy(delay,prereq)*(1-regr_r2(delay,prereq))/(count(*)-2) AS s2, regr_r2(delay,prereq) AS r2 FROM timed GROUP BY 1)""",
                              rounds="estimate std_error t_value r2", digits=4), digits=4)
def _(spark, d):
    return reg.ols(timed(spark, d).withColumn("hour", F.hour("require_tm")), "delay", ["prereq"], by=["hour"]).drop("p_value")


_CONTRAST = """SELECT {flag}, {inc}/100e0>=2600 AS past, count(*) AS n, min({v}) AS min,
  quantile_cont({v},0.25) AS p25, quantile_cont({v},0.5) AS median, avg({v}) AS mean, quantile_cont({v},0.75) AS p75,
  max({v}) AS max, count(*)-count({v}) AS nulls FROM inc GROUP BY 1,2"""


def _contrast(name, value, running, flag):
    @query(name, sql(_CONTRAST.format(flag=flag, inc=running, v=value), "moving", _INC,
                     rounds="min p25 median mean p75 max"))
    def _(spark, d):
        return causal.threshold_contrast(incomes(spark, d), value, running=running, month_flag=flag, cut=2600)


_contrast("m17_threshold_contrast", "speed", "inc_atm", "excel_month")
_contrast("m17_contrast_subsidised", "speed", "sinc_atm", "sexcel_month")
_contrast("m17_contrast_bdunexp", "bdunexp", "inc_atm", "excel_month")
_contrast("m17_contrast_bdunexp_subsidised", "bdunexp", "sinc_atm", "sexcel_month")


def _two_way(name, running, flag):
    @query(name, sql(f"SELECT {flag}, {running}/100e0>=2600 AS past, count(*) AS n FROM inc GROUP BY 1,2", "moving", _INC))
    def _(spark, d):
        return causal.threshold_table(incomes(spark, d), running=running, month_flag=flag, cut=2600)


_two_way("m17_table", "inc_atm", "excel_month")
_two_way("m17_table_subsidised", "sinc_atm", "sexcel_month")
