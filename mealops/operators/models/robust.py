"""Errors that do not assume equal variances, and the chain from propensity to weighted effect.

A fit reads its rows twice: once for the moments, once for the products of the scores (residual
times centred column times weight), summed per row or first per cluster. What reaches the driver
is k + 1 numbers and a (k + 1) square matrix.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...sources.sinks import stage_shared
from .causal import ipw_weights
from .moments import COEF_FIELDS, _doubles, _pairs, coef_rows, invert, moments, square
from .regression import INTERCEPT

_COEF = T.StructType([T.StructField(n, t) for n, t in COEF_FIELDS])


def _fit(row, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slopes, the inverse scatter, the kept columns and the centre of one moment row."""
    s, mean = square(row["_cross"], k + 1), np.array(row["_mean"])
    inv, kept = invert(s[:k, :k])
    return inv @ s[:k, k], inv, kept, mean


def ols_robust(df: DataFrame, y: str, xs: list[str], weight: str | None = None, cluster: str | None = None) -> DataFrame:
    """(Weighted) least squares with heteroskedasticity-robust errors (n / (n - p) times the
    sandwich), or errors clustered by a column (times G / (G - 1) * (n - 1) / (n - p)). Rows
    with a NULL in a used column, the cluster included, or without positive weight are left
    out; ``a:b`` is a product."""
    xs, k = list(xs), len(xs)
    rows = _doubles(df, [cluster] if cluster else [], [*xs, y], weight)
    rows = rows.dropna(subset=[cluster]) if cluster else rows
    rows = stage_shared(rows.filter("_w > 0") if weight else rows, "design")
    cols = [f"_x{i}" for i in range(k + 1)]
    m = moments(rows, cols, weight="_w" if weight else None).first()
    n = int(m["_n"])
    if not n:
        return df.sparkSession.createDataFrame([], _COEF)
    beta, inv, kept, mean = _fit(m, k)
    centred = [F.col(c) - float(v) for c, v in zip(cols, mean)]
    resid = centred[k]
    for b, c in zip(beta, centred):
        resid = resid - float(b) * c
    e = resid * F.col("_w") if weight else resid
    scores = rows.select(*([cluster] if cluster else []), e.alias("_s0"), *[(e * c).alias(f"_s{i + 1}") for i, c in enumerate(centred[:k])],
                         (e * resid).alias("_rss"))
    s = [f"_s{i}" for i in range(k + 1)]
    if cluster:
        scores = scores.groupBy(cluster).agg(*[F.sum(c).alias(c) for c in s], F.sum("_rss").alias("_rss"))
    meat = scores.agg(F.count(F.lit(1)).alias("g"), F.sum("_rss").alias("rss"),
                      F.array(*[F.sum(F.col(s[i]) * F.col(s[j])) for i, j in _pairs(k + 1)]).alias("m")).first()
    p = int(kept.sum()) + 1
    groups, df_resid = int(meat["g"]), n - p
    if df_resid <= 0 or (cluster and groups < 2):
        variance = np.full((k + 1, k + 1), np.nan)
    else:
        scale = groups / (groups - 1) * (n - 1) / df_resid if cluster else n / df_resid
        to = np.block([[np.array([[1 / m["_sw"]]]), -(mean[:k] @ inv)[None, :]], [np.zeros((k, 1)), inv]])
        variance = scale * to @ square(meat["m"], k + 1) @ to.T
    total = square(m["_cross"], k + 1)[k, k]
    out = coef_rows([INTERCEPT, *xs], np.r_[mean[k] - beta @ mean[:k], beta], np.diag(variance), np.r_[True, kept], n,
                    groups - 1 if cluster else df_resid, 1 - meat["rss"] / total if total > 0 else None)
    plain = [tuple(v.item() if isinstance(v, np.generic) else v for v in row) for row in out]
    return df.sparkSession.createDataFrame(plain, _COEF)


def _linear(beta: dict[str, float], names: list[str]) -> Column:
    out = F.lit(beta[INTERCEPT])
    for x in names:
        if beta[x] is not None:
            out = out + F.lit(beta[x]) * F.col(x)
    return out


def logit_irls(df: DataFrame, y: str, xs: list[str], max_iter: int = 30, tol: float = 1e-10) -> tuple[DataFrame, DataFrame]:
    """Binomial regression by reweighted moments: (coefficient table, rows of ``df`` with a value
    in every used column and the fitted probability ``fit``). Each round is one aggregate over
    the rows. The table says how many rounds there were, whether they ``converged``, the largest
    score ``score`` left (per row), and whether the arms are ``separated``: some fitted
    probability runs into 0 or 1, so that no finite coefficient exists."""
    xs, spark = list(xs), df.sparkSession
    rows = stage_shared(df.dropna(subset=[y, *xs]), "logit")
    t = F.col(y).cast("double")
    names = [f"_l{i}" for i in range(len(xs))]
    work = rows.select(t.alias("_t"), *[F.col(x).cast("double").alias(n) for x, n in zip(xs, names)])
    share = work.agg(F.avg("_t")).first()[0]
    beta = {INTERCEPT: 0.0, **dict.fromkeys(names, 0.0)}
    done = {"rounds": 0, "converged": False, "separated": share in (None, 0.0, 1.0)}
    inv = np.zeros((len(xs) + 1,) * 2)
    p_of = lambda: 1 / (1 + F.exp(-F.greatest(F.least(_linear(beta, names), F.lit(35.0)), F.lit(-35.0))))
    while not done["separated"] and not done["converged"] and done["rounds"] < max_iter:
        p = p_of()
        w = p * (1 - p)
        target = _linear(beta, names) + (F.col("_t") - p) / w
        m = moments(work.select(*names, target.alias("_z"), w.alias("_wt")), [*names, "_z"], weight="_wt").first()
        slope, inv_s, kept, mean = _fit(m, len(xs))
        new = {INTERCEPT: float(mean[-1] - slope @ mean[:-1]), **{n: float(b) if ok else None for n, b, ok in zip(names, slope, kept)}}
        moved = max(abs((new[c] or 0.0) - (beta[c] or 0.0)) / (abs(new[c] or 0.0) + 0.1) for c in new)
        centre = mean[:-1]
        inv = np.block([[np.array([[1 / m["_sw"] + centre @ inv_s @ centre]]), -(centre @ inv_s)[None, :]],
                        [-(inv_s @ centre)[:, None], inv_s]])
        beta = new
        far = work.agg(F.max(F.abs(_linear(beta, names)))).first()[0]
        done |= {"rounds": done["rounds"] + 1, "converged": moved < tol, "separated": far > 30}
    p = p_of()
    left = work.agg(*[F.abs(F.avg((F.col("_t") - p) * (F.col(c) if c else F.lit(1.0)))) for c in (None, *names)]).first()
    table = [(term, None if beta[c] is None else float(beta[c]), None if beta[c] is None or done["separated"] else float(np.sqrt(max(v, 0.0))),
              None if s is None else float(s), done["rounds"], done["converged"], done["separated"])
             for term, c, v, s in zip([INTERCEPT, *xs], beta, np.diag(inv), left)]
    coefs = spark.createDataFrame(table, "term string, estimate double, std_error double, score double, iterations int, "
                                         "converged boolean, separated boolean")
    at = F.lit(beta[INTERCEPT])
    for x, c in zip(xs, names):
        if beta[c] is not None:
            at = at + F.lit(beta[c]) * F.col(x).cast("double")
    return coefs, rows.withColumn("fit", 1 / (1 + F.exp(-at)))


def ipw_effect(df: DataFrame, y: str, treat: str, xs: list[str], cluster: str | None = None) -> DataFrame:
    """From covariates to effect: the fitted propensity, inverse probability weights, and the
    weighted regression of the outcome on treatment and the covariates with sandwich errors.
    Separated arms raise an error, for their weights have no bound."""
    coefs, fitted = logit_irls(df, treat, xs)
    if coefs.filter("separated").head(1):
        raise ValueError("the covariates separate the arms: no finite propensity exists")
    return ols_robust(ipw_weights(fitted, treat, "fit", "_ipw"), y, [treat, *xs], weight="_ipw", cluster=cluster)
