"""OLS, weighted, fixed-effects, instrumental-variable, discontinuity and Huber regression.

Every function returns a lazy coefficient table (one row per group and term).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...sources.sinks import stage_shared
from ..quantiles import exact_quantiles
from .moments import (COEF_FIELDS, coef_rows, invert, merged_case, moments, moments_by_cases, solve_rows,
                      square, within_moments)

INTERCEPT = "(Intercept)"


def design_columns(df: DataFrame, factors: dict[str, list] = (), interactions: list[str] = (),
                   complete: list[str] = ()) -> tuple[DataFrame, list[str]]:
    """Model columns: 0/1 dummies for every factor level but the first (levels given in
    order, named ``<factor><level>``, dots as underscores) and products for ``a:b``; optionally complete cases.
    Returns the frame and the names it added."""
    added: list[str] = []
    for name, levels in dict(factors).items():
        c = F.col(name)
        for level in list(levels)[1:]:
            dummy = f"{name}{level}".replace(".", "_")
            df = df.withColumn(dummy, F.when(c.isNotNull(), (c == F.lit(level)).cast("int")))
            added.append(dummy)
    for term in interactions:
        out = None
        for part in term.split(":"):
            c = F.col(part).cast("double")
            out = c if out is None else out * c
        df = df.withColumn(term.replace(":", "_x_"), out)
        added.append(term.replace(":", "_x_"))
    return (df.dropna(subset=list(complete)) if complete else df), added


def crossed(*names: str) -> list[str]:
    """All main effects and interactions of the names (``a*b*c``)."""
    out: list[str] = []
    for name in names:
        out += [name] + [f"{t}:{name}" for t in out]
    return sorted(out, key=lambda t: t.count(":"))


def ols(df: DataFrame, y: str, xs: list[str], by: list[str] = (), weight: str | None = None) -> DataFrame:
    """(Weighted) least squares with intercept, per group of ``by``. ``a:b`` is a product."""
    xs, k = list(xs), len(xs)

    def solve(row: pd.Series) -> list[tuple]:
        return _least_squares(xs, square(row["_cross"], k + 1), np.array(row["_mean"]), int(row["_n"]), row["_sw"])

    return solve_rows(moments(df, [*xs, y], by, weight), by, solve)


def _least_squares(xs: list[str], s: np.ndarray, mean: np.ndarray, n: int, sw: float) -> list[tuple]:
    """Coefficient rows from the moments of the regressors and, last, the outcome."""
    k = len(xs)
    inv, kept = invert(s[:k, :k])
    beta = inv @ s[:k, k]
    df_resid = n - int(kept.sum()) - 1
    rss = max(s[k, k] - beta @ s[:k, k], 0.0)
    sigma2 = rss / df_resid if df_resid > 0 else 0.0
    r2 = 1 - rss / s[k, k] if s[k, k] > 0 else None
    full_b = np.r_[mean[k] - beta @ mean[:k], beta]
    full_v = sigma2 * np.r_[1 / sw + mean[:k] @ inv @ mean[:k], np.diag(inv)]
    return coef_rows([INTERCEPT, *xs], full_b, full_v, np.r_[True, kept], n, df_resid, r2)


def ols_specs(df: DataFrame, y: str, specs: dict[str, list[str]], by: list[str] = (),
              weight: str | None = None) -> DataFrame:
    """Several specifications side by side, each on its own complete cases.

    Rows are read once for all of them: their moments are kept apart by the specifications a
    row is complete for, and each specification merges the parts that count for it. One
    without complete rows has no rows in the result."""
    specs = {name: list(xs) for name, xs in specs.items()}
    cols = list(dict.fromkeys([*(x for xs in specs.values() for x in xs), y]))
    needs = [[*xs, y] for xs in specs.values()]

    def solve(row: pd.Series) -> list[tuple]:
        rows = []
        for i, (name, xs) in enumerate(specs.items()):
            s, mean, n, sw = merged_case(row, i, cols, needs[i])
            rows += [(*r, name) for r in (_least_squares(xs, s, mean, n, sw) if n else [])]
        return rows

    return solve_rows(moments_by_cases(df, cols, needs, by, weight), by, solve, [*COEF_FIELDS, ("spec", T.StringType())])


def fe_ols(df: DataFrame, y: str, xs: list[str], group: str, by: list[str] = ()) -> DataFrame:
    """Group fixed effects: slopes equal least squares with one dummy per group; the lost
    degrees of freedom are counted. Rows are read once and never demeaned one by one."""
    xs, k = list(xs), len(xs)

    def solve(row: pd.Series) -> list[tuple]:
        s, n = square(row["_cross"], k + 1), int(row["_n"])
        inv, kept = invert(s[:k, :k])
        beta = inv @ s[:k, k]
        df_resid = n - int(kept.sum()) - int(row["_groups"])
        rss = max(s[k, k] - beta @ s[:k, k], 0.0)
        sigma2 = rss / df_resid if df_resid > 0 else 0.0
        return coef_rows(xs, beta, sigma2 * np.diag(inv), kept, n, df_resid,
                         1 - rss / s[k, k] if s[k, k] > 0 else None)

    return solve_rows(within_moments(df, [*xs, y], group, by), by, solve)


def iv_2sls(df: DataFrame, y: str, endog: list[str], exog: list[str], instruments: list[str],
            by: list[str] = ()) -> DataFrame:
    """Two-stage least squares. Exogenous columns instrument themselves; more instruments
    than endogenous columns are allowed. Errors use the structural residuals."""
    xs, zs = [*endog, *exog], [*instruments, *exog]
    cols = list(dict.fromkeys([*xs, *zs, y]))
    ix, iz, iy = [cols.index(c) for c in xs], [cols.index(c) for c in zs], cols.index(y)

    def solve(row: pd.Series) -> list[tuple]:
        s, mean, n = square(row["_cross"], len(cols)), np.array(row["_mean"]), int(row["_n"])
        zz_inv, _ = invert(s[np.ix_(iz, iz)])
        zx, zy = s[np.ix_(iz, ix)], s[iz, iy]
        inv, kept = invert(zx.T @ zz_inv @ zx)
        beta = inv @ (zx.T @ zz_inv @ zy)
        rss = s[iy, iy] - 2 * beta @ s[ix, iy] + beta @ s[np.ix_(ix, ix)] @ beta
        df_resid = n - int(kept.sum()) - 1
        sigma2 = rss / df_resid if df_resid > 0 else 0.0
        mx = mean[ix]
        full_b = np.r_[mean[iy] - beta @ mx, beta]
        full_v = sigma2 * np.r_[1 / n + mx @ inv @ mx, np.diag(inv)]
        return coef_rows([INTERCEPT, *xs], full_b, full_v, np.r_[True, kept], n, df_resid,
                         1 - rss / s[iy, iy] if s[iy, iy] > 0 else None)

    return solve_rows(moments(df, cols, by), by, solve)


def rd_estimate(df: DataFrame, y: str, running: str, cut: float, bandwidth: float, fit=None, **how) -> DataFrame:
    """Sharp regression discontinuity: triangular kernel, a line on each side within the
    given bandwidth; the ``jump`` term is the estimate. Errors are model-based by default;
    ``fit=robust.ols_robust`` makes them robust or, with ``cluster``, clustered."""
    x = F.col(running).cast("double") - float(cut)
    side = (x >= 0).cast("int")
    local = (df.withColumn("jump", side).withColumn("slope", x).withColumn("slope_change", x * side)
             .withColumn("_kernel", 1 - F.abs(x) / float(bandwidth)).filter(F.col("_kernel") > 0))
    return (fit or ols)(local, y, ["jump", "slope", "slope_change"], weight="_kernel", **how)


def _index(coefs: dict[str, float], xs: list[str]):
    out = F.lit(coefs[INTERCEPT])
    for x in xs:
        if coefs.get(x) is not None:
            term = None
            for part in x.split(":"):
                c = F.col(part).cast("double")
                term = c if term is None else term * c
            out = out + F.lit(coefs[x]) * term
    return out


def huber(df: DataFrame, y: str, xs: list[str], k: float = 1.345, max_iter: int = 20,
          tol: float = 1e-4) -> DataFrame:
    """Huber M-estimation by reweighted least squares with the scale from the median
    absolute residual. Each round is one quantile job and one moment pass over the staged
    narrow columns; only the k coefficients come to the driver. ``iterations`` and
    ``converged`` say whether ``max_iter`` rounds were enough."""
    xs = list(xs)
    parts = list(dict.fromkeys(p for x in xs for p in x.split(":")))
    data = df.select(F.col(y).cast("double").alias(y), *parts).dropna()
    data = stage_shared(data, "huber")
    coefs = {r["term"]: r["estimate"] for r in ols(data, y, xs).collect()}
    scale, rounds, converged = 0.0, 0, False
    while rounds < max_iter and not converged:
        resid = data.withColumn("_e", F.col(y) - _index(coefs, xs))
        mad = exact_quantiles(resid.withColumn("_a", F.abs("_e")), [], "_a", {"m": 0.5}).first()["m"]
        scale = mad / 0.6745
        if scale == 0:
            converged = True
            break
        weighted = resid.withColumn("_hw", F.least(F.lit(1.0), F.try_divide(F.lit(k * scale), F.abs("_e"))))
        rows = ols(weighted.withColumn("_hw", F.coalesce("_hw", F.lit(1.0))), y, xs, weight="_hw").collect()
        new = {r["term"]: r["estimate"] for r in rows}
        moved = max(abs((new[t] or 0) - (coefs[t] or 0)) / (abs(coefs[t] or 0) + 1e-12) for t in coefs)
        coefs, rounds, converged = new, rounds + 1, moved < tol
    out = [(t, b, float(scale), rounds, converged) for t, b in coefs.items()]
    return df.sparkSession.createDataFrame(
        out, "term string, estimate double, scale double, iterations int, converged boolean")
