"""One-pass second moments and the small solves on top of them.

A regression reads its rows once: Spark aggregates means and centred cross products per
group (``covar_pop`` merges partial results without cancellation). What is left per group is
one narrow row of k(k+1)/2 numbers; the k x k solve runs on those rows inside a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOL = 1e-10

COEF_FIELDS = [("term", T.StringType()), ("estimate", T.DoubleType()), ("std_error", T.DoubleType()),
               ("t_value", T.DoubleType()), ("p_value", T.DoubleType()), ("n", T.LongType()),
               ("df_resid", T.LongType()), ("r2", T.DoubleType())]


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _value(name: str) -> Column:
    """A column as double, ``a:b`` as a product."""
    out = None
    for part in name.split(":"):
        c = F.col(part).cast("double")
        out = c if out is None else out * c
    return out


def _doubles(df: DataFrame, by: list[str], cols: list[str], weight: str | None) -> DataFrame:
    """Complete cases of the needed columns as ``_x0.._xk`` doubles (``:`` is a product)."""
    picked = df.select(*by, *[_value(c).alias(f"_x{i}") for i, c in enumerate(cols)],
                       *([F.col(weight).cast("double").alias("_w")] if weight else []))
    return picked.dropna(subset=[c for c in picked.columns if c.startswith("_")])


def moments(df: DataFrame, cols: list[str], by: list[str] = (), weight: str | None = None) -> DataFrame:
    """Per group: ``_n``, ``_sw``, ``_mean`` and the upper triangle ``_cross`` of the
    (weighted) centred cross products."""
    return _moments_of(_doubles(df, list(by), cols, weight), len(cols), by, weight)


def _moments_of(rows: DataFrame, k: int, by: list[str], weight: str | None) -> DataFrame:
    by = list(by)
    x = [F.col(f"_x{i}") for i in range(k)]
    n = F.count(F.lit(1))
    if weight is None:
        return rows.groupBy(*by).agg(
            n.alias("_n"), n.cast("double").alias("_sw"), F.array(*[F.avg(v) for v in x]).alias("_mean"),
            F.array(*[F.covar_pop(x[i], x[j]) * n for i, j in _pairs(k)]).alias("_cross"))
    # weighted: scatter of sqrt(w)*(x - centre), brought back to weighted centred products; the
    # centre is the overall mean, without which large means cancel all digits
    root = F.sqrt("_w")
    rows = rows.filter(F.col("_w") > 0)
    centre = rows.agg(F.struct(*[F.avg(v).alias(f"c{i}") for i, v in enumerate(x)]).alias("c"))
    rows = rows.withColumn("_c", centre.scalar()).select(
        *by, "_w", "_c", root.alias("_r"), *[((v - F.col(f"_c.c{i}")) * root).alias(f"_x{i}") for i, v in enumerate(x)])
    sw = F.sum("_w")
    second = lambda a, b: (F.covar_pop(a, b) + F.avg(a) * F.avg(b)) * n
    first = [second("_r", f"_x{i}") for i in range(k)]
    return rows.groupBy(*by).agg(
        n.alias("_n"), sw.alias("_sw"), F.array(*[f / sw + F.max(F.col("_c")[f"c{i}"]) for i, f in enumerate(first)]).alias("_mean"),
        F.array(*[second(f"_x{i}", f"_x{j}") - first[i] * first[j] / sw for i, j in _pairs(k)]).alias("_cross"))


def moments_by_cases(df: DataFrame, cols: list[str], cases: list[list[str]], by: list[str] = (),
                     weight: str | None = None) -> DataFrame:
    """Moments of all columns per group, apart for every set of ``cases`` a row is complete for.

    One row per group: ``_n`` and arrays over the sets met, ``_cases`` (a 0/1 letter for each of
    ``cases``), ``_ns``, ``_sws``, ``_means``, ``_crosses``. A case's own moments are the merged
    ones of the sets that have its letter: all its columns are present there, so numbers of
    other columns, taken over the rows that have them, are not touched. Sets are few (nested
    cases have one more than there are cases), whatever the number of rows."""
    by = list(by)
    absent = F.lit(None).cast("double")
    rows = df.select(*by, *[F.nanvl(_value(c), absent).alias(f"_x{i}") for i, c in enumerate(cols)],
                     *([F.nanvl(F.col(weight).cast("double"), absent).alias("_w")] if weight else []))
    full = lambda need: reduce(lambda a, b: a & b, [F.col(f"_x{cols.index(n)}").isNotNull() for n in need])
    rows = rows.withColumn("_cases", F.concat(*[F.when(full(need), "1").otherwise("0") for need in cases]))
    rows = rows.filter(F.col("_cases").contains("1"))
    if weight:
        rows = rows.dropna(subset=["_w"])
    if by or weight:
        sets = _moments_of(rows, len(cols), [*by, "_cases"], weight)
    else:
        sets = _case_moments(rows, cols, cases)
    parts = F.sort_array(F.collect_list(F.struct("_cases", "_n", "_sw", "_mean", "_cross")))
    return sets.groupBy(*by).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"), parts.alias("_parts")).select(
        *by, "_n", *[F.col("_parts")[f].alias(f"{f}s" if f != "_cases" else f) for f in ("_cases", "_n", "_sw", "_mean")],
        F.col("_parts")["_cross"].alias("_crosses"))


def _case_moments(rows: DataFrame, cols: list[str], cases: list[list[str]]) -> DataFrame:
    """Moments per set of cases: a task adds up its batches by one matrix product each, and the
    few rows of the tasks are merged. Columns of no case met are NaN there."""
    at = [[cols.index(c) for c in need] for need in cases]
    k = len(cols)

    def add(held: tuple | None, n: int, mean: np.ndarray, scatter: np.ndarray) -> tuple:
        if held is None:
            return n, mean, scatter
        total, gap = held[0] + n, mean - held[1]
        return total, held[1] + gap * (n / total), held[2] + scatter + np.outer(gap, gap) * (held[0] * n / total)

    def row(letters: str, n: int, mean: np.ndarray, scatter: np.ndarray) -> dict:
        return {"_cases": [letters], "_n": [n], "_sw": [float(n)], "_mean": [mean.tolist()],
                "_cross": [scatter[np.triu_indices(k)].tolist()]}

    schema = "_cases string, _n bigint, _sw double, _mean array<double>, _cross array<double>"
    fields = pa.schema([("_cases", pa.string()), ("_n", pa.int64()), ("_sw", pa.float64()),
                        ("_mean", pa.list_(pa.float64())), ("_cross", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple] = {}
        for batch in batches:
            letters = batch.column("_cases").dictionary_encode()
            x = np.column_stack([batch.column(f"_x{i}").to_numpy(zero_copy_only=False) for i in range(k)])
            for code, name in enumerate(letters.dictionary.to_pylist()):
                own = x[letters.indices.to_numpy() == code]
                met = sorted({c for i, letter in enumerate(name) if letter == "1" for c in at[i]})
                mean, scatter = np.full(k, np.nan), np.full((k, k), np.nan)
                mean[met] = own[:, met].mean(axis=0)
                apart = own[:, met] - mean[met]
                scatter[np.ix_(met, met)] = apart.T @ apart
                held[name] = add(held.get(name), len(own), mean, scatter)
        for name, parts in held.items():
            yield pa.RecordBatch.from_pydict(row(name, *parts), schema=fields)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        total = None
        for r in table.sort_by([("_n", "ascending"), ("_sw", "ascending")]).to_pylist():
            total = add(total, r["_n"], np.array(r["_mean"], float), square(r["_cross"], k))
        return pa.Table.from_pydict(row(key[0].as_py(), *total), schema=fields)

    return rows.select("_cases", *[f"_x{i}" for i in range(k)]).mapInArrow(run, schema).groupBy("_cases").applyInArrow(merge, schema)


def merged_case(row: pd.Series, case: int, cols: list[str], need: list[str]) -> tuple:
    """(cross products, means, n, sum of weights) of ``need`` over the rows complete for a case."""
    at = [cols.index(c) for c in need]
    n, sw, mean, cross = 0, 0.0, np.zeros(len(at)), np.zeros((len(at), len(at)))
    for letters, pn, psw, pm, pc in zip(row["_cases"], row["_ns"], row["_sws"], row["_means"], row["_crosses"]):
        if letters[case] == "0":
            continue
        part = np.array(list(pm), float)[at]
        gap, total = part - mean, sw + psw
        cross += square([np.nan if v is None else v for v in pc], len(cols))[np.ix_(at, at)] + np.outer(gap, gap) * (sw * psw / total)
        mean, sw, n = mean + gap * (psw / total), total, n + int(pn)
    return cross, mean, n, sw


def within_moments(df: DataFrame, cols: list[str], group: str, by: list[str] = ()) -> DataFrame:
    """Moments of the deviations from group means, without materialising the deviations:
    group scatters add up. ``_groups`` counts the groups absorbed."""
    by, k = list(by), len(cols)
    per_group = moments(df, cols, [*by, group])
    add = F.array(*[F.sum(F.col("_cross")[i]) for i in range(len(_pairs(k)))])
    return per_group.groupBy(*by).agg(
        F.sum("_n").alias("_n"), F.sum("_sw").alias("_sw"), F.array(*[F.lit(0.0)] * k).alias("_mean"),
        add.alias("_cross"), F.count(F.lit(1)).alias("_groups"))


# --- small solves -----------------------------------------------------------------------

def square(cross: list[float], k: int) -> np.ndarray:
    m = np.zeros((k, k))
    for (i, j), v in zip(_pairs(k), cross):
        m[i, j] = m[j, i] = v
    return m


def invert(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverse of the non-aliased part of a scatter matrix and the mask of kept columns;
    a column explained by earlier ones is dropped, as in ordinary regression output."""
    scale = np.sqrt(np.clip(np.diag(s), 0, None))
    kept: list[int] = []
    for j in range(len(s)):
        if scale[j] <= 0:
            continue
        trial = kept + [j]
        r = s[np.ix_(trial, trial)] / np.outer(scale[trial], scale[trial])
        if kept:
            beta = np.linalg.solve(r[:-1, :-1], r[:-1, -1])
            if 1 - r[:-1, -1] @ beta < _TOL:
                continue
        kept = trial
    mask = np.zeros(len(s), bool)
    mask[kept] = True
    inv = np.zeros_like(s)
    if kept:
        d = np.outer(scale[kept], scale[kept])
        inv[np.ix_(kept, kept)] = np.linalg.inv(s[np.ix_(kept, kept)] / d) / d
    return inv, mask


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d if abs(1 + num * d) > tiny else tiny)
            c = 1 + num / c if abs(1 + num / c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def t_tail(t: float, df: float) -> float:
    """Two-sided Student-t tail probability."""
    if df <= 0 or not math.isfinite(t):
        return float("nan")
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    if x <= 0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) \
        else 1 - front * _beta_fraction(b, a, 1 - x) / b


def coef_rows(terms: list[str], beta: np.ndarray, var: np.ndarray, kept: np.ndarray, n: int, df: int,
              r2: float) -> list[tuple]:
    """Coefficient table rows; aliased terms have NULL numbers."""
    rows = []
    for name, b, v, ok in zip(terms, beta, var, kept):
        if not ok:
            rows.append((name, None, None, None, None, n, df, r2))
            continue
        se = math.sqrt(v) if df > 0 and v >= 0 else None
        t = b / se if se else None
        rows.append((name, float(b), se, t, t_tail(abs(t), df) if t is not None else None, n, df, r2))
    return rows


def solve_rows(moment_df: DataFrame, by: list[str], solve: Callable[[pd.Series], list[tuple]],
               fields: list[tuple[str, T.DataType]] = COEF_FIELDS) -> DataFrame:
    """Apply a small solve to each moment row (one row per group)."""
    by = list(by)
    names = [n for n, _ in fields]
    schema = T.StructType([*[moment_df.schema[b] for b in by], *[T.StructField(n, t) for n, t in fields]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for _, row in batch.iterrows():
                key = [row[b] for b in by]
                out += [(*key, *r) for r in (solve(row) if row["_n"] else [])]
            yield pd.DataFrame(out, columns=[*by, *names])

    return moment_df.mapInPandas(run, schema)
