"""Numbers that large or odd inputs used to break, and work that must stay spread."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mealops import session
from mealops.operators.filters import row_slice, sample_rows
from mealops.operators.models import clusters, learners
from mealops.operators.models import regression as reg
from mealops.operators.quantiles import column_quantiles, exact_quantiles
from mealops.operators.running import running_totals


def test_weighted_slope_of_epoch_seconds(spark):
    rng = np.random.default_rng(1)
    x = 1.7e9 + 100 * rng.standard_normal(500)
    e, w = rng.standard_normal(500), rng.uniform(0.5, 3, 500)
    y = 5 + 2 * (x - 1.7e9) + e
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, y, w)], "x double, y double, w double")
    (row,) = [r for r in reg.ols(df, "y", ["x"], weight="w").collect() if r["term"] == "x"]
    xc = x - np.average(x, weights=w)
    slope = (w * xc * y).sum() / (w * xc * xc).sum()
    assert row["estimate"] == pytest.approx(slope, rel=1e-6) and row["std_error"] > 1e-4


@pytest.mark.parametrize("few", [1_000_000, 5])
@pytest.mark.parametrize("values", [
    [1.7e9 + i / 7 for i in range(4000)], [i / 8e5 for i in range(4000)], [3.0] * 500, [0.0] + [1.7e9 + i for i in range(3000)],
    [-5.0, -4.0, 1, 2, 3, 4, 5, 6], [float("-inf"), 1.0, 2.0, float("inf")], [random.Random(2).expovariate(1) ** 9 for _ in range(3000)]])
def test_quantiles_of_any_range(spark, values, few):
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("a", float("nan")), ("a", None), ("b", None)], "g string, v double")
    probs = {"p25": 0.25, "p50": 0.5, "p99": 0.99}
    with np.errstate(invalid="ignore"):
        want = {k: float(np.quantile(values, p)) for k, p in probs.items()}
    (got,) = exact_quantiles(df, ["g"], "v", probs, few=few).collect()
    (whole,) = exact_quantiles(df, [], "v", probs, few=few).collect() if few > 5 else (got,)
    for k, v in want.items():
        if np.isfinite(v):
            assert got[k] == pytest.approx(v, rel=1e-12) and whole[k] == got[k]


def test_quantiles_of_columns_with_few_and_many_values(spark):
    """Pairs of both kinds side by side: a hot group, NULL groups, repeated values, two columns."""
    rnd = random.Random(7)
    data = [(rnd.choice(["hot", "hot", "hot", "b", None]), rnd.gauss(0, 1) * 10 ** rnd.randrange(-9, 9), rnd.randrange(4))
            for _ in range(3000)] + [("tiny", 1.5, None), ("void", None, None), ("same", 7.0, 1), ("same", 7.0, 1)]
    df = spark.createDataFrame(data, "g string, x double, k int").repartition(6)
    probs = {"lo": 0.0, "p10": 0.1, "mid": 0.5, "hi": 1.0}
    got = {(r["g"], r["column"]): r for r in column_quantiles(df, ["g"], ["x", "k"], probs, few=700).collect()}
    want = {}
    for g, x, k in data:
        for name, v in (("x", x), ("k", k)):
            if v is not None:
                want.setdefault((g, name), []).append(v)
    assert set(got) == set(want) and any(len(set(v)) > 700 for v in want.values())
    for key, values in want.items():
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(float(np.quantile(values, p)), rel=1e-12), (key, name)
    assert column_quantiles(df.filter("false"), ["g"], ["x"], probs).count() == 0
    clash = exact_quantiles(df.withColumnsRenamed({"g": "n", "k": "mean"}), ["n", "mean"], "x", {"m": 0.5})
    assert clash.columns == ["n", "mean", "m"] and clash.filter("n = 'tiny'").first()["m"] == 1.5


def test_quantiles_of_many_columns_take_two_shuffles(spark):
    """Values are not joined and move once, as counts."""
    cols = [f"c{i}" for i in range(6)]
    df = spark.range(2000).select((F.col("id") % 7).alias("g"), *[(F.col("id") * i % 101).alias(c) for i, c in enumerate(cols)])
    out = column_quantiles(df, ["g"], cols, {"m": 0.5})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_slices_agree_on_nulls(spark):
    df = spark.createDataFrame([(None,), (3,), (1,), (2,)], "id int")
    keys = lambda a, b: [r[0] for r in row_slice(df, a, b).collect()]
    assert sorted(keys(1, 2)) == [1, 2] and sorted(keys(2, 3)) == [2, 3] and keys(4, 4) == [None]


def test_samples_have_exactly_n_rows(spark):
    df = spark.range(5000)
    for n in (0, 1, 777, 5000, 6000):
        got = [r[0] for r in sample_rows(df, n, seed=3).collect()]
        assert len(got) == len(set(got)) == min(n, 5000)


def test_running_totals(spark):
    rows = [(k, (k * 37) % 101, None if k % 10 == 0 else k) for k in range(3000)]
    df = spark.createDataFrame(rows, "id int, o int, v int").repartition(5)
    got = running_totals(df, [F.col("o"), F.col("id")], {"s": F.col("v")}, number="n", partitions=7).collect()
    total = 0
    want = {}
    for i, (k, o, v) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1):
        total += v or 0
        want[k] = (i, total)
    assert {r["id"]: (r["n"], r["s"]) for r in got} == want
    assert running_totals(df.filter("id < 0"), [F.col("o")], {}, number="n").count() == 0


def test_wide_designs_are_not_refused(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 45))
    y = x.sum(1) + 0.01 * rng.standard_normal(300)
    names = [f"x{i}" for i in range(45)]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], [*names, "y"])
    got = reg.ols(df, "y", names).collect()
    assert len(got) == 46 and all(abs(r["estimate"] - 1) < 0.05 for r in got if r["term"] != "(Intercept)")


def test_fits_say_whether_they_converged(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal(300)
    df = spark.createDataFrame([(float(a), float(2 * a + e), int(a + e > 0)) for a, e in zip(x, rng.standard_normal(300))],
                               "x double, y double, t int")
    few, many = (reg.huber(df, "y", ["x"], max_iter=n).collect() for n in (1, 50))
    assert not few[0]["converged"] and few[0]["iterations"] == 1 and many[0]["converged"]
    assert learners.logit(df, "t", ["x"])[0].first()["converged"]
    assert not learners.logit(df, "t", ["x"], max_iter=1)[0].first()["converged"]
    assert clusters.k_selection(df, ["x", "y"], [2]).first()["converged"]
    with pytest.raises(RuntimeError):
        learners.kmeans(df, ["x", "y"], 7, max_iter=1)


def test_cluster_without_shared_folder_is_an_error(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def test_kmeans_goes_on_until_it_settles(spark):
    """Even points along a line: the fit takes more than 100 rounds."""
    df = spark.range(20_000).select((F.col("id") / 20_000).alias("x")).coalesce(1)
    got = learners.cluster_sizes(learners.kmeans(df, ["x"], 60, seed=1)).collect()
    assert len(got) == 60 and sum(r["n"] for r in got) == 20_000
