"""Model numbers against direct linear algebra on small data."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mealops.operators.models import causal, clusters, learners, matching, robust
from mealops.operators.models import regression as reg
from mealops.operators.models.moments import t_tail

N = 400


@pytest.fixture(scope="module")
def data():
    rnd = np.random.default_rng(11)
    g = rnd.integers(0, 6, N)
    z = rnd.normal(size=N)
    u = rnd.normal(size=N)
    x1 = 3 + 0.8 * z + u + g * 0.3
    x2 = rnd.normal(100, 10, N)
    y = 2 - 1.5 * x1 + 0.05 * x2 + g + u + rnd.standard_t(3, N)
    w = rnd.uniform(0.2, 3, N)
    return dict(g=g, z=z, x1=x1, x2=x2, y=y, w=w)


@pytest.fixture(scope="module")
def df(spark, data):
    rows = [tuple(float(v[i]) for v in data.values()) for i in range(N)]
    return spark.createDataFrame(rows, ", ".join(f"{k} double" for k in data)).repartition(6).cache()


def table(out, key="term"):
    return {r[key]: r for r in out.collect()}


def direct(X, y, w=None, lost=0):
    w = np.ones(len(y)) if w is None else w
    inv = np.linalg.inv(X.T @ (X * w[:, None]))
    b = inv @ X.T @ (w * y)
    e = y - X @ b
    s2 = (w * e * e).sum() / (len(y) - X.shape[1] - lost)
    return b, np.sqrt(np.diag(inv) * s2)


def check(got, terms, b, se):
    assert [got[t]["estimate"] for t in terms] == pytest.approx(list(b), rel=1e-8)
    assert [got[t]["std_error"] for t in terms] == pytest.approx(list(se), rel=1e-8)


def test_ols_and_weights(df, data):
    X = np.c_[np.ones(N), data["x1"], data["x2"], data["x1"] * data["x2"]]
    terms = ["(Intercept)", "x1", "x2", "x1:x2"]
    check(table(reg.ols(df, "y", terms[1:])), terms, *direct(X, data["y"]))
    check(table(reg.ols(df, "y", terms[1:], weight="w")), terms, *direct(X, data["y"], data["w"]))
    assert reg.crossed("a", "b", "c") == ["a", "b", "c", "a:b", "a:c", "b:c", "a:b:c"]


def test_aliased_and_constant_columns_are_dropped(df):
    dup = df.withColumn("x3", F.col("x1") * 2 + 1).withColumn("one", F.lit(5.0))
    got = table(reg.ols(dup, "y", ["x1", "x3", "one", "x2"]))
    base = table(reg.ols(df, "y", ["x1", "x2"]))
    assert got["x3"]["estimate"] is None and got["one"]["estimate"] is None
    assert got["x2"]["estimate"] == pytest.approx(base["x2"]["estimate"])
    assert got["x2"]["df_resid"] == N - 3


def test_t_tail():
    # two-sided 5 % points of Student's t
    for df_, t in ((1, 12.7062), (5, 2.5706), (30, 2.0423), (1e6, 1.95997)):
        assert t_tail(t, df_) == pytest.approx(0.05, rel=1e-3)
    assert t_tail(0.0, 9) == 1.0


def test_grouped_equals_filtered(df):
    grouped = {(r["g"], r["term"]): r["estimate"] for r in reg.ols(df, "y", ["x1"], by=["g"]).collect()}
    for g in range(6):
        one = table(reg.ols(df.filter(F.col("g") == g), "y", ["x1"]))
        assert grouped[(g, "x1")] == pytest.approx(one["x1"]["estimate"])


def test_fixed_effects_equal_dummies(df, data):
    D = np.eye(6)[data["g"].astype(int)]
    b, se = direct(np.c_[data["x1"], data["x2"], D], data["y"])
    check(table(reg.fe_ols(df, "y", ["x1", "x2"], "g")), ["x1", "x2"], b[:2], se[:2])
    dummied, names = reg.design_columns(df, {"g": [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]})
    got = table(reg.ols(dummied, "y", ["x1", "x2", *names]))
    assert got["x1"]["estimate"] == pytest.approx(b[0])


def test_two_stage(df, data):
    X = np.c_[np.ones(N), data["x1"], data["x2"]]
    Z = np.c_[np.ones(N), data["z"], data["g"], data["x2"]]
    P = Z @ np.linalg.solve(Z.T @ Z, Z.T)
    inv = np.linalg.inv(X.T @ P @ X)
    b = inv @ X.T @ P @ data["y"]
    e = data["y"] - X @ b
    se = np.sqrt(np.diag(inv) * (e @ e) / (N - 3))
    check(table(reg.iv_2sls(df, "y", ["x1"], ["x2"], ["z", "g"])), ["(Intercept)", "x1", "x2"], b, se)
    same = table(reg.iv_2sls(df, "y", ["x1"], ["x2"], ["x1"]))
    assert same["x1"]["estimate"] == pytest.approx(table(reg.ols(df, "y", ["x1", "x2"]))["x1"]["estimate"])


def test_huber_equals_direct_iteration(df, data):
    X = np.c_[np.ones(N), data["x1"], data["x2"]]
    b, _ = direct(X, data["y"])
    for _ in range(60):
        e = data["y"] - X @ b
        s = np.median(abs(e)) / 0.6745
        b, _ = direct(X, data["y"], np.minimum(1, 1.345 * s / abs(e)))
    got = table(reg.huber(df, "y", ["x1", "x2"], max_iter=60, tol=1e-8))
    assert [got[t]["estimate"] for t in ("(Intercept)", "x1", "x2")] == pytest.approx(list(b), rel=1e-5)


def test_discontinuity_equals_two_lines(df, data):
    x, y = data["x1"] - 3, data["y"]
    w = np.clip(1 - abs(x) / 1.5, 0, None)
    ends = []
    for side in (x >= 0, x < 0):
        keep = side & (w > 0)
        ends.append(direct(np.c_[np.ones(keep.sum()), x[keep]], y[keep], w[keep])[0][0])
    got = table(reg.rd_estimate(df, "y", "x1", 3, 1.5))
    assert got["jump"]["estimate"] == pytest.approx(ends[0] - ends[1])


def test_logit_newton(df, data):
    t = (data["x1"] > 3.2).astype(float)
    X, b = np.c_[np.ones(N), data["z"], data["x2"] - 100], np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-X @ b))
        b = b + np.linalg.solve(X.T @ (X * (p * (1 - p))[:, None]), X.T @ (t - p))
    d = df.withColumn("t", (F.col("x1") > 3.2).cast("int")).withColumn("c", F.col("x2") - 100)
    coefs, fitted = learners.logit(d, "t", ["z", "c"])
    got = table(coefs)
    assert [got[k]["estimate"] for k in ("(Intercept)", "z", "c")] == pytest.approx(list(b), abs=1e-4)
    assert fitted.agg(F.avg("fit")).first()[0] == pytest.approx(t.mean(), abs=1e-4)


def test_even_weights_equal_plain_ols(df):
    d = df.withColumn("t", (F.col("x1") > 3.2).cast("int")).withColumn("p", F.lit(0.5))
    a = table(causal.ipw_ate(d, "y", "t", "p", ["x2"]))
    b = table(reg.ols(d, "y", ["t", "x2"]))
    assert a["t"]["estimate"] == pytest.approx(b["t"]["estimate"])


@pytest.mark.parametrize("leaf", [7, 2000])
def test_matching_equals_brute_force(spark, leaf, monkeypatch):
    monkeypatch.setattr(matching, "LEAF", leaf)
    rnd = np.random.default_rng(5)
    n = 240
    t, block = (rnd.random(n) < 0.4).astype(int), rnd.integers(0, 3, n)
    X = np.c_[rnd.integers(0, 6, n) * 1.0, rnd.normal(size=n), rnd.integers(0, 2, n) * 1.0]
    X[:80] = X[0]                       # a third are copies of one profile
    X[200] = [40, 9, 1]                 # far away from everything
    t[block == 2] = 1                   # a block without controls
    y = rnd.normal(size=n) + t
    rows = [(int(t[i]), int(block[i]), *map(float, X[i]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "t int, b int, x0 double, x1 double, x2 double, y double").repartition(4)
    sd = X.std(axis=0, ddof=1)
    Z = X / sd * np.sqrt([1, 2, 1])
    effects, dists, lost = [], [], 0
    for i in np.where(t == 1)[0]:
        c = np.where((t == 0) & (block == block[i]))[0]
        if not len(c):
            lost += 1
            continue
        d = np.sqrt(((Z[c] - Z[i]) ** 2).sum(axis=1))
        near = c[d <= d.min() + 1e-9]
        effects.append(y[i] - y[near].mean())
        dists.append(d.min())
    got = causal.match_att(df, "y", "t", ["x0", "x1", "x2"], weights={"x1": 2.0}, blocks=["b"]).first()
    assert (got["matched"], got["unmatched"]) == (len(effects), lost)
    assert got["att"] == pytest.approx(np.mean(effects))
    assert got["mean_dist"] == pytest.approx(np.mean(dists))


def _neighbours(Z, seek, among, tolerance=1e-9):
    """For each row of ``seek`` the rows of ``among`` (itself left out) at the least distance."""
    out = []
    for i in seek:
        c = among[among != i]
        d = np.sqrt(((Z[c] - Z[i]) ** 2).sum(axis=1))
        out.append(c[d <= d.min() + tolerance])
    return out


@pytest.mark.parametrize("width,apart,copies", [(2, 0.0, 0), (5, 0.0, 60), (9, 500.0, 30)])
def test_matching_by_tree(spark, width, apart, copies, monkeypatch):
    """Effect, error, matches and balance against loops, with many leaves, near and far sides."""
    monkeypatch.setattr(matching, "LEAF", 12)
    monkeypatch.setattr(matching, "VISITORS", 16)
    monkeypatch.setattr(matching, "CHUNK", 50)
    rnd, n = np.random.default_rng(width), 360
    t = (rnd.random(n) < 0.3).astype(int)
    X = rnd.normal(size=(n, width))
    X[:, 0] = rnd.integers(0, 4, n)  # a column with ties
    X[t == 1, -1] += apart
    if copies:
        X[:copies] = X[0]
        X[copies:2 * copies, :] = X[copies]
    y = rnd.normal(size=n) + 2 * t + X[:, 0]
    xs = [f"x{k}" for k in range(width)]
    df = spark.createDataFrame([(int(t[i]), *map(float, X[i]), float(y[i])) for i in range(n)],
                               "t int, " + ", ".join(f"{x} double" for x in xs) + ", y double").repartition(3)
    Z = X / X.std(axis=0, ddof=1)
    treated, controls = np.where(t == 1)[0], np.where(t == 0)[0]
    near = _neighbours(Z, treated, controls)
    effect = np.array([y[i] - y[m].mean() for i, m in zip(treated, near)])
    uses, squares = np.zeros(n), np.zeros(n)
    for m in near:
        uses[m] += 1 / len(m)
        squares[m] += 1 / len(m) ** 2
    variance = np.zeros(n)
    for i, m in zip(controls, _neighbours(Z, controls, controls)):
        variance[i] = len(m) / (len(m) + 1) * (y[i] - y[m].mean()) ** 2
    error = np.sqrt(((effect - effect.mean()) ** 2).sum() + ((uses ** 2 - squares) * variance).sum()) / len(treated)
    m = matching.match(df, "y", "t", xs)
    got = matching.att_error(m).first()
    assert got["att"] == pytest.approx(effect.mean()) and got["matched"] == len(treated)
    assert got["std_error"] == pytest.approx(error) and got["t_value"] == pytest.approx(effect.mean() / error)
    # distances are counted, and far fewer than all pairs of profiles where the sides meet
    profiles = len(np.unique(X[t == 1], axis=0)) * len(np.unique(X[t == 0], axis=0))
    assert 0 < m.pairs <= 3 * profiles
    if width == 2 and not apart:
        assert m.pairs < 0.5 * profiles
    got = {(r["sample"], r["column"]): r for r in causal.balance_matched(df, "y", "t", xs).collect()}
    for k, x in enumerate(xs):
        assert got["before", x]["mean_diff"] == pytest.approx(X[treated, k].mean() - X[controls, k].mean())
        mean = (uses * X[:, k]).sum() / uses.sum()
        assert got["after", x]["mean_control"] == pytest.approx(mean)
        spread = (uses * (X[:, k] - mean) ** 2).sum() / (uses.sum() - 1)
        assert got["after", x]["var_ratio"] == pytest.approx(X[treated, k].var(ddof=1) / spread) or spread < 1e-12


def _sandwich(X, y, w, groups=None):
    bread = np.linalg.inv(X.T @ (X * w[:, None]))
    b = bread @ (X.T @ (w * y))
    u = X * (w * (y - X @ b))[:, None]
    n, p = X.shape
    if groups is None:
        scale = n / (n - p)
    else:
        u = np.array([u[groups == g].sum(0) for g in np.unique(groups)])
        scale = len(u) / (len(u) - 1) * (n - 1) / (n - p)
    return b, np.sqrt(np.diag(scale * bread @ (u.T @ u) @ bread))


@pytest.mark.parametrize("weight,cluster", [(None, None), ("w", None), (None, "g"), ("w", "g")])
def test_robust_errors(spark, weight, cluster):
    rnd, n = np.random.default_rng(4), 300
    X = np.c_[np.ones(n), rnd.normal(size=n) + 1e5, rnd.integers(0, 3, n)]
    g, w = rnd.integers(0, 12, n), rnd.random(n) + 0.1
    g[:100] = 0  # a third in one cluster
    y = X[:, 1] - 1e5 + 2 * X[:, 2] + rnd.normal(size=n) * (1 + X[:, 2]) + g / 5
    rows = [(float(X[i, 1]), float(X[i, 2]), float(y[i]), float(w[i]), int(g[i])) for i in range(n)]
    rows += [(None, 1.0, 1.0, 1.0, 1), (1.0, 1.0, None, 1.0, 1)] + ([(1.0, 1.0, 1.0, 0.0, 1), (1.0, 1.0, 1.0, None, 1)] if weight else [])
    rows += [(1.0, 1.0, 1.0, 1.0, None)] if cluster else []
    df = spark.createDataFrame(rows, "a double, b double, y double, w double, g int").withColumn("a2", 2 * F.col("a"))
    b, se = _sandwich(X, y, w if weight else np.ones(n), g if cluster else None)
    got = {r["term"]: r for r in robust.ols_robust(df, "y", ["a", "b", "a2"], weight, cluster).collect()}
    assert got["a2"]["estimate"] is None and got["a"]["df_resid"] == (len(set(g)) - 1 if cluster else n - 3)
    for k, term in enumerate(["(Intercept)", "a", "b"]):
        assert got[term]["estimate"] == pytest.approx(b[k], rel=1e-5) and got[term]["std_error"] == pytest.approx(se[k], rel=1e-5)
    assert robust.ols_robust(df.limit(0), "y", ["a"], weight, cluster).count() == 0


def test_propensity_chain(spark):
    rnd, n = np.random.default_rng(6), 400
    X = np.c_[np.ones(n), rnd.normal(size=n), rnd.normal(size=n) * 30 + 500]
    t = (rnd.random(n) < 1 / (1 + np.exp(-(X[:, 1] + (X[:, 2] - 500) / 30)))).astype(float)
    y = 2 * t + X[:, 1] + rnd.normal(size=n)
    b = np.zeros(3)
    Z = np.c_[X[:, :2], (X[:, 2] - 500) / 30]
    for _ in range(40):
        p = 1 / (1 + np.exp(-Z @ b))
        b = b + np.linalg.solve(Z.T @ (Z * (p * (1 - p))[:, None]), Z.T @ (t - p))
    p = 1 / (1 + np.exp(-Z @ b))
    error = np.sqrt(np.diag(np.linalg.inv(Z.T @ (Z * (p * (1 - p))[:, None]))))
    df = spark.createDataFrame([(int(t[i]), float(X[i, 1]), float(X[i, 2]), float(y[i])) for i in range(n)] + [(1, None, 1.0, 1.0)],
                               "t int, a double, b double, y double")
    coefs, fitted = robust.logit_irls(df, "t", ["a", "b"])
    got = {r["term"]: r for r in coefs.collect()}
    assert got["a"]["estimate"] == pytest.approx(b[1]) and got["b"]["estimate"] == pytest.approx(b[2] / 30)
    assert got["a"]["std_error"] == pytest.approx(error[1], rel=1e-4) and got["b"]["std_error"] == pytest.approx(error[2] / 30, rel=1e-4)
    assert all(r["converged"] and not r["separated"] and r["score"] < 1e-6 for r in got.values())
    assert sorted(r["fit"] for r in fitted.collect()) == pytest.approx(sorted(p))
    w = np.where(t == 1, 1 / p, 1 / (1 - p))
    want, se = _sandwich(np.c_[np.ones(n), t, X[:, 1:]], y, w)
    got = {r["term"]: r for r in robust.ipw_effect(df, "y", "t", ["a", "b"]).collect()}
    assert got["t"]["estimate"] == pytest.approx(want[1], rel=1e-5) and got["t"]["std_error"] == pytest.approx(se[1], rel=1e-4)


def test_separated_arms(spark):
    df = spark.createDataFrame([(int(i > 20), float(i), 1.0) for i in range(40)], "t int, a double, y double")
    coefs, _ = robust.logit_irls(df, "t", ["a"])
    assert all(r["separated"] for r in coefs.collect())
    with pytest.raises(ValueError):
        robust.ipw_effect(df, "y", "t", ["a"])
    one = robust.logit_irls(df.filter("t = 1"), "t", ["a"])[0]
    assert all(r["separated"] for r in one.collect())


def test_partition_tree():
    rnd = np.random.default_rng(1)
    points = np.c_[rnd.normal(size=300), rnd.integers(0, 2, 300), np.ones(300)]
    dims, cuts = matching.fit_tree(points, 4)
    leaf = matching.leaf_of(points, dims, cuts)
    assert set(leaf) <= set(range(16)) and np.bincount(leaf).max() < 60
    assert set(matching.leaf_of(np.ones((5, 3)), *matching.fit_tree(np.ones((9, 3)), 3))) == {0}
    assert matching.leaf_of(points, *matching.fit_tree(points[:0], 0)).tolist() == [0] * 300


def test_matching_without_controls(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0)], "t int, x double, y double")
    got = causal.match_att(df, "y", "t", ["x"]).first()
    assert (got["att"], got["matched"], got["unmatched"]) == (None, 0, 1)


def test_balance_ks(df, data):
    t = data["x1"] > 3.2
    a, b = np.sort(data["x2"][t]), np.sort(data["x2"][~t])
    grid = np.concatenate([a, b])
    ks = max(abs(np.searchsorted(a, grid, "right") / len(a) - np.searchsorted(b, grid, "right") / len(b)))
    got = table(causal.balance(df.withColumn("t", (F.col("x1") > 3.2).cast("int")), "t", ["x2", "z"]), "column")["x2"]
    assert got["ks"] == pytest.approx(ks)
    assert got["std_diff"] == pytest.approx((a.mean() - b.mean()) / a.std(ddof=1))
    assert got["var_ratio"] == pytest.approx(a.var(ddof=1) / b.var(ddof=1))


def test_pca_matches_correlation_eigen(df, data):
    C = np.corrcoef(np.c_[data["x1"], data["x2"], data["z"]].T)
    vals = np.sort(np.linalg.eigvalsh(C))[::-1]
    got = {r["component"]: r["prop_var"] for r in learners.pca(df, ["x1", "x2", "z"]).collect()}
    assert [got[i] for i in (1, 2, 3)] == pytest.approx(list(vals / 3))


def test_kmeans_and_k_selection(spark):
    rows = [(float(c * 10 + i % 3), float(c)) for c in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert sorted(r["n"] for r in learners.cluster_sizes(learners.kmeans(df, ["a", "b"], 3)).collect()) == [20, 20, 20]
    sel = {r["k"]: r for r in clusters.k_selection(df, ["a", "b"], [2, 3]).collect()}
    assert sel[3]["within_ss"] < sel[2]["within_ss"] and sel[3]["silhouette"] > sel[2]["silhouette"]


def _rows_by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


@pytest.mark.parametrize("weight,by", [(None, []), ("w", []), (None, ["g"]), ("w", ["g"])])
def test_specs_in_one_pass_equal_separate_fits(spark, tmp_path, weight, by):
    """NULL and NaN in other columns do not cost a specification its rows; the table is scanned once."""
    rng = np.random.default_rng(5)
    rows = [(int(i % 3), *[None if rng.random() < p else float("nan") if rng.random() < q else float(1e4 + rng.normal())
                           for p, q in ((0, 0), (.1, 0), (.2, .05), (.5, 0))], float(rng.integers(0, 4))) for i in range(400)]
    spark.createDataFrame(rows, "g int, y double, a double, b double, c double, w double").withColumn(
        "gone", F.lit(None).cast("double")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    specs = {"one": ["a"], "two": ["a", "b"], "all": ["a", "b", "c"], "product": ["c", "a:b"], "twin": ["a", "a"], "none": ["gone"]}
    got = reg.ols_specs(df, "y", specs, by=by, weight=weight)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == (2 if weight else 1)  # the weighted centre is a read of its own
    assert got.columns[-1] == "spec" and "none" not in {r["spec"] for r in got.collect()}
    for name, xs in specs.items():
        key = [*by, "term"] if name != "twin" else [*by, "term", "estimate"]
        one, many = (_rows_by(t, *key) for t in (reg.ols(df, "y", xs, by=by, weight=weight), got.filter(F.col("spec") == name)))
        assert len(one) == len(many)
        if name == "twin":
            continue
        for k, r in one.items():
            assert many[k]["n"] == r["n"] and many[k]["df_resid"] == r["df_resid"]
            for f in ("estimate", "std_error", "r2"):
                assert many[k][f] == pytest.approx(r[f], rel=1e-6, abs=1e-7)


def test_specs_of_an_empty_table(spark):
    df = spark.createDataFrame([], "y double, a double")
    assert reg.ols_specs(df, "y", {"one": ["a"]}).collect() == []


def _lloyd(x, centres, rounds=200):
    for _ in range(rounds):
        at = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([x[at == j].mean(0) if (at == j).any() else centres[j] for j in range(len(centres))])
    return at, centres


def test_many_k_in_one_scan_a_round(spark, monkeypatch):
    """Each k equals a plain loop from the shared seeds; the silhouette equals the pairwise one."""
    rng = np.random.default_rng(2)
    x = np.r_[[rng.normal(m, 1, 2) for m in ((1e4, 0), (1e4 + 8, 0), (1e4, 9)) for _ in range(30)]]
    df = spark.createDataFrame([(*map(float, r),) for r in x] + [(None, 1.0), (float("nan"), 2.0)], "a double, b double")
    scans, real = [], clusters._sums
    monkeypatch.setattr(clusters, "_sums", lambda p, c, o: scans.append(sorted(c)) or real(p, c, o))
    got = clusters.kmeans_many(df, ["a", "b"], [2, 3, 5]).collect()
    assert scans[0] == [2, 3, 5] and len(scans) == max(r["iterations"] for r in got) + 1
    seeds, _ = clusters._seeds(clusters._points(df, ["a", "b"]), 5, 715)
    sel = {r["k"]: r for r in clusters.k_selection(df, ["a", "b"], [2, 3, 5]).collect()}
    for k in (2, 3, 5):
        at, centres = _lloyd(x, seeds[:k])
        mine = sorted((r for r in got if r["k"] == k), key=lambda r: r["cluster"])
        assert all(r["converged"] for r in mine) and [r["n"] for r in mine] == [int((at == j).sum()) for j in range(k)]
        assert np.array([(r["a"], r["b"]) for r in mine]) == pytest.approx(centres, abs=1e-5)
        apart = ((x[:, None] - x[None]) ** 2).sum(2)
        s = []
        for i in range(len(x)):
            own = (at == at[i]).sum()
            inner = apart[i, at == at[i]].sum() / (own - 1) if own > 1 else 0
            outer = min(apart[i, at == j].mean() for j in set(at) - {at[i]})
            s.append((outer - inner) / max(inner, outer) if own > 1 else 0)
        assert sel[k]["silhouette"] == pytest.approx(np.mean(s), abs=1e-6)
        assert sel[k]["within_ss"] == pytest.approx(((x - centres[at]) ** 2).sum(), rel=1e-6)


def test_many_k_of_few_or_no_points(spark):
    same = spark.createDataFrame([(1.0,)] * 5 + [(3.0,)], "a double")
    got = sorted((r["k"], r["n"], r["a"]) for r in clusters.kmeans_many(same, ["a"], [1, 4]).collect())
    assert [g[:2] for g in got] == [(1, 6), (4, 1), (4, 5)] and got[0][2] == pytest.approx(8 / 6)
    assert [r["silhouette"] for r in clusters.k_selection(same, ["a"], [1]).collect()] == [0.0]
    assert clusters.kmeans_many(same.limit(0), ["a"], [2]).collect() == []
    assert clusters.k_selection(same.limit(0), ["a"], [2]).collect() == []
    assert not clusters.kmeans_many(same, ["a"], [2], max_iter=0 + 1, tol=-1.0).first()["converged"]


def test_residual_scores_tell_a_wrong_fit(spark):
    """Near 0 for least squares, on the rows each specification is complete for; not for others."""
    from mealops.catalog.results import residual_scores
    rng = np.random.default_rng(5)
    data = [(float(a), None if i % 9 == 0 else float(b), float(2 * a - b + e))
            for i, (a, b, e) in enumerate(rng.standard_normal((400, 3)))]
    df = spark.createDataFrame(data, "a double, b double, y double")
    specs = {"one": ["a"], "two": ["a", "b", "a:b"]}
    fits = reg.ols_specs(df, "y", specs)
    right = residual_scores(df, fits, "y", specs).collect()
    assert {(r["spec"], r["term"], r["n"]) for r in right} >= {("one", "a", 400), ("two", "a:b", 355)} and len(right) == 6
    assert max(r["score"] for r in right) < 1e-12
    wrong = residual_scores(df, fits.withColumn("estimate", F.col("estimate") * 1.1), "y", specs).collect()
    assert all(r["score"] > 1e-3 for r in wrong if r["term"] == "a")


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_near_pairs_are_those_of_all_distances(shift):
    """By a matrix product, yet ties and rounding as coordinate by coordinate."""
    from mealops.operators.models.matching import _near_pairs
    rnd = np.random.default_rng(5)
    z, c = rnd.integers(0, 3, (80, 9)) / 7 + shift, rnd.integers(0, 3, (400, 9)) / 7 + shift
    z[:20], skip = c[:20], np.r_[np.arange(20), np.full(60, -1)]
    d = np.zeros((80, 400))
    for k in range(9):
        d += (z[:, None, k] - c[None, :, k]) ** 2
    d = np.sqrt(d)
    d[np.arange(20), np.arange(20)] = np.inf
    i, j = np.nonzero(d <= d.min(axis=1)[:, None] + 1e-9)
    got = _near_pairs(z, c, 1e-9, skip)
    assert np.array_equal(got[0], i) and np.array_equal(got[1], j) and np.array_equal(got[2], d[i, j])
    assert len(_near_pairs(z[:1], z[:1], 1e-9, np.array([0]))[0]) == 0
