"""MLlib-backed fits: logit, principal components, k-means."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _assembled(df: DataFrame, cols: list[str], out: str) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="skip").transform(df)


def _with_products(df: DataFrame, xs: list[str]) -> tuple[DataFrame, list[str]]:
    names = []
    for x in xs:
        name = x.replace(":", "_x_")
        if ":" in x:
            df = df.withColumn(name, reduce(lambda a, b: a * b, [F.col(p).cast("double") for p in x.split(":")]))
        else:
            df = df.withColumn(name, F.col(x).cast("double"))
        names.append(name)
    return df, names


def logit(df: DataFrame, y: str, xs: list[str], max_iter: int = 50) -> tuple[DataFrame, DataFrame]:
    """Binomial regression: (coefficient table, rows with the fitted probability ``fit``).
    ``iterations`` and ``converged`` say whether ``max_iter`` rounds were enough."""
    data, names = _with_products(df, list(xs))
    data = _assembled(data.withColumn("_y", F.col(y).cast("double")).dropna(subset=["_y"]), names, "_features")
    model = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="_features",
                                        labelCol="_y", predictionCol="fit", maxIter=max_iter, tol=1e-9).fit(data)
    s = model.summary
    terms = [*xs, "(Intercept)"]
    est = [*map(float, model.coefficients), float(model.intercept)]
    rounds = int(s.numIterations)
    rows = [(t, b, float(se), float(z), float(p), rounds, rounds < max_iter) for t, b, se, z, p in
            zip(terms, est, s.coefficientStandardErrors, s.tValues, s.pValues)]
    coefs = df.sparkSession.createDataFrame(
        rows, "term string, estimate double, std_error double, z_value double, p_value double, iterations int, converged boolean")
    drop = ["_features", "_y", *[n for n, x in zip(names, xs) if ":" in x]]
    return coefs, model.transform(data).drop(*drop)


def pca(df: DataFrame, cols: list[str], k: int | None = None) -> DataFrame:
    """Principal components of centred and scaled columns: (component, prop_var, column,
    loading). A component is oriented so that its largest loading is positive."""
    cols = list(cols)
    data = _assembled(df.select([F.col(c).cast("double").alias(c) for c in cols]), cols, "_features")
    scaled = StandardScaler(withMean=True, withStd=True, inputCol="_features", outputCol="_scaled").fit(data).transform(data)
    model = PCA(k=k or len(cols), inputCol="_scaled", outputCol="_pc").fit(scaled)
    loadings, var = model.pc.toArray(), model.explainedVariance.toArray()
    rows = []
    for j in range(loadings.shape[1]):
        v = loadings[:, j]
        v = v if v[abs(v).argmax()] > 0 else -v
        rows += [(j + 1, float(var[j]), c, float(x)) for c, x in zip(cols, v)]
    return df.sparkSession.createDataFrame(rows, "component int, prop_var double, column string, loading double")


def kmeans(df: DataFrame, cols: list[str], k: int, seed: int = 715, out: str = "cluster",
           max_iter: int | None = None) -> DataFrame:
    """Rows with their cluster number. The fit goes on until no centre moves; one that a given
    ``max_iter`` rounds do not end raises."""
    data = _assembled(df, cols, "_features")
    model = KMeans(k=k, seed=seed, maxIter=max_iter or 2 ** 31 - 1, featuresCol="_features", predictionCol=out).fit(data)
    if max_iter and model.summary.numIter >= max_iter:
        raise RuntimeError(f"k-means did not settle in {max_iter} rounds")
    return model.transform(data).drop("_features")


def cluster_sizes(clustered: DataFrame, cluster: str = "cluster") -> DataFrame:
    return clustered.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
