"""Estimators: closed-form ridge over distributed sums, and a registry of Spark ML models."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# What is fitted for each kind. Kinds without a twin in Spark take the nearest ensemble, and results name it.
REGISTRY = {
    "Linear": ("LinearRegression", lambda p: LinearRegression(elasticNetParam=0.0, regParam=0.0, **p)),
    "Lasso": ("LinearRegression", lambda p: LinearRegression(elasticNetParam=1.0, standardization=False, **p)),
    "RandomForest": ("RandomForestRegressor", lambda p: RandomForestRegressor(seed=42, **p)),
    "ExtraTrees": ("RandomForestRegressor", lambda p: RandomForestRegressor(seed=42, featureSubsetStrategy="onethird", **p)),
    "XGB": ("GBTRegressor", lambda p: GBTRegressor(seed=42, **p)),
    "LGBM": ("GBTRegressor", lambda p: GBTRegressor(seed=42, **p)),
}


def fitted_by(kind: str) -> str:
    """The name of the estimator that ``kind`` is fitted with."""
    return "Ridge" if kind == "Ridge" else _kind(kind)[0]


def _kind(kind: str):
    if kind not in REGISTRY:
        raise ValueError(f"unknown model {kind}; known: Ridge, {', '.join(REGISTRY)}")
    return REGISTRY[kind]


def ridge(df: DataFrame, y: str, xs: list[str], alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """Coefficients and intercept from one aggregate of (k + 2)(k + 1) / 2 sums, however many rows."""
    names = [*xs, y]
    cols = {n: F.col(n).cast("double") for n in names}
    ok = df.dropna(subset=names)
    row = ok.agg(F.count("*").alias("n"), *(F.sum(cols[a]).alias(f"s{i}") for i, a in enumerate(names)), *(F.sum(cols[a] * cols[b]).alias(f"p{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j)).head()
    k = len(xs)
    if not row["n"]:
        raise ValueError("no complete rows")
    s = np.array([row[f"s{i}"] for i in range(k + 1)])
    m = np.array([[row[f"p{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)]) - np.outer(s, s) / row["n"]
    b = np.linalg.solve(m[:k, :k] + alpha * np.eye(k), m[:k, k])
    return b, float((s[k] - b @ s[:k]) / row["n"])


def predict_linear(df: DataFrame, xs: list[str], b: np.ndarray, level: float, out: str = "y_hat") -> DataFrame:
    return df.withColumn(out, sum((F.col(n) * float(v) for n, v in zip(xs, b, strict=True)), F.lit(float(level))))


@dataclass
class Fitted:
    """A fitted model: predictions as often as wanted, and impurity importance where the estimator has it."""

    xs: list[str]
    linear: tuple[np.ndarray, float] | None = None
    model: Model | None = None

    def predict(self, df: DataFrame, out: str = "y_hat", xs: list[str] | None = None) -> DataFrame:
        """For the complete rows of ``df``; ``xs`` names other columns to take in place of the features."""
        xs = xs or self.xs
        if self.linear:
            return predict_linear(df.dropna(subset=xs), xs, *self.linear, out)
        vec = VectorAssembler(inputCols=xs, outputCol="__x", handleInvalid="skip")
        return self.model.copy({self.model.featuresCol: "__x", self.model.predictionCol: out}).transform(vec.transform(df)).drop("__x")

    def mdi(self) -> dict[str, float]:
        """Share of each feature in the impurity decrease of the fitted trees, averaged over trees; none for linear models."""
        if self.model is None or not hasattr(self.model, "featureImportances"):
            return {}
        return dict(zip(self.xs, self.model.featureImportances.toArray().tolist(), strict=True))


def fit(train: DataFrame, y: str, xs: list[str], kind: str = "Ridge", params: dict | None = None) -> Fitted:
    params = dict(params or {})
    if kind == "Ridge":
        return Fitted(list(xs), linear=ridge(train, y, xs, params.get("alpha", 1.0)))
    vec = VectorAssembler(inputCols=xs, outputCol="__x", handleInvalid="skip")
    return Fitted(list(xs), model=_kind(kind)[1](params).setFeaturesCol("__x").setLabelCol(y).fit(vec.transform(train.dropna(subset=[y]))))


def fit_predict(train: DataFrame, test: DataFrame, y: str, xs: list[str], kind: str = "Ridge", params: dict | None = None, out: str = "y_hat") -> DataFrame:
    """Predictions for the complete rows of ``test``."""
    return fit(train, y, xs, kind, params).predict(test, out)


def permutation_importance(train: DataFrame, test: DataFrame, y: str, xs: list[str], kind: str = "Ridge", params: dict | None = None) -> DataFrame:
    """``permuted`` of a model fitted on ``train``."""
    return permuted(fit(train, y, xs, kind, params), test, y)


def permuted(fitted: Fitted, test: DataFrame, y: str, buckets: int = 64) -> DataFrame:
    """(type MDA, feature, importance): rise of the mean squared error when a feature's values are dealt anew among the test rows.

    The model is fitted once, before. Within each of ``buckets`` hash buckets a row takes the feature of
    the next row in an order hashed anew for each feature, so no window or sort covers all rows; one pass scores all.
    """
    xs = fitted.xs
    rows = test.dropna(subset=[y, *xs]).select(y, *xs).withColumn("__h", F.xxhash64(y, *xs))
    rows = rows.withColumn("__bucket", F.pmod("__h", F.lit(buckets)))
    w = W.partitionBy("__bucket")
    for i, n in enumerate(xs):
        order = w.orderBy(F.xxhash64("__h", F.lit(i)), "__h")
        rows = rows.withColumn(f"__v{i}", F.coalesce(F.lead(n).over(order), F.first(n).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    rows = fitted.predict(rows, "__y")
    for i in range(len(xs)):
        rows = fitted.predict(rows, f"__y{i}", [f"__v{k}" if k == i else x for k, x in enumerate(xs)])
    error = lambda c: F.avg(F.pow(F.col(y) - F.col(c), F.lit(2)))
    scored = rows.agg(error("__y").alias("__base"), *(error(f"__y{i}").alias(f"__e{i}") for i in range(len(xs))))
    each = F.array(*(F.struct(F.lit(n).alias("feature"), (F.col(f"__e{i}") - F.col("__base")).alias("importance")) for i, n in enumerate(xs)))
    return scored.select(F.explode(each).alias("e")).select(F.lit("MDA").alias("type"), "e.feature", "e.importance")


def impurity_importance(fitted: Fitted, spark: SparkSession) -> DataFrame:
    """(type MDI, feature, importance) of the fitted trees; no rows for linear models."""
    return spark.createDataFrame([("MDI", n, float(v)) for n, v in fitted.mdi().items()], "type string, feature string, importance double")
