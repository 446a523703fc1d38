"""Queries of column selection, column categories, tests on group statistics, estimators, matrices of P&L and portfolio steps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tenorlake.functions.nulls import finite, stars
from tenorlake.operators import audit, clean, econ, evaluate, factor, models, panel, portfolio
from tenorlake.plans.model_queries import IP, _intraday_pred, predictions
from tenorlake.plans.panel_queries import eps, returns
from tenorlake.plans.registry import EPS, INTRA, PRED, RET, fin, query
from tenorlake.sources import tables

# --- columns


@query(fin("", "l_linenumber", "sum_l_quantity, sum_l_tax", "SELECT l_linenumber, sum(l_quantity) AS sum_l_quantity, sum(l_tax) AS sum_l_tax FROM lineitem GROUP BY 1"))
def p01_p03_selected_columns(spark, d):
    items = tables.table(spark, d, "lineitem")
    names = audit.select_columns(items, "l_", "tity") + audit.select_columns(items, "l_", contains="tax", exclude=("l_extendedprice",))
    return items.select("l_linenumber", *names).groupBy("l_linenumber").agg(*(F.sum(n).alias(f"sum_{n}") for n in names))


@query(fin(RET, "raised, n", "", "SELECT true AS raised, count(*) AS n FROM ret"))
def p09_unknown_action(spark, d):
    """An action that isn't known is an error when it is met; known ones aren't."""
    r = returns(spark, d)
    report = r.select("date", "tenor", F.lit(0.0).alias("r_winsorized_candidate"), F.lit(0.0).alias("score_d"), F.lit(1.0).alias("scale"), F.lit("x").alias("auto_class"))
    kept, _ = clean.winsorize(r, report.withColumn("final_action", F.lit("keep")))
    try:
        clean.winsorize(r, report.withColumn("final_action", F.lit("ignore")))[0].agg(F.sum("r")).collect()
        raised = False
    except Exception as e:  # the error comes from a task
        raised = "unknown action: ignore" in str(e)
    return kept.agg(F.lit(raised).alias("raised"), F.count("r").alias("n"))


@query(fin(RET, "tenor, n_finite, n_other", "", "SELECT tenor, count(*) FILTER (r >= 0 OR r < -0.05) AS n_finite, count(*) FILTER (r < 0 AND r >= -0.05) AS n_other FROM ret GROUP BY tenor"))
def p10_finite(spark, d):
    x = returns(spark, d).withColumn("v", F.when(F.col("r") >= 0, F.col("r")).when(F.col("r") < -0.05, -F.col("r")).when(F.col("r") < -0.02, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
    return x.groupBy("tenor").agg(F.count_if(finite("v")).alias("n_finite"), F.count_if(~F.coalesce(finite("v"), F.lit(False))).alias("n_other"))


@query(fin(INTRA, "quote_date, is_fomc, is_cpi, other", "", "SELECT DISTINCT quote_date, day(quote_date) % 2 AS is_fomc, day(quote_date) % 3 AS is_cpi, 1::INTEGER AS other FROM intra"))
def p15_rename_by(spark, d):
    days = tables.intraday_panel(spark, d).select("quote_date").distinct()
    raw = days.select("quote_date", (F.dayofmonth("quote_date").cast("long") % 2).alias("Day of FOMC meeting"), (F.dayofmonth("quote_date").cast("long") % 3).alias("us_CPI_release"), F.lit(1).alias("other"))
    return audit.rename_by(raw, {"fomc": "is_fomc", "cpi": "is_cpi"})


A33 = EPS + ", f AS (SELECT eps AS raw_eps, eps / 2 AS eps_z, -eps AS eps_cs, CAST(tenor = 1 AS DOUBLE) AS is_front FROM eps)"


@query(fin(A33, "category, feature, n", "mean, std, min, max, nan_pct", "SELECT *, 0.0::DOUBLE AS nan_pct FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS category, '{n}' AS feature, count({n}) AS n, avg({n}) AS mean, stddev_samp({n}) AS std, min({n}) AS min, max({n}) AS max FROM f" for n, k in (("raw_eps", "raw"), ("eps_z", "ts"), ("eps_cs", "cs"), ("is_front", "dummies"))) + ")"))
def a33_category_profile(spark, d):
    x = eps(spark, d).select(F.col("eps").alias("raw_eps"), (F.col("eps") / 2).alias("eps_z"), (-F.col("eps")).alias("eps_cs"), (F.col("tenor") == 1).cast("double").alias("is_front"))
    kinds = spark.createDataFrame([(k, n) for k, ns in audit.categories(x.columns).items() for n in ns], "category string, feature string")
    return kinds.join(audit.profile(x, x.columns), "feature").select("category", "feature", "n", "mean", "std", "min", "max", "nan_pct")


# --- tests


@query(fin(INTRA, "option_type, mnes, n, stars", "mean, t", "SELECT *, CASE WHEN abs(t) > 2.5758293035489004 THEN '***' WHEN abs(t) > 1.959963984540054 THEN '**' WHEN abs(t) > 1.6448536269514722 THEN '*' ELSE '' END AS stars FROM (SELECT option_type, mnes, count(*) AS n, avg(y - 0.5) AS mean, avg(y - 0.5) / (stddev_samp(y) / sqrt(count(*))) AS t FROM intra GROUP BY 1, 2)"))
def j07_stats_and_p_values(spark, d):
    g = tables.intraday_panel(spark, d).withColumn("v", F.col("y") - 0.5).groupBy("option_type", "mnes").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), econ.t_stat("v").alias("t"))
    p = g.select("option_type", "mnes", econ.normal_pvalue("t").alias("p"))
    return g.join(p, ["option_type", "mnes"]).select("option_type", "mnes", "n", "mean", "t", stars("p").alias("stars"))


MARKET = RET + (
    ", mk AS (SELECT date, tenor, r AS y, avg(r) OVER (PARTITION BY date) AS x FROM ret), "
    "s AS (SELECT tenor, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM mk GROUP BY tenor), "
    "be AS (SELECT *, n * sxx - sx * sx AS det, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b, (sxx * sy - sx * sxy) / (n * sxx - sx * sx) AS a FROM s), "
    "u AS (SELECT tenor, x, y - a - b * x AS u, row_number() OVER (PARTITION BY tenor ORDER BY date) AS i FROM mk JOIN be USING (tenor)), "
    "me AS (SELECT p.tenor, sum(w * p.u * q.u) AS m00, sum(w * p.u * q.u * (p.x + q.x) / 2) AS m01, sum(w * p.u * q.u * p.x * q.x) AS m11 FROM u p JOIN u q ON p.tenor = q.tenor AND abs(p.i - q.i) <= 5, LATERAL (SELECT 1 - abs(p.i - q.i) / 6.0::DOUBLE AS w) GROUP BY 1), "
    "vv AS (SELECT be.*, (sxx * sxx * m00 - 2 * sx * sxx * m01 + sx * sx * m11) / (det * det) AS v0, (sx * sx * m00 - 2 * n * sx * m01 + n * CAST(n AS DOUBLE) * m11) / (det * det) AS v1, (SELECT sum(u.u * u.u) FROM u WHERE u.tenor = be.tenor) AS ssr FROM be JOIN me USING (tenor))"
)


@query(fin(MARKET, "key, term", "coef, t, r2", "SELECT CAST(tenor AS VARCHAR) AS key, term, coef, coef / sqrt(v) AS t, 1 - ssr / (syy - sy * sy / n) AS r2 FROM (SELECT *, 'const' AS term, a AS coef, v0 AS v FROM vv UNION ALL SELECT *, 'market', b, v1 FROM vv)"))
def m10_market_hac(spark, d):
    from pyspark.sql.window import Window as W

    x = returns(spark, d).withColumn("market", F.avg("r").over(W.partitionBy("date")))
    return econ.hac_ols(x, "r", ["market"], "tenor", "date")


@query()
def m14_linear_restrictions(spark, d):
    """Both events have no effect; they have the same; the signal's slope is a tenth of the late slot's effect."""
    x = _intraday_pred(spark, d).withColumn("is_event", (F.dayofmonth("quote_date") % 7 == 0).cast("double")).withColumn("is_late", (F.col("quote_time") >= "12:00").cast("double"))
    tests = {"no_events": [{"is_event": 1}, {"is_late": 1}], "same_effect": [{"is_event": 1, "is_late": -1}], "tenth": [{"y_hat": 1, "is_late": -0.1}]}
    return econ.panel_ols(x, "y", ["y_hat", "is_event", "is_late"], "option_type", ("mnes",), restrictions=tests)


# --- P&L matrices

MATRIX = IP + (
    ", ps AS (SELECT *, row_number() OVER (PARTITION BY quote_date, quote_time ORDER BY y_hat, option_type, mnes) AS up, count(*) OVER (PARTITION BY quote_date, quote_time) AS c FROM ip), "
    "pl AS (SELECT 'sign' AS rule, option_type, quote_time, quote_date, sum(sign(y_hat + 0.5) * y) AS s FROM ip GROUP BY 1, 2, 3, 4 UNION ALL SELECT 'topk', option_type, quote_time, quote_date, sum(CASE WHEN up <= 2 THEN -y WHEN up > c - 2 THEN y ELSE 0 END) FROM ps GROUP BY 1, 2, 3, 4), "
    "us AS (SELECT *, s - avg(s) OVER k AS u, avg(s) OVER k AS m, count(*) OVER k AS n, row_number() OVER (PARTITION BY rule, option_type, quote_time ORDER BY quote_date) AS i FROM pl WINDOW k AS (PARTITION BY rule, option_type, quote_time)), "
    "nw AS (SELECT p.rule, p.option_type, p.quote_time, max(p.n) AS n, max(p.m) AS m, sum(p.u * q.u * (1 - abs(p.i - q.i) / (floor(4 * pow(p.n / 100.0, 2.0 / 9)) + 1))) AS v FROM us p JOIN us q ON p.rule = q.rule AND p.option_type = q.option_type AND p.quote_time = q.quote_time AND abs(p.i - q.i) <= floor(4 * pow(p.n / 100.0, 2.0 / 9)) GROUP BY 1, 2, 3)"
)


@query(fin(MATRIX, "rule, option_type, quote_time, n", "mean_bps, t_nw", "SELECT rule, option_type, quote_time, n, CASE WHEN n >= 10 THEN m * 1e4 END AS mean_bps, CASE WHEN n >= 10 AND v > 1e-12 THEN m / sqrt(v / n / n) END AS t_nw FROM nw"))
def m34_bar_family_matrix(spark, d):
    p = _intraday_pred(spark, d)
    sign = p.withColumn("pnl", F.signum(F.col("y_hat") + 0.5) * F.col("y"))
    topk = evaluate.extremes(p, "y_hat", 2, ("quote_date", "quote_time"), ("option_type", "mnes")).withColumn("pnl", F.col("position") * F.col("y"))
    return evaluate.pnl_matrix({"sign": sign, "topk": topk}, "pnl", "option_type", "quote_time", "quote_date")


# --- estimators


def _features(spark, d):
    x = panel.residual_features(eps(spark, d)).dropna(subset=["eps_lag_1", "eps_vs_curve", "eps_curve_std", "eps"])
    cut = F.col("date") < F.lit("1999-01-01").cast("date")
    return x.where(cut), x.where(~cut), ["eps_lag_1", "eps_vs_curve", "eps_curve_std"]


@query()
def m18_registry(spark, d):
    """Every kind of the registry: what it is fitted with, rows and mean squared error."""
    train, test, xs = _features(spark, d)
    small = {"RandomForest": {"numTrees": 5, "maxDepth": 3}, "ExtraTrees": {"numTrees": 5, "maxDepth": 3}, "XGB": {"maxIter": 3, "maxDepth": 3}, "LGBM": {"maxIter": 3, "maxDepth": 3}, "Lasso": {"regParam": 1e-4}}
    out = None
    for kind in ("Ridge", *models.REGISTRY):
        y = models.fit_predict(train, test, "eps", xs, kind, small.get(kind))
        one = y.agg(F.count("*").alias("n"), F.avg(F.pow(F.col("eps") - F.col("y_hat"), F.lit(2))).alias("mse")).select(F.lit(kind).alias("kind"), F.lit(models.fitted_by(kind)).alias("estimator"), "n", "mse")
        out = one if out is None else out.unionByName(one)
    return out


ONE = EPS + ", z AS (SELECT * FROM (SELECT date, tenor, eps AS y, lag(eps) OVER (PARTITION BY tenor ORDER BY date) AS x FROM eps) WHERE x IS NOT NULL), b AS (SELECT covar_pop(x, y) AS c, var_pop(x) AS v, avg(x) AS mx, avg(y) AS my FROM z)"


def _one(spark, d):
    from pyspark.sql.window import Window as W

    return eps(spark, d).select("date", "tenor", F.col("eps").alias("y"), F.lag("eps").over(W.partitionBy("tenor").orderBy("date")).alias("x")).where("x is not null")


@query(fin(ONE, "date, tenor", "y_hat", "SELECT date, tenor, my + c / v * (x - mx) AS y_hat FROM z, b"))
def m18_linear(spark, d):
    z = _one(spark, d)
    return models.fit_predict(z, z, "y", ["x"], "Linear").select("date", "tenor", "y_hat")


@query(fin(ONE, "date, tenor", "y_hat", "SELECT date, tenor, my + sign(c) * greatest(abs(c) - 0.0001, 0) / v * (x - mx) AS y_hat FROM z, b"))
def m18_lasso(spark, d):
    z = _one(spark, d)
    return models.fit_predict(z, z, "y", ["x"], "Lasso", {"regParam": 1e-4, "tol": 1e-12, "maxIter": 1000}).select("date", "tenor", "y_hat")


@query()
def m31_forest_importance(spark, d):
    """MDI of the fitted trees and MDA on the test rows, of one forest."""
    train, test, xs = _features(spark, d)
    fitted = models.fit(train, "eps", xs, "RandomForest", {"numTrees": 10, "maxDepth": 4})
    return models.impurity_importance(fitted, spark).unionByName(models.permuted(fitted, test, "eps"))


# --- factor grids


def _grid(spark, d):
    return factor.spec_grid(factor.vectors(returns(spark, d)), 7)


@query()
def m09_grid_by_m(spark, d):
    return factor.grid_summary(_grid(spark, d), "m")


@query()
def m09_grid_by_window(spark, d):
    return factor.grid_summary(_grid(spark, d), "T")


# --- portfolio steps


def _step(name: str, source: str, inner: str) -> str:
    """A CTE with w divided by the sum of its absolute values; dates without any weight go."""
    return f", {name}0 AS ({inner.format(source=source)}), {name} AS (SELECT date, tenor, b, w / s AS w FROM (SELECT *, sum(abs(w)) OVER (PARTITION BY date) AS s FROM {name}0) WHERE s >= 1e-10)"


def _project(ridge: float = 1e-6) -> str:
    """Weights less their part along the loading b and the constant, with a ridge: two normal equations."""
    sums = "SELECT *, sum(b * b) OVER d + {r} AS p, sum(b) OVER d / sqrt(count(*) OVER d) AS q, 1 + {r} AS o, sum(b * w) OVER d AS x, sum(w) OVER d / sqrt(count(*) OVER d) AS y, 1 / sqrt(count(*) OVER d) AS k FROM {{source}} WINDOW d AS (PARTITION BY date)".format(r=f"{ridge}::DOUBLE")
    return f"SELECT date, tenor, b, w - (b * (o * x - q * y) + k * (p * y - q * x)) / (p * o - q * q) AS w FROM ({sums})"


LEGS = PRED + (
    ", nm AS (SELECT date, tenor, y_pred, tenor / 4.0::DOUBLE AS b, count(*) OVER (PARTITION BY date) AS n FROM pred WHERE tenor <> 1), "
    "lg AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY y_pred DESC, tenor) AS hi, row_number() OVER (PARTITION BY date ORDER BY y_pred, tenor) AS lo FROM nm WHERE n >= 4), "
    "le AS (SELECT date, tenor, b, CASE WHEN lo <= 2 THEN -0.5::DOUBLE WHEN hi <= 2 THEN 0.5::DOUBLE ELSE 0 END AS w FROM lg)"
)
CENTRE = "SELECT date, tenor, b, w - avg(w) OVER (PARTITION BY date) AS w FROM {source}"
CAP = "(SELECT date, tenor, b, greatest(least(w, 0.3), -0.3) AS w FROM {source})"
LAST = "SELECT lg.date, lg.tenor, CASE WHEN max(abs(w3.w)) OVER (PARTITION BY lg.date) <= 1.25 * 0.3 THEN w3.w ELSE 0 END AS weight, {neutral} AS factor_neutral FROM lg LEFT JOIN w3 ON w3.date = lg.date AND w3.tenor = lg.tenor"


def _weights_sql(neutral: str, flag: str) -> str:
    ctes = LEGS + _step("w1", "le", CENTRE) + _step("w2", "w1", neutral) + _step("w3", "w2", neutral.replace("{source}", CAP))
    return fin(ctes, "date, tenor, factor_neutral", "weight", LAST.replace("{neutral}", flag))


@query(_weights_sql(CENTRE, "false"))
def x16_dollar_neutral_weights(spark, d):
    p = portfolio.Portfolio(top_k=2, bottom_k=2, max_abs=0.3, exclude=(1,), neutralize=False)
    return p.panel(predictions(spark, d).select("date", "tenor", "y_pred"))


@query(_weights_sql(_project(), "true"))
def x18_one_factor_weights(spark, d):
    p = portfolio.Portfolio(top_k=2, bottom_k=2, max_abs=0.3, exclude=(1,), n_factors=1)
    load = predictions(spark, d).select("date", "tenor", F.lit(1).alias("factor"), (F.col("tenor") / 4).alias("loading"))
    return p.panel(predictions(spark, d).select("date", "tenor", "y_pred"), load)


@query(fin(PRED + ", sg AS (SELECT date, tenor, tenor / 4.0::DOUBLE AS b, y_pred AS w FROM pred)", "date, tenor", "w", _project().replace("{source}", "sg")))
def x19_projected_signal(spark, d):
    """The signal less its part along one loading and the constant."""
    p = portfolio.Portfolio()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["date", "tenor"]].assign(w=p.project(pdf.y_pred.to_numpy(float), (pdf.tenor.to_numpy(float) / 4)[:, None]))

    return predictions(spark, d).select("date", "tenor", "y_pred").groupBy("date").applyInPandas(run, "date date, tenor int, w double")
