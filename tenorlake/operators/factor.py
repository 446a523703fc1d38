"""Rolling factor models from Gram matrices.

A window needs nothing but its weighted N x N Gram matrices, so the panel is
turned into one vector per date, dates are cut into blocks, and each block gets
the T rows before it. Blocks are independent tasks; a task holds one block. The
only step in order, the signs of the loadings, is a running parity over dates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tenorlake.functions.nulls import corr, div, kurt
from tenorlake.operators.joins import pairs


def time_weights(length: int, tau: float) -> np.ndarray:
    """exp(-age / tau), oldest first, with sum ``length``; tau is an e-folding age, not a half-life."""
    w = np.exp(-np.arange(length - 1, -1, -1) / tau)
    return w * length / w.sum()


def weights_table(spark, length: int, tau: float) -> DataFrame:
    """(age, weight) by expressions only."""
    w = F.exp(-F.col("age") / F.lit(float(tau)))
    return spark.range(length).withColumnRenamed("id", "age").select("age", (F.lit(float(length)) * w / F.sum(w).over(W.partitionBy())).alias("weight"))


def vectors(panel: DataFrame, x: str = "r") -> DataFrame:
    """(t, date, v): values of all tenors of the dates that have every one, in the order of tenors."""
    n = panel.agg(F.countDistinct("tenor").alias("__n"))
    v = panel.where(F.col(x).isNotNull()).groupBy("date").agg(F.array_sort(F.collect_list(F.struct("tenor", x))).alias("p"))
    full = v.crossJoin(F.broadcast(n)).where(F.size("p") == F.col("__n"))
    return full.select((F.row_number().over(W.orderBy("date")) - 1).cast("long").alias("t"), "date", F.transform("p", lambda s: s[x]).alias("v"))


def gram(df: DataFrame, v: str, n: int, weight: Column | None = None) -> DataFrame:
    """(i, j, g): sums of products of the vector's components, i <= j; a distributed aggregate with n (n + 1) / 2 rows per task."""
    w = F.lit(1.0) if weight is None else weight
    upto = lambda a: F.sequence(a, F.lit(n - 1))
    cells = F.flatten(F.transform(upto(F.lit(0)), lambda i: F.transform(upto(i), lambda j: F.struct(i.alias("i"), j.alias("j"), (F.get("__w", i) * F.get(v, j)).alias("g")))))
    rows = df.select(v, F.transform(v, lambda x: w * x).alias("__w")).select(F.explode(cells).alias("c"))
    return rows.groupBy("c.i", "c.j").agg(F.sum("c.g").alias("g"))


def descending(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors, largest first; the largest component of each vector is positive."""
    lam, u = np.linalg.eigh(g)
    lam, u = np.maximum(lam[::-1], 0), u[:, ::-1]
    return lam, u * np.where(u[np.abs(u).argmax(0), np.arange(len(lam))] < 0, -1.0, 1.0)


def two_stage(window: np.ndarray, tau_fast: float = 21, tau_slow: float = 126, p: int = 3, m: int = 3) -> dict:
    """One window (T x N), oldest row first."""
    t, n = window.shape
    fast = window.T @ (window * time_weights(t, tau_fast)[:, None])
    _, u = descending(fast)
    rest = np.eye(n) - u[:, :p] @ u[:, :p].T
    sigma = np.maximum(np.sqrt(np.maximum(np.diag(rest @ fast @ rest), 0) / t), 1e-10)
    slow = window.T @ (window * time_weights(t, tau_slow)[:, None])
    lam, u = descending(slow / np.outer(sigma, sigma))
    raw = lam / t
    scaled = raw * n / raw.sum() if raw.sum() > 0 else raw
    return {"loadings": sigma[:, None] * u[:, :m], "sigma": sigma, "lambda_raw": raw, "lambda_corr": scaled, "shrunk": np.maximum(scaled[:m] - n / t, 1e-8)}


_MODEL = "t long, date date, window_start date, window_end date, r array<double>, b array<array<double>>, f array<double>, sigma array<double>, lambda_raw array<double>, lambda_corr array<double>, shrunk array<double>"


def _by_blocks(vecs: DataFrame, length: int, fn, schema: str) -> DataFrame:
    """fn over each block of dates with the ``length`` rows before it."""
    size = max(length, 64)
    block = F.floor(F.col("t") / size)
    spread = vecs.withColumn("__block", F.explode(F.sequence(block, F.floor((F.col("t") + length) / size))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        return fn(pdf.t.to_numpy(), pdf.date.to_numpy(), np.array(pdf.v.tolist(), float), key[0] * size, (key[0] + 1) * size)

    return spread.groupBy("__block").applyInPandas(run, schema)


def _window_models(t, date, v, first, last, length: int, tau_fast: float, tau_slow: float, p: int, m: int) -> list[tuple]:
    """A row of ``_MODEL`` for each date of a block that has ``length`` rows before it."""
    out = []
    for i in range(length, len(t)):
        if first <= t[i] < last:
            s = two_stage(v[i - length : i], tau_fast, tau_slow, p, m)
            f = (s["loadings"] / s["sigma"][:, None] ** 2).T @ v[i]
            out.append((t[i], date[i], date[i - length], date[i - 1], v[i], [list(c) for c in s["loadings"].T], f, s["sigma"], s["lambda_raw"], s["lambda_corr"], s["shrunk"]))
    return out


def rolling_models(vecs: DataFrame, length: int = 252, tau_fast: float = 21, tau_slow: float = 126, p: int = 3, m: int = 3) -> DataFrame:
    """A row for each date with ``length`` rows before it: the model of [t - T, t - 1] and the date's vector, with aligned signs.

    b: m columns of loadings; f: the date's factor returns; cos_sim: with the date before.
    """

    def run(t, date, v, first, last) -> pd.DataFrame:
        return pd.DataFrame(_window_models(t, date, v, first, last, length, tau_fast, tau_slow, p, m), columns=[c.split()[0] for c in _MODEL.split(", ")])

    return _aligned(_by_blocks(vecs, length, run, _MODEL), m)


def rolling_grid(vecs: DataFrame, specs: list[tuple]) -> DataFrame:
    """``rolling_models`` of all specifications (T, tau_fast, tau_slow, p, m) in one pass, with their place as ``spec``.

    A task holds one block of dates for one specification.
    """
    lengths = F.array(*(F.lit(s[0]) for s in specs))
    each = vecs.select("*", F.posexplode(lengths).alias("spec", "__length")).withColumn("__size", F.greatest("__length", F.lit(64)))
    block = F.floor(F.col("t") / F.col("__size"))
    spread = each.withColumn("__block", F.explode(F.sequence(block, F.floor((F.col("t") + F.col("__length")) / F.col("__size")))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        spec, block, size = key[0], key[1], max(specs[key[0]][0], 64)
        pdf = pdf.sort_values("t")
        rows = _window_models(pdf.t.to_numpy(), pdf.date.to_numpy(), np.array(pdf.v.tolist(), float), block * size, (block + 1) * size, *specs[spec])
        return pd.DataFrame([(spec, *r) for r in rows], columns=["spec", *(c.split()[0] for c in _MODEL.split(", "))])

    raw = spread.select("spec", "__block", "t", "date", "v").groupBy("spec", "__block").applyInPandas(run, "spec int, " + _MODEL)
    return _aligned(raw, max(s[-1] for s in specs), ("spec",))


def _aligned(raw: DataFrame, m: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Signs that follow the date before, in each of ``keys``; fitted and residual vectors."""
    order = W.partitionBy(*keys).orderBy("t")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    before = F.lag("b").over(order)
    d = F.zip_with("b", before, dot)
    norm = F.zip_with("b", before, lambda x, y: F.sqrt(dot(x, x) * dot(y, y)))
    x = raw.withColumn("__flip", F.transform(d, lambda v: (v < 0).cast("int"))).withColumn("cos_sim", F.zip_with(d, norm, lambda a, b: F.when(b > 0, F.abs(a) / b)))
    total = [F.sum(F.coalesce(F.get("__flip", F.lit(k)), F.lit(0))).over(order.rowsBetween(W.unboundedPreceding, 0)) for k in range(m)]
    sign = F.array(*(F.when(s % 2 == 1, -1.0).otherwise(1.0) for s in total))
    x = x.withColumn("__sign", F.slice(sign, F.lit(1), F.size("b"))).withColumn("b", F.zip_with("b", "__sign", lambda c, s: F.transform(c, lambda v: v * s))).withColumn("f", F.zip_with("f", "__sign", lambda v, s: v * s))
    fitted = F.transform(F.sequence(F.lit(0), F.size("r") - 1), lambda i: F.aggregate(F.zip_with("b", "f", lambda c, v: c[i] * v), F.lit(0.0), lambda s, y: s + y))
    x = x.withColumn("fitted", fitted)
    return x.withColumn("residual", F.zip_with("r", "fitted", lambda a, b: a - b)).drop("__flip", "__sign")


def frames(models: DataFrame) -> dict[str, DataFrame]:
    """factors, residuals, fitted, loadings, eigenvalues and diagnostics, long; tenors and factors count from 1."""
    each = lambda name, value: models.select("date", F.posexplode(name).alias("tenor", value)).withColumn("tenor", F.col("tenor") + 1)
    load = models.select("date", "window_start", "window_end", "sigma", F.posexplode("b").alias("factor", "c"))
    load = load.select("date", (F.col("factor") + 1).alias("factor"), "sigma", F.posexplode("c").alias("i", "loading"), "window_start", "window_end")
    lam = models.select("date", "window_start", "window_end", "shrunk", "lambda_corr", F.aggregate("lambda_raw", F.lit(0.0), lambda s, x: s + x).alias("__all"), F.posexplode("lambda_raw").alias("i", "lambda_raw"))
    lam = lam.select("date", "window_start", "window_end", (F.col("i") + 1).alias("k"), "lambda_raw", F.get("lambda_corr", F.col("i")).alias("lambda_corr"), F.get("shrunk", F.col("i")).alias("lambda_corr_shrunk"), div("lambda_raw", "__all").alias("evr"))
    lam = lam.withColumn("cumevr", F.sum("evr").over(W.partitionBy("date").orderBy("k")))
    cos = models.select("date", "window_start", "window_end", F.posexplode_outer("cos_sim").alias("factor", "cos_sim"))
    return {
        "factors": models.select("date", F.posexplode("f").alias("factor", "value")).withColumn("factor", F.col("factor") + 1),
        "residuals": each("residual", "eps"),
        "fitted": each("fitted", "fit"),
        "loadings": load.select("date", "factor", (F.col("i") + 1).alias("tenor"), "loading", F.get("sigma", F.col("i")).alias("sigma"), "window_start", "window_end"),
        "eigenvalues": lam,
        "diagnostics": cos.withColumn("factor", F.col("factor") + 1),
    }


def rolling_pca(vecs: DataFrame, length: int, k: int = 6) -> DataFrame:
    """Unweighted diagnostics of the windows [t - T + 1, t], labelled by their last date: (date, k, lambda, evr, cumevr, cos_sim)."""

    def run(t, date, v, first, last) -> pd.DataFrame:
        out, before = [], None
        for i in range(length - 1, len(t)):
            if not first - 1 <= t[i] < last:
                continue
            lam, u = descending(v[i - length + 1 : i + 1].T @ v[i - length + 1 : i + 1])
            kk = min(k, len(lam))
            if t[i] >= first:
                evr = lam / lam.sum() if lam.sum() > 0 else lam
                for j in range(kk):
                    out.append((date[i], j + 1, lam[j] / length, evr[j], evr[: j + 1].sum(), None if before is None else abs(float(u[:, j] @ before[:, j]))))
            before = u
        return pd.DataFrame(out, columns=["date", "k", "lambda", "evr", "cumevr", "cos_sim"])

    return _by_blocks(vecs, length, run, "date date, k int, lambda double, evr double, cumevr double, cos_sim double")


def stability(long: DataFrame, k: str = "factor", bound: float = 0.99) -> DataFrame:
    """By factor: mean, least and share below ``bound`` of the cosine similarities."""
    known = long.where("cos_sim is not null")
    return known.groupBy(k).agg(F.avg("cos_sim").alias("mean_cos"), F.min("cos_sim").alias("min_cos"), F.avg((F.col("cos_sim") < bound).cast("double")).alias("share_below"))


def scree(vecs: DataFrame, length: int = 252, tau_fast: float = 21, tau_slow: float = 126, p: int = 3) -> DataFrame:
    """(k, lambda_raw, lambda_corr) of the last ``length`` rows."""
    top = vecs.agg(F.max("t").alias("__t"))
    last = vecs.crossJoin(F.broadcast(top)).where(F.col("t") > F.col("__t") - length).withColumn("g", F.lit(0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = two_stage(np.array(pdf.sort_values("t").v.tolist(), float), tau_fast, tau_slow, p, 1)
        return pd.DataFrame({"k": range(1, len(s["lambda_raw"]) + 1), "lambda_raw": s["lambda_raw"], "lambda_corr": s["lambda_corr"]})

    return last.groupBy("g").applyInPandas(run, "k int, lambda_raw double, lambda_corr double")


def factor_counts(eigen: DataFrame, n: int, length: int) -> DataFrame:
    """(m_threshold, m_gap, m_log_gap) from (k, lambda_corr)."""
    most = min(8, n - 1)
    nxt = F.lead("lambda_corr").over(W.orderBy("k"))
    g = eigen.select("k", "lambda_corr", (F.col("lambda_corr") - nxt).alias("gap"), (F.ln("lambda_corr") - F.ln(nxt)).alias("log_gap"))
    best = lambda name: F.max_by("k", F.when(F.col("k") <= most, F.struct(name, -F.col("k"))))
    return g.agg(F.count_if(F.col("lambda_corr") >= 1 + (n / length) ** 0.5).alias("m_threshold"), best("gap").alias("m_gap"), best("log_gap").alias("m_log_gap"))


def reconstruction_error(models: DataFrame) -> DataFrame:
    gap = F.zip_with(F.zip_with("fitted", "residual", lambda a, b: a + b), "r", lambda a, b: F.abs(a - b))
    return models.agg(F.max(F.array_max(gap)).alias("max_error"))


def fit_quality(models: DataFrame) -> DataFrame:
    """By tenor: R2, raw and residual deviation, their ratio (residual over raw)."""
    x = models.select("date", F.posexplode(F.arrays_zip("r", "residual")).alias("i", "z")).select((F.col("i") + 1).alias("tenor"), F.col("z.r").alias("r"), F.col("z.residual").alias("e"))
    out = x.groupBy("tenor").agg((1 - div(F.sum(F.col("e") * F.col("e")), F.var_pop("r") * F.count("r"))).alias("r2"), F.stddev_samp("r").alias("raw_vol"), F.stddev_samp("e").alias("residual_vol"))
    return out.withColumn("vol_ratio", div("residual_vol", "raw_vol")).withColumn("raw_vol_ann", F.col("raw_vol") * 252**0.5).withColumn("residual_vol_ann", F.col("residual_vol") * 252**0.5)


def off_diagonal(long: DataFrame, value: str) -> DataFrame:
    """(mean_abs, max_abs) of the correlations between tenors."""
    c = pairs(long, "date", "tenor", value).groupBy("name_a", "name_b").agg(corr("a", "b").alias("c"))
    return c.agg(F.avg(F.abs("c")).alias("mean_abs"), F.max(F.abs("c")).alias("max_abs"))


def shock_profile(f: dict[str, DataFrame]) -> DataFrame:
    """(factor, tenor): median and deviation of loading times the factor's deviation; mean and deviation of loadings."""
    sd = f["factors"].groupBy("factor").agg(F.stddev_samp("value").alias("sd"))
    x = f["loadings"].join(F.broadcast(sd), "factor").withColumn("shock", F.col("loading") * F.col("sd"))
    return x.groupBy("factor", "tenor").agg(F.percentile("shock", F.lit(0.5)).alias("median_shock"), F.stddev_samp("shock").alias("sd_shock"), F.avg("loading").alias("mean_loading"), F.stddev_samp("loading").alias("sd_loading"))


def _explained(models: DataFrame) -> DataFrame:
    """By specification: n_obs, R2, volatility ratios, correlations, stability, residual size and explained variance.

    One pass over the models: every row gives its tenors, pairs of tenors, cosines and explained variance to one aggregate.
    """
    each = F.transform(F.sequence(F.lit(0), F.size("r") - 1), lambda i: F.struct(F.lit("tenor").alias("kind"), i.alias("i"), F.lit(0).alias("j"), F.get("r", i).alias("x"), F.get("residual", i).alias("y")))

    def two(name: str) -> Column:
        def row(i: Column) -> Column:
            later = F.filter(F.sequence(F.lit(0), F.size(name) - 1), lambda j: j > i)
            return F.transform(later, lambda j: F.struct(F.lit(name).alias("kind"), i.alias("i"), j.alias("j"), F.get(name, i).alias("x"), F.get(name, j).alias("y")))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(name) - 1), row))

    none = F.lit(None).cast("double")
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    cos = F.transform("cos_sim", lambda v, i: F.struct(F.lit("cos").alias("kind"), i.alias("i"), F.lit(0).alias("j"), v.alias("x"), (v < 0.99).cast("double").alias("y")))
    evr = F.array(F.struct(F.lit("evr").alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("j"), div(add(F.slice("lambda_raw", F.lit(1), F.size("b"))), add("lambda_raw")).alias("x"), none.alias("y")))
    parts = models.select("spec", F.explode(F.concat(each, two("r"), two("residual"), F.coalesce(cos, F.array().cast("array<struct<kind:string,i:int,j:int,x:double,y:double>>")), evr)).alias("e")).select("spec", "e.*")
    g = parts.groupBy("spec", "kind", "i", "j").agg(F.count("x").alias("n"), F.avg("x").alias("ax"), F.avg("y").alias("ay"), corr("x", "y").alias("c"), (1 - div(F.sum(F.col("y") * F.col("y")), F.var_pop("x") * F.count("x"))).alias("r2"), div(F.stddev_samp("y"), F.stddev_samp("x")).alias("ratio"), F.stddev_samp("y").alias("sy"), kurt("y").alias("k"), F.avg(F.abs("y")).alias("abs_y"))
    of = lambda kind, v: F.when(F.col("kind") == kind, v)
    return g.groupBy("spec").agg(
        F.max(of("evr", F.col("n"))).alias("n_obs"),
        F.avg(of("tenor", F.col("r2"))).alias("r2"),
        F.percentile(of("tenor", F.col("r2")), F.lit(0.5)).alias("median_r2"),
        F.min(of("tenor", F.col("r2"))).alias("min_r2"),
        F.avg(of("tenor", F.col("ratio"))).alias("vol_ratio"),
        F.max(of("tenor", F.col("ratio"))).alias("max_vol_ratio"),
        F.avg(of("residual", F.abs("c"))).alias("resid_corr"),
        F.max(of("residual", F.abs("c"))).alias("max_resid_corr"),
        F.avg(of("r", F.abs("c"))).alias("raw_corr"),
        (F.avg(of("r", F.abs("c"))) - F.avg(of("residual", F.abs("c")))).alias("corr_reduction"),
        F.avg(of("cos", F.col("ax"))).alias("stability"),
        F.avg(of("cos", F.col("ay"))).alias("share_below"),
        F.avg(of("tenor", F.col("abs_y"))).alias("mean_abs_resid"),
        F.avg(of("tenor", F.col("sy"))).alias("mean_resid_std"),
        F.avg(of("tenor", F.col("k"))).alias("kurtosis"),
        F.avg(of("evr", F.col("ax"))).alias("cumevr"),
    )


def spec_grid(vecs: DataFrame, n: int, lengths=(126, 252, 504), ms=(3, 4), fasts=(15, 21), slows=(126, 252)) -> DataFrame:
    """A row for each specification with tau_fast < tau_slow <= T and m <= N: fit, correlation, stability, residuals and explained variance.

    ``score`` adds z-scores over the specifications that could be fitted: R2, reduction of correlation and stability,
    less volatility ratio, residual correlation and the share of cosines below 0.99; ``rank`` is by score. A specification without enough rows has NULLs.
    """
    spark = vecs.sparkSession
    specs = [(T, fast, slow, min(n, max(3, m)), m) for T in lengths for m in ms for fast in fasts for slow in slows if fast < slow <= T and m <= n]
    if not specs:
        return spark.createDataFrame([], "T int, m int, tau_fast int, tau_slow int, r2 double, vol_ratio double, resid_corr double, stability double, cumevr double, score double, rank int")
    named = spark.createDataFrame([(i, T, m, fast, slow) for i, (T, fast, slow, _, m) in enumerate(specs)], "spec int, T int, m int, tau_fast int, tau_slow int")
    out = named.join(_explained(rolling_grid(vecs, specs)), "spec", "left").drop("spec")
    every = W.partitionBy()  # a row for each specification
    z = lambda c: F.coalesce(div(F.col(c) - F.avg(c).over(every), F.stddev_pop(c).over(every)), F.lit(0.0))
    score = z("r2") + z("corr_reduction") + z("stability") - z("vol_ratio") - z("resid_corr") - z("share_below")
    scored = out.withColumn("score", F.when(F.col("n_obs").isNotNull(), score))
    return scored.withColumn("rank", F.when(F.col("n_obs").isNotNull(), F.row_number().over(W.orderBy(F.desc_nulls_last("score"), "T", "m", "tau_fast", "tau_slow"))))


def grid_summary(grid: DataFrame, by: str) -> DataFrame:
    """Means of the grid's main measures by one of its parameters, over the specifications that could be fitted."""
    names = ("r2", "min_r2", "vol_ratio", "resid_corr", "max_resid_corr", "stability", "share_below", "cumevr")
    return grid.groupBy(by).agg(F.count("n_obs").alias("specs"), *(F.avg(n).alias(n) for n in names))
