"""Tests and regressions: Newey-West, Welch, panel OLS with clustered errors, p-values, serial correlation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tenorlake.functions.nulls import c, div

# --- distributions


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, evaluated from the tail."""
    d = np.ones_like(x)
    for k in range(300, 0, -1):
        m = k // 2
        if k % 2 == 0:
            t = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            t = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + t / d
    return 1 / d


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised; vectorised."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    x = np.clip(x, 0, 1)
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    low = x < (a + 1) / (a + b + 2)
    direct = front * _beta_fraction(np.where(low, a, b), np.where(low, b, a), np.where(low, inner, 1 - inner)) / np.where(low, a, b)
    out = np.where(low, direct, 1 - direct)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of Student's t."""
    v, n = t.to_numpy(float), df.to_numpy(float)
    ok = np.isfinite(v) & np.isfinite(n) & (n > 0)
    v, n = np.where(ok, v, 0), np.where(ok, n, 1)
    return pd.Series(np.where(ok, incomplete_beta(n / 2, 0.5, n / (n + v * v)), np.nan)).replace({np.nan: None}).astype(float)


@F.pandas_udf(T.DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    v, a, b = f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)
    ok = np.isfinite(v) & (v >= 0) & (a > 0) & (b > 0)
    v, a, b = np.where(ok, v, 0), np.where(ok, a, 1), np.where(ok, b, 1)
    return pd.Series(np.where(ok, incomplete_beta(b / 2, a / 2, b / (b + a * v)), np.nan))


@F.pandas_udf(T.DoubleType())
def normal_pvalue(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)), na_action="ignore").astype(float)


# --- means


def t_stat(x: Column | str) -> Column:
    """Aggregate: mean over its standard error."""
    return div(F.avg(c(x)), F.stddev_samp(c(x)) / F.sqrt(F.count(c(x)).cast("double")))


def sem(x: Column | str) -> Column:
    return F.stddev_samp(c(x)) / F.sqrt(F.when(F.count(c(x)) > 0, F.count(c(x)).cast("double")))


def sharpe(x: Column | str, periods: int = 252) -> Column:
    return div(F.avg(c(x)), F.stddev_samp(c(x))) * math.sqrt(periods)


def welch(x: Column | str, cond: Column) -> Column:
    """Aggregate: t of the mean where ``cond`` holds less the mean elsewhere."""
    a, b = F.when(cond, c(x)), F.when(~cond, c(x))
    spread = F.var_samp(a) / F.when(F.count(a) > 0, F.count(a)) + F.var_samp(b) / F.when(F.count(b) > 0, F.count(b))
    return div(F.avg(a) - F.avg(b), F.sqrt(spread))


def newey_west(df: DataFrame, x: str, keys: tuple[str, ...], order: str, lags: int | None = None, least: int = 10) -> DataFrame:
    """(keys, n, mean, t_nw): Bartlett weights over floor(4 (n / 100) ** (2/9)) lags; below ``least`` values NULL.

    Autocovariances come from an equi-join of each row with the rows before it.
    """
    w = W.partitionBy(*keys)
    u = df.where(F.col(x).isNotNull()).select(*keys, (F.col(x) - F.avg(x).over(w)).alias("u"), F.avg(x).over(w).alias("mean"), F.count("*").over(w).alias("n"), F.row_number().over(w.orderBy(order)).alias("i"))
    most = F.lit(lags) if lags is not None else F.floor(4 * F.pow(F.col("n") / 100.0, F.lit(2 / 9))).cast("int")
    late = u.withColumn("most", most).withColumn("l", F.explode(F.sequence(F.lit(0), F.col("most"))))
    early = u.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("u").alias("__u"), F.col("i").alias("__i"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("i") - F.col("l") == F.col("__i")]
    cond = on[0]
    for o in on[1:]:
        cond &= o
    weight = F.when(F.col("l") == 0, 1.0).otherwise(2 * (1 - F.col("l") / (F.col("most") + 1.0)))
    s = late.join(early, cond).groupBy(*keys).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.sum(weight * F.col("u") * F.col("__u")).alias("s"))
    var = F.col("s") / F.col("n") / F.col("n")
    return s.select(*keys, "n", "mean", F.when((F.col("n") >= least) & (var > 0), F.col("mean") / F.sqrt(F.when(var > 0, var))).alias("t_nw"))


# --- regressions


def _moments(names: list[str]) -> list[Column]:
    return [F.sum(F.col(a) * F.col(b)).alias(f"m_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]


def _square(row: pd.Series, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = row[f"m_{i}_{j}"]
    return m


def within(df: DataFrame, columns: list[str], effects: tuple[str, ...]) -> DataFrame:
    """One pass of demeaning over each effect in turn; exact for balanced panels."""
    for e in effects:
        df = df.select(*(n for n in df.columns if n not in columns), *((F.col(n) - F.avg(n).over(W.partitionBy(*(["__group"] if "__group" in df.columns else []), e))).alias(n) for n in columns))
    return df


def _wald(m: np.ndarray, b: np.ndarray, v: np.ndarray) -> float:
    """F of the restrictions m b = 0; NaN if they depend on each other."""
    inner = m @ v @ m.T
    if np.linalg.matrix_rank(inner, hermitian=True) < len(m):
        return np.nan
    return float((m @ b) @ np.linalg.solve(inner, m @ b)) / len(m)


def panel_ols(df: DataFrame, y: str, xs: list[str], group: str | None = None, effects: tuple[str, ...] = (), cluster: str = "quote_date", least: int = 30, restrictions: dict[str, list[dict[str, float]]] | None = None) -> DataFrame:
    """(group, term, coef, se, t, p, r2_adj, n, clusters, wald_f): OLS after within-demeaning, errors clustered by ``cluster``.

    With ``restrictions`` (name -> rows of weights by term, each row's weighted sum being 0 under the null) the result is
    (group, test, f, df1, df2, p): the Wald tests R beta = 0; NULL where a test's rows are dependent.

    Correction G / (G - 1) (n - 1) / (n - k). ``wald_f`` tests all terms but the constant. Groups with fewer than ``least`` rows, or singular ones, give no row.
    All sums are distributed; per group only k x k matrices reach a Python function.
    """
    xs = list(xs)
    k = len(xs) + 1
    names = ["__c", *(f"__x{i}" for i in range(len(xs)))]
    rows = df.dropna(subset=[y, *xs, *effects, cluster]).select((F.col(group) if group else F.lit("all")).cast("string").alias("__group"), F.col(cluster).alias("__cluster"), *(F.col(e).alias(f"__e{i}") for i, e in enumerate(effects)), F.col(y).cast("double").alias("__y"), *(F.col(x).cast("double").alias(f"__x{i}") for i, x in enumerate(xs)))
    rows = within(rows, ["__y", *names[1:]], tuple(f"__e{i}" for i in range(len(effects)))).withColumn("__c", F.lit(1.0))
    sums = rows.groupBy("__group").agg(*_moments([*names, "__y"]), F.count("*").alias("n"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _square(pdf.iloc[0], k + 1)
        a = m[:k, :k]
        if pdf.n.iloc[0] < least or np.linalg.matrix_rank(a, hermitian=True) < k:
            return pd.DataFrame({"__group": [], "beta": [], "inverse": []}, dtype=object)
        inv = np.linalg.inv(a)
        return pd.DataFrame({"__group": [pdf["__group"].iloc[0]], "beta": [inv @ m[:k, k]], "inverse": [inv.ravel()]})

    beta = sums.groupBy("__group").applyInPandas(solve, "__group string, beta array<double>, inverse array<double>")
    fit = sum((F.col("beta")[i] * F.col(n) for i, n in enumerate(names)), F.lit(0.0))
    left = rows.join(beta.select("__group", "beta"), "__group").withColumn("__u", F.col("__y") - fit)
    score = left.groupBy("__group", "__cluster").agg(*(F.sum(F.col(n) * F.col("__u")).alias(n) for n in names), F.sum(F.col("__u") * F.col("__u")).alias("ssr"), F.sum("__y").alias("sy"), F.sum(F.col("__y") * F.col("__y")).alias("syy"), F.count("*").alias("rows"))
    meat = score.groupBy("__group").agg(*_moments(names), F.sum("ssr").alias("ssr"), F.sum("sy").alias("sy"), F.sum("syy").alias("syy"), F.sum("rows").alias("n"), F.count("*").alias("clusters"))

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        inv, b, n, g = np.array(r.inverse).reshape(k, k), np.array(r.beta), int(r.n), int(r.clusters)
        v = inv @ _square(r, k) @ inv * (g / max(g - 1, 1)) * ((n - 1) / max(n - k, 1))
        if restrictions:
            tests = [(name, np.array([[row.get(x, 0.0) for x in ["const", *xs]] for row in rows])) for name, rows in restrictions.items()]
            return pd.DataFrame({"group": r["__group"], "test": [name for name, _ in tests], "f": [_wald(m, b, v) for _, m in tests], "df1": [len(m) for _, m in tests], "df2": g - 1})
        se = np.sqrt(np.maximum(np.diag(v), 0))
        t = np.divide(b, se, out=np.full(k, np.nan), where=se > 0)
        sst = r.syy - r.sy**2 / n
        adj = 1 - (r.ssr / max(n - k, 1)) / (sst / (n - 1)) if sst > 0 else np.nan
        wald = _wald(np.eye(k)[1:], b, v) if k > 1 else np.nan
        return pd.DataFrame({"group": r["__group"], "term": ["const", *xs], "coef": b, "se": se, "t": t, "df": g - 1, "r2_adj": adj, "n": n, "clusters": g, "wald_f": wald})

    null = lambda name: F.nanvl(name, F.lit(None).cast("double"))
    if restrictions:
        tests = meat.join(beta, "__group").groupBy("__group").applyInPandas(table, "group string, test string, f double, df1 long, df2 long")
        return tests.select("group", "test", null("f").alias("f"), "df1", "df2", null(f_pvalue(F.col("f"), F.col("df1").cast("double"), F.col("df2").cast("double"))).alias("p"))
    out = meat.join(beta, "__group").groupBy("__group").applyInPandas(table, "group string, term string, coef double, se double, t double, df long, r2_adj double, n long, clusters long, wald_f double")
    return out.select("group", "term", "coef", "se", null("t").alias("t"), null(t_pvalue(F.col("t"), F.col("df").cast("double"))).alias("p"), null("r2_adj").alias("r2_adj"), "n", "clusters", null("wald_f").alias("wald_f"))


def hac_ols(df: DataFrame, y: str, xs: list[str], key: str, order: str, lags: int = 5) -> DataFrame:
    """(key, term, coef, t, r2): OLS of one series per key with Newey-West errors. A task holds one series."""
    k = len(xs) + 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = np.column_stack([np.ones(len(pdf)), pdf[list(xs)].to_numpy(float)])
        v = pdf[y].to_numpy(float)
        ok = np.isfinite(x).all(1) & np.isfinite(v)
        x, v = x[ok], v[ok]
        if len(v) <= k:
            return pd.DataFrame({"key": [], "term": [], "coef": [], "t": [], "r2": []}, dtype=object)
        inv = np.linalg.pinv(x.T @ x)
        b = inv @ x.T @ v
        s = x * (v - x @ b)[:, None]
        meat = s.T @ s
        for lag in range(1, min(lags, len(v) - 1) + 1):
            g = s[lag:].T @ s[:-lag]
            meat += (1 - lag / (lags + 1)) * (g + g.T)
        se = np.sqrt(np.maximum(np.diag(inv @ meat @ inv), 0))
        sst = ((v - v.mean()) ** 2).sum()
        return pd.DataFrame({"key": str(pdf[key].iloc[0]), "term": ["const", *xs], "coef": b, "t": np.divide(b, se, out=np.full(k, np.nan), where=se > 0), "r2": 1 - ((v - x @ b) ** 2).sum() / sst if sst > 0 else np.nan})

    return df.select(key, order, y, *xs).groupBy(key).applyInPandas(run, "key string, term string, coef double, t double, r2 double")


# --- serial dependence


def autocorrelation(df: DataFrame, x: str, keys: tuple[str, ...], order: str, most: int = 10) -> DataFrame:
    """(keys, lag, acf, n)."""
    w = W.partitionBy(*keys)
    u = df.where(F.col(x).isNotNull()).select(*keys, order, (F.col(x) - F.avg(x).over(w)).alias("u"))
    late = u.select(*keys, "u", F.array(*(F.lag("u", k).over(w.orderBy(order)) for k in range(1, most + 1))).alias("vs")).select(*keys, "u", F.posexplode("vs").alias("lag", "v"))
    return late.groupBy(*keys, (F.col("lag") + 1).alias("lag")).agg(div(F.sum(F.col("u") * F.col("v")), F.sum(F.col("u") * F.col("u"))).alias("acf"), F.count("*").alias("n"))


def ljung_box(acf: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, q, lags)."""
    return acf.groupBy(*keys).agg((F.first("n") * (F.first("n") + 2) * F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag")))).alias("q"), F.count("*").alias("lags"))


def arch_lm(df: DataFrame, x: str, keys: tuple[str, ...], order: str, lags: int = 5) -> DataFrame:
    """(keys, lm): n R2 of squared deviations on their own lags."""
    w = W.partitionBy(*keys)
    e = df.where(F.col(x).isNotNull()).select(*keys, order, F.pow(F.col(x) - F.avg(x).over(w), F.lit(2)).alias("e0"))
    e = e.select("*", *(F.lag("e0", k).over(w.orderBy(order)).alias(f"e{k}") for k in range(1, lags + 1))).dropna()
    e = e.withColumn("__key", F.concat_ws("|", *keys))
    out = hac_ols(e, "e0", [f"e{k}" for k in range(1, lags + 1)], "__key", order, 0).where("term = 'const'").select("key", "r2")
    n = e.groupBy(F.col("__key").alias("key")).agg(F.count("*").alias("n"))
    return n.join(out, "key").select("key", (F.col("n") * F.col("r2")).alias("lm"))


def partial_autocorrelation(acf: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, lag, pacf) from (keys, lag, acf) of lags 1, 2, ..: the last coefficient of the Yule-Walker equations of each order, by Durbin's recursion.

    A key's autocorrelations, as many as its lags, meet in one row.
    """
    every = acf.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda x: x["acf"]).alias("r"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)

    def step(state: Column, k: Column) -> Column:
        phi, back = state["phi"], F.reverse(F.slice(F.col("r"), 1, F.size(state["phi"])))
        last = div(F.get(F.col("r"), k) - dot(phi, back), 1 - dot(phi, F.slice(F.col("r"), 1, F.size(phi))))
        grown = F.concat(F.zip_with(phi, F.reverse(phi), lambda a, b: a - last * b), F.array(last))
        return F.struct(grown.alias("phi"), F.concat(state["out"], F.array(last)).alias("out"))

    none = F.array().cast("array<double>")
    out = F.aggregate(F.sequence(F.lit(0), F.size("r") - 1), F.struct(none.alias("phi"), none.alias("out")), step)["out"]
    return every.select(*keys, F.posexplode(out).alias("lag", "pacf")).withColumn("lag", (F.col("lag") + 1).cast("int"))


# Critical values of the level test and their tail probabilities (Kwiatkowski and others, 1992).
KPSS_LEVEL = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))


def kpss(df: DataFrame, x: str, keys: tuple[str, ...], order: str, lags: int | None = None, most: int = 60) -> DataFrame:
    """(keys, kpss, p, lags, n): the test of stationarity around a level.

    ``lags`` of the Bartlett window: None chooses them from the data (Hobijn and
    others, 1998), ``most`` at most. p is interpolated and lies in 0.01 to 0.10. A constant series gives NULLs.
    """
    w = W.partitionBy(*keys)
    u = df.where(F.col(x).isNotNull()).select(*keys, order, (F.col(x) - F.avg(x).over(w)).alias("u"))
    run = u.select(*keys, "u", F.sum("u").over(w.orderBy(order).rowsBetween(W.unboundedPreceding, 0)).alias("s"))
    base = run.groupBy(*keys).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("u") * F.col("u")).alias("uu"), F.count("*").alias("n"))
    acf = autocorrelation(df, x, keys, order, most).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda v: F.coalesce(v["acf"], F.lit(0.0))).alias("r"))
    total = lambda upto, weight: F.aggregate(F.transform(F.slice("r", F.lit(1), upto), lambda v, i: v * weight(i + 1)), F.lit(0.0), lambda a, v: a + v)
    few = F.floor(F.pow("n", F.lit(2 / 9))).cast("int")
    slope = div(2 * total(few, lambda i: i.cast("double")), 1 + 2 * total(few, lambda i: F.lit(1.0)))
    auto = F.floor(F.lit(1.1447) * F.pow(slope * slope, F.lit(1 / 3)) * F.pow("n", F.lit(1 / 3)))
    chosen = F.lit(lags) if lags is not None else F.least(auto, F.col("n") - 1, F.lit(most))
    wide = base.join(acf, list(keys)).withColumn("lags", F.coalesce(chosen, F.lit(0)).cast("int"))
    spread = F.col("uu") / F.col("n") * (1 + 2 * total(F.col("lags"), lambda i: 1 - i / (F.col("lags") + 1)))
    wide = wide.withColumn("kpss", div(F.col("ss") / (F.col("n") * F.col("n")), spread))
    p = F.lit(KPSS_LEVEL[-1][1])
    for (a, pa), (b, pb) in reversed(list(zip(KPSS_LEVEL, KPSS_LEVEL[1:], strict=False))):
        p = F.when(F.col("kpss") < b, pa + (F.col("kpss") - a) / (b - a) * (pb - pa)).otherwise(p)
    p = F.when(F.col("kpss") < KPSS_LEVEL[0][0], KPSS_LEVEL[0][1]).otherwise(p)
    return wide.select(*keys, "kpss", F.when(F.col("kpss").isNotNull(), p).alias("p"), "lags", "n")


# Response surface of the test with a constant (MacKinnon, 1994): the argument's polynomial below and above the bend.
ADF_BEND, ADF_LOW, ADF_HIGH = -1.61, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
ADF_LEAST, ADF_MOST = -18.83, 2.74


def adf_pvalue(t: Column | str) -> Column:
    """Approximate probability of a smaller Dickey-Fuller t under a unit root."""
    t = c(t)
    poly = lambda ks: sum((F.lit(k) * F.pow(t, F.lit(float(i))) for i, k in enumerate(ks)), F.lit(0.0))
    z = F.when(t <= ADF_BEND, poly(ADF_LOW)).otherwise(poly(ADF_HIGH))
    below = lambda v: F.when(v < 0, normal_pvalue(v) / 2).otherwise(1 - normal_pvalue(v) / 2)
    return F.when(t < ADF_LEAST, 0.0).when(t > ADF_MOST, 1.0).otherwise(below(z))


def _adf(y: np.ndarray, lags: int, rows: int) -> tuple[float, float]:
    """t of the level and AIC of the regression with that many lagged differences, over the last ``rows`` differences."""
    d = np.diff(y)
    v = d[len(d) - rows :]
    x = np.column_stack([np.ones(rows), y[-rows - 1 : -1], *(d[len(d) - rows - i : len(d) - i] for i in range(1, lags + 1))])
    if rows <= x.shape[1] or np.linalg.matrix_rank(x) < x.shape[1]:
        return np.nan, np.inf
    inv = np.linalg.inv(x.T @ x)
    b = inv @ x.T @ v
    ssr = float(((v - x @ b) ** 2).sum())
    if ssr <= 0:
        return np.nan, np.inf
    return b[1] / math.sqrt(ssr / (rows - x.shape[1]) * inv[1, 1]), rows * (math.log(2 * math.pi * ssr / rows) + 1) + 2 * x.shape[1]


def unit_root(df: DataFrame, x: str, key: str, order: str, lags: int | None = None) -> DataFrame:
    """(key, adf_t, p, lags, n): Dickey-Fuller t of the level in a regression of differences on it, a constant and lagged differences.

    ``lags`` None: those of the least AIC among 0 to 12 (n / 100)^(1/4), compared over the same rows. A task holds one series; short or constant ones give NULLs.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.dropna(subset=[x]).sort_values(order)[x].to_numpy(float)
        n, best = len(y), lags
        if best is None:
            most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
            tried = [_adf(y, k, n - 1 - most)[1] for k in range(most + 1)]
            best = int(np.argmin(tried)) if tried else 0
        t = _adf(y, best, n - 1 - best)[0] if n - 1 - best > 0 else np.nan
        return pd.DataFrame({"key": [str(pdf[key].iloc[0])], "adf_t": [t], "lags": [best], "n": [max(n - 1 - best, 0)]})

    out = df.select(key, order, x).groupBy(key).applyInPandas(run, "key string, adf_t double, lags int, n long").withColumn("adf_t", F.nanvl("adf_t", F.lit(None).cast("double")))
    return out.select("key", "adf_t", F.when(F.col("adf_t").isNotNull(), adf_pvalue("adf_t")).alias("p"), "lags", "n")
