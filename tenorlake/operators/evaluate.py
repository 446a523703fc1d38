"""Diagnostics of predictions: rank correlations by date, slot, tenor and segment; decay; calibration; comparison; P&L rules; importance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tenorlake.functions.nulls import avg_rank, c, corr, div, flag, inner_edges, rolling, rows
from tenorlake.operators import econ


def spearman(df: DataFrame, x: str, y: str, keys: tuple[str, ...], least: int = 4, out: str = "ic") -> DataFrame:
    """(keys, n, out): rank correlation of complete pairs; groups with fewer than ``least`` pairs give no row, constant sides NULL."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.select(*keys, avg_rank(x, keys).alias("__x"), avg_rank(y, keys).alias("__y"))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), corr("__x", "__y").alias(out)).where(F.col("n") >= least)


def ic_summary(ic: DataFrame, keys: tuple[str, ...] = (), x: str = "ic") -> DataFrame:
    return ic.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean_ic"), econ.sem(x).alias("sem"), div(F.avg(x), F.stddev_samp(x)).alias("icir"), econ.t_stat(x).alias("t"))


def rolling_ic(ic: DataFrame, window: int = 63, least: int = 21, keys: tuple[str, ...] = ()) -> DataFrame:
    w = rows(keys, ["date"], -window + 1, 0)
    m, s = rolling(F.avg, "ic", w, least), rolling(F.stddev_samp, "ic", w, least)
    return ic.select("*", m.alias("ic_mean"), s.alias("ic_std"), div(m, s).alias("icir_roll"), F.sum("ic").over(rows(keys, ["date"], None, 0)).alias("ic_cum"))


def decay(df: DataFrame, signal: str, value: str, most: int = 10) -> DataFrame:
    """(h, mean_ic, t, n): rank correlation of the signal with the value h rows later, averaged over dates."""
    w = W.partitionBy("tenor").orderBy("date")
    ahead = df.select("date", "tenor", signal, F.array(*(F.lead(value, h).over(w) for h in range(1, most + 1))).alias("vs")).select("date", "tenor", signal, F.posexplode("vs").alias("h", "v"))
    ic = spearman(ahead.withColumn("h", F.col("h") + 1), signal, "v", ("date", "h"))
    return ic.groupBy("h").agg(F.avg("ic").alias("mean_ic"), econ.t_stat("ic").alias("t"), F.count("ic").alias("n"))


def intraday_ic(df: DataFrame, x: str, y: str, keys: tuple[str, ...] = (), date: str = "quote_date", slot: str = "quote_time", least: int = 4) -> DataFrame:
    """(keys, date, ic): mean over the day's slots; a day without any is there with NULL (dead)."""
    ic = spearman(df, x, y, (*keys, date, slot), least)
    day = ic.groupBy(*keys, date).agg(F.avg("ic").alias("ic"))
    return df.select(*keys, date).distinct().join(day, [*keys, date], "left")


def icir(daily: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, icir, ic_mean, dead_days): dead days count as 0."""
    x = F.coalesce("ic", F.lit(0.0))
    return daily.groupBy(*keys).agg(div(F.avg(x), F.stddev_samp(x)).alias("icir"), F.avg(x).alias("ic_mean"), F.count_if(F.col("ic").isNull()).alias("dead_days"))


def by_tenor(df: DataFrame, x: str, y: str, least: int = 10) -> DataFrame:
    """(tenor, n, ic, mse): rank correlation over time."""
    ic = spearman(df, x, y, ("tenor",), least)
    mse = df.groupBy("tenor").agg(F.avg((F.col(x) - F.col(y)) * (F.col(x) - F.col(y))).alias("mse"))
    return ic.join(mse, "tenor")


def calibration(df: DataFrame, x: str, y: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, slope, intercept) of y on x."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    slope = div(F.covar_pop(a, b), F.var_pop(a))
    return df.groupBy(*keys).agg(slope.alias("slope"), (F.avg(b) - slope * F.avg(a)).alias("intercept"))


def segments(tenor: Column | str, bounds: tuple[tuple[str, int, int], ...] = (("front", 1, 2), ("belly", 3, 5), ("back", 6, 99))) -> Column:
    out = F.lit(None).cast("string")
    for name, lo, hi in reversed(bounds):
        out = F.when(c(tenor).between(lo, hi), name).otherwise(out)
    return out


def hit_rate(x: str, y: str) -> Column:
    """Aggregate: share of equal signs."""
    return F.avg(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), flag(F.signum(x) == F.signum(y))))


def regression_scores(x: str, y: str) -> list[Column]:
    """Aggregates: r2, rmse, mae, corr of predictions x of y."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    e = b - a
    return [(1 - div(F.sum(e * e), F.var_pop(b) * F.count(b))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), corr(a, b).alias("corr")]


def comparison(df: DataFrame, x: str, y: str, train: str, model: str = "model_id") -> DataFrame:
    """By model: icir, ic_oos, ic_tstat, ic_dead_days, ic_gap, dir_acc, mae, r2, p and Benjamini-Hochberg-Yekutieli significance at 10 %.

    ``train``: boolean column; its rows only serve ic_gap.
    """
    daily = intraday_ic(df, x, y, (model, train))
    oos = icir(daily.where(~F.col(train)), (model,)).withColumnRenamed("ic_mean", "ic_oos").withColumnRenamed("dead_days", "ic_dead_days")
    inside = daily.where(F.col(train)).groupBy(model).agg(F.avg(F.coalesce("ic", F.lit(0.0))).alias("ic_train"))
    nw = econ.newey_west(daily.where(~F.col(train)).withColumn("ic", F.coalesce("ic", F.lit(0.0))), "ic", (model,), "quote_date").select(model, F.col("t_nw").alias("ic_tstat"))
    fit = df.where(~F.col(train)).groupBy(model).agg(hit_rate(x, y).alias("dir_acc"), *(s for s in regression_scores(x, y)))
    out = oos.join(nw, model).join(fit.select(model, "dir_acc", "mae", "r2"), model).join(inside, model, "left").withColumn("ic_gap", F.col("ic_train") - F.col("ic_oos")).drop("ic_train")
    out = out.withColumn("p", econ.normal_pvalue("ic_tstat"))
    m = F.count("p").over(W.partitionBy())
    rank = F.row_number().over(W.orderBy(F.col("p").asc_nulls_last(), model))
    harmonic = F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1)).cast("int")), F.lit(0.0), lambda s, k: s + 1 / k.cast("double"))
    passed = F.when(F.col("p") <= 0.10 * rank / (m * harmonic), rank)
    out = out.withColumn("__rank", rank).withColumn("__pass", passed)
    return out.withColumn("sig_bhy", F.coalesce(F.col("__rank") <= F.max("__pass").over(W.partitionBy()), F.lit(False))).drop("__rank", "__pass")


# --- P&L


def sign_rule(sign: str = "sign", long: str = "target_y_long_net", short: str = "target_y_short_net") -> Column:
    return F.when(F.col(sign) == 1, F.col(long)).otherwise(F.col(short))


def extremes(df: DataFrame, x: str, k: int, keys: tuple[str, ...], tie: tuple[str, ...]) -> DataFrame:
    """``position``: 1 for the k largest of each group, -1 for the k smallest, else 0; the short side wins."""
    w = W.partitionBy(*keys)
    up, n = F.row_number().over(w.orderBy(x, *tie)), F.count("*").over(w)
    return df.where(F.col(x).isNotNull()).withColumn("position", F.when(up <= k, -1).when(up > n - k, 1).otherwise(0))


def pnl_matrix(rules: dict[str, DataFrame], pnl: str, family: str, bar: str, date: str, least: int = 10) -> DataFrame:
    """(rule, family, bar, n, mean_bps, t_nw): mean and Newey-West t of the daily sums of P&L by family and bar; NULL below ``least`` days."""
    every = None
    for name, df in rules.items():
        one = df.groupBy(F.lit(name).alias("rule"), family, bar, date).agg(F.sum(pnl).alias("s"))
        every = one if every is None else every.unionByName(one)
    t = econ.newey_west(every, "s", ("rule", family, bar), date, least=least)
    return t.select("rule", family, bar, "n", F.when(F.col("n") >= least, F.col("mean") * 1e4).alias("mean_bps"), "t_nw")


def threshold_rule(x: str, bound: float) -> Column:
    return F.when(F.abs(x) >= bound, F.signum(x)).otherwise(0.0)


def quantile_bins(df: DataFrame, x: str, q: int, keys: tuple[str, ...] = (), out: str = "bin") -> DataFrame:
    """``out``: right-closed bin 1..q by interpolated quantiles of the group. The edges are one small row per group."""
    edges = df.groupBy(*keys).agg(inner_edges(x, q).alias("__edges"))
    both = df.join(F.broadcast(edges), list(keys)) if keys else df.crossJoin(F.broadcast(edges))
    bin_ = F.when(F.col(x).isNotNull(), 1 + sum(((F.col(x) > F.col("__edges")[i]).cast("int") for i in range(q - 1)), F.lit(0)))
    return both.withColumn(out, bin_).drop("__edges")


def by_bin(df: DataFrame, bin_: str, y: str) -> DataFrame:
    """(bin, n, mean, se, ci95, t)."""
    return df.where(F.col(bin_).isNotNull()).groupBy(bin_).agg(F.count(y).alias("n"), F.avg(y).alias("mean"), econ.sem(y).alias("se"), (1.96 * econ.sem(y)).alias("ci95"), econ.t_stat(y).alias("t"))


# --- importance


def importance(df: DataFrame, n: int | None = None) -> DataFrame:
    """(type, feature, mean, std, rank): by mean, largest first; ``n`` keeps the top and bottom n of each type."""
    m = df.groupBy("type", "feature").agg(F.avg("importance").alias("mean"), F.stddev_samp("importance").alias("std"))
    w = W.partitionBy("type")
    m = m.withColumn("rank", F.row_number().over(w.orderBy(F.desc("mean"), "feature"))).withColumn("__n", F.count("*").over(w))
    return (m if n is None else m.where((F.col("rank") <= n) | (F.col("rank") > F.col("__n") - n))).drop("__n")


def family_contribution(imp: DataFrame, groups: dict[str, list[str]], value: str = "mean") -> DataFrame:
    """(type, family, total, pct): sums over each family's features, absent ones 0, and the share of all absolute sums."""
    spark = imp.sparkSession
    names = spark.createDataFrame([(g, f) for g, fs in groups.items() for f in fs], "family string, feature string")
    types = imp.select("type").distinct()
    every = types.crossJoin(F.broadcast(names)).join(imp.select("type", "feature", value), ["type", "feature"], "left")
    s = every.groupBy("type", "family").agg(F.sum(F.coalesce(value, F.lit(0.0))).alias("total"))
    return s.withColumn("pct", 100 * div("total", F.sum(F.abs("total")).over(W.partitionBy("type"))))
