"""Window features of panels: residual features, forward targets, smoothing, standardisation, drawdown."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tenorlake.functions.nulls import c, clip, div, is_close, rolling, rows

#: Names of the residual features, in order.
RESIDUAL_FEATURES = (
    "eps", "eps_lag_1", "eps_lag_5", "eps_rolling_mean_5", "eps_rolling_mean_20", "eps_rolling_std_20", "eps_rolling_std_63", "eps_zscore_20", "eps_zscore_63",
    "eps_momentum_5", "eps_momentum_20", "cum_dislocation_5", "cum_dislocation_20", "eps_cum5_zscore", "eps_vs_curve", "eps_curve_std", "eps_local_curvature",
)


def demeaned(returns: DataFrame, r: str = "r", out: str = "eps") -> DataFrame:
    """Return less the mean of its date: a first residual."""
    return returns.select("date", "tenor", (F.col(r) - F.avg(r).over(W.partitionBy("date"))).alias(out))


def residual_features(eps: DataFrame, x: str = "eps", keys: tuple[str, ...] = ("tenor",)) -> DataFrame:
    """(date, tenor) and the 17 residual features. One shuffle by tenor and one by date."""
    order = ["date"]
    frame = lambda n: rows(keys, order, -n + 1, 0)
    along = W.partitionBy(*keys).orderBy(*order)
    e = eps.select("date", "tenor", F.col(x).alias("eps"))
    e = e.select(
        "*",
        F.lag("eps", 1).over(along).alias("eps_lag_1"),
        F.lag("eps", 5).over(along).alias("eps_lag_5"),
        rolling(F.avg, "eps", frame(5), 3).alias("eps_rolling_mean_5"),
        rolling(F.avg, "eps", frame(20), 10).alias("eps_rolling_mean_20"),
        rolling(F.stddev_samp, "eps", frame(20), 10).alias("eps_rolling_std_20"),
        rolling(F.stddev_samp, "eps", frame(63), 30).alias("eps_rolling_std_63"),
        rolling(F.sum, "eps", frame(5), 3).alias("cum_dislocation_5"),
        rolling(F.sum, "eps", frame(20), 10).alias("cum_dislocation_20"),
    )
    day, curve = W.partitionBy("date"), W.partitionBy("date").orderBy("tenor")
    near = {k: F.lead("eps", k).over(curve) for k in (-2, -1, 0, 1, 2)}
    place, n = F.row_number().over(curve), F.count("*").over(day)
    second = lambda a, b, d: near[a] - 2 * near[b] + near[d]
    bend = F.when(n < 3, F.lit(None).cast("double")).when(place == 1, second(2, 1, 0)).when(place == n, second(0, -1, -2)).otherwise(second(1, 0, -1))
    out = e.select(
        "*",
        div("eps", "eps_rolling_std_20").alias("eps_zscore_20"),
        div("eps", "eps_rolling_std_63").alias("eps_zscore_63"),
        div("eps_rolling_mean_5", "eps_rolling_std_20").alias("eps_momentum_5"),
        div("eps_rolling_mean_20", "eps_rolling_std_20").alias("eps_momentum_20"),
        div("cum_dislocation_5", math.sqrt(5) * F.col("eps_rolling_std_63")).alias("eps_cum5_zscore"),
        (F.col("eps") - F.avg("eps").over(day)).alias("eps_vs_curve"),
        F.stddev_samp("eps").over(day).alias("eps_curve_std"),
        bend.alias("eps_local_curvature"),
    )
    return out.select("date", "tenor", *RESIDUAL_FEATURES)


def forward_target(eps: DataFrame, x: str = "eps", horizon: int = 5, vol: int = 63, least: int = 30, bound: float = 10.0) -> DataFrame:
    """(date, tenor, y_raw, y_z): sum of the next values; over sqrt(horizon) times trailing deviation, clipped."""
    ahead = rows(("tenor",), ["date"], 1, horizon)
    raw = rolling(F.sum, x, ahead, horizon)
    sd = rolling(F.stddev_samp, x, rows(("tenor",), ["date"], -vol + 1, 0), least)
    out = eps.select("date", "tenor", raw.alias("y_raw"), sd.alias("__sd"))
    return out.select("date", "tenor", "y_raw", clip(div("y_raw", math.sqrt(horizon) * F.col("__sd")), -bound, bound).alias("y_z"))


def ewm(df: DataFrame, x: str, alpha: float, keys: tuple[str, ...], order: str = "date", out: str = "ewm") -> DataFrame:
    """Exponentially weighted mean of all values so far, weights (1 - alpha) ** (rows back); gaps count as rows, a NULL row carries the value before.

    Both sums share the factor (1 - alpha) ** row, so they are running sums of
    x (1 - alpha) ** -row. Rows are numbered within blocks short enough for
    that power to stay in range; the blocks' totals are carried over.
    """
    decay = 1 - alpha
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    if decay == 0:
        return df.withColumn(out, F.last(x, True).over(rows(keys, [order], None, 0)))
    size = max(1, int(300 / -math.log(decay)))
    n = F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1
    e = df.withColumn("__n", n).withColumn("__b", F.floor(F.col("__n") / size)).withColumn("__k", F.col("__n") % size)
    up = F.pow(F.lit(decay), -F.col("__k").cast("double"))
    w = W.partitionBy(*keys, "__b").orderBy("__k").rowsBetween(W.unboundedPreceding, 0)
    e = e.withColumn("__s", F.coalesce(F.sum(F.when(c(x).isNotNull(), c(x) * up)).over(w), F.lit(0.0))).withColumn("__t", F.coalesce(F.sum(F.when(c(x).isNotNull(), up)).over(w), F.lit(0.0)))
    # totals at each block's end, in units of the next block's first row
    ends = e.groupBy(*keys, "__b").agg(F.max_by(F.struct("__k", "__s", "__t"), "__k").alias("z"))
    ends = ends.select(*keys, F.col("__b").alias("__b"), (F.col("z.__s") * F.pow(F.lit(decay), F.col("z.__k") + 1.0)).alias("es"), (F.col("z.__t") * F.pow(F.lit(decay), F.col("z.__k") + 1.0)).alias("et"))
    # a block decays the one before by decay ** size, below 1e-130; two blocks back are beyond double precision
    before = ends.select(*keys, (F.col("__b") + 1).alias("__b"), "es", "et")
    j = e.join(before, [*keys, "__b"], "left")
    num, den = F.col("__s") + F.coalesce("es", F.lit(0.0)), F.col("__t") + F.coalesce("et", F.lit(0.0))
    return j.withColumn(out, div(num, den)).select(*df.columns, out)


def overlap(weights: DataFrame, w: str = "weight", window: int = 5, lag: int = 2, keys: tuple[str, ...] = ("tenor",)) -> DataFrame:
    """Held weight: mean of ``window`` signals, traded ``lag`` rows later."""
    return weights.withColumn("held", F.avg(w).over(rows(keys, ["date"], -lag - window + 1, -lag)))


def z_by(x: Column | str, keys: tuple[str, ...]) -> Column:
    """Cross-sectional z-score."""
    w = W.partitionBy(*keys)
    return div(c(x) - F.avg(c(x)).over(w), F.stddev_samp(c(x)).over(w))


def expanding_z(x: Column | str, keys: tuple[str, ...], order: list[str], least: int = 30) -> Column:
    """Against the mean and deviation of earlier rows only, if there are ``least``."""
    w = rows(keys, order, None, -1)
    return F.when(F.count(c(x)).over(w) >= least, div(c(x) - F.avg(c(x)).over(w), F.stddev_samp(c(x)).over(w)))


def drawdown(df: DataFrame, x: str, keys: tuple[str, ...], order: str) -> DataFrame:
    """cum: running sum; drawdown: cum less its running maximum."""
    w = rows(keys, [order], None, 0)
    cum = df.withColumn("cum", F.sum(x).over(w))
    return cum.withColumn("drawdown", F.col("cum") - F.max("cum").over(w))


def lag_check(df: DataFrame, value: str, lagged: str, keys: tuple[str, ...], order: str = "date") -> DataFrame:
    """passed and total: whether ``lagged`` is the value of the row before; NULL equals NULL."""
    ok = is_close(lagged, F.lag(value).over(W.partitionBy(*keys).orderBy(order)))
    return df.select(ok.alias("ok")).agg(F.count_if("ok").alias("passed"), F.count("*").alias("total"))
