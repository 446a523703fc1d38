"""Weather and storage features of a daily series: base, rolling, normals, surprises, forecasts, announcements.

A daily series has one row per date, so its windows have no key; a table of
many series takes ``keys`` and is partitioned by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tenorlake.functions import dates
from tenorlake.functions.nulls import clip, finite, rolling, rows
from tenorlake.operators import joins, ridge

COLS = ("HDD", "CDD")
NORMAL = "normal_4y_pm3d"


def base(df: DataFrame, lag: bool = False) -> DataFrame:
    """Squares, increases and decreases; with ``lag`` all from the day before."""
    w = W.orderBy("date")
    x = df.select(*[n for n in df.columns if n not in COLS], *((F.lag(n).over(w) if lag else F.col(n)).alias(n) for n in COLS))
    change = {n: F.col(n) - F.lag(n).over(w) for n in COLS}
    return x.select("*", *((F.col(n) * F.col(n)).alias(f"{n}2") for n in COLS), *(clip(change[n] * s, 0).alias(f"{n}_{d}") for n in COLS for d, s in (("inc", 1), ("dec", -1))))


def rolling_features(df: DataFrame) -> DataFrame:
    five, ten = rows((), ["date"], -4, 0), rows((), ["date"], -9, 0)
    made = []
    for n in COLS:
        made += [
            rolling(F.sum, n, five, 3).alias(f"{n}_sum_5d"),
            rolling(F.avg, n, five, 3).alias(f"{n}_mean_5d"),
            rolling(F.var_samp, n, five, 2).alias(f"{n}_var_5d"),
            rolling(F.sum, n, ten, 5).alias(f"{n}_sum_10d"),
            rolling(F.var_samp, n, ten, 5).alias(f"{n}_var_10d"),
        ]
    return df.select("*", *made)


def normals(df: DataFrame, cols: tuple[str, ...], years: int = 4, days: int = 3, least: int = 10, anomaly: bool = True, date: str = "date") -> DataFrame:
    """Mean of earlier years' values near the day of year. Values are first summed by (year, day), at most 366 rows a year.

    Each of these is sent to the (year, day) it counts for, so the join is an aggregate, not a loop.
    """
    cols = tuple(n for n in cols if n in df.columns)
    year, day = F.year(date).alias("__y"), F.dayofyear(date).alias("__d")
    good = {n: F.when(finite(n), F.col(n)) for n in cols}
    cells = df.groupBy(year, day).agg(*(F.sum(good[n]).alias(f"__s_{n}") for n in cols), *(F.count(good[n]).alias(f"__n_{n}") for n in cols))
    wanted = df.select(F.dayofyear(date).alias("__to")).distinct()
    near = wanted.crossJoin(F.broadcast(df.sparkSession.range(1, 367).select(F.col("id").cast("int").alias("__d")))).where(dates.cyclic_distance("__to", "__d") <= days)
    spread = cells.join(near, "__d").withColumn("__y", F.explode(F.sequence(F.col("__y") + 1, F.col("__y") + years)))
    norm = spread.groupBy("__y", "__to").agg(*(F.when(F.sum(f"__n_{n}") >= least, F.sum(f"__s_{n}") / F.sum(f"__n_{n}")).alias(f"{n}_normal_{years}y_pm{days}d") for n in cols))
    out = df.withColumn("__y", F.year(date)).withColumn("__to", F.dayofyear(date)).join(norm, ["__y", "__to"], "left").drop("__y", "__to")
    return out.select("*", *((F.col(n) - F.col(f"{n}_normal_{years}y_pm{days}d")).alias(f"{n}_anom_normal") for n in cols)) if anomaly else out


def design(df: DataFrame, col: str, normal: str | None, lags: tuple[int, ...] = (1, 2, 3, 5, 10), order: int = 2) -> DataFrame:
    """Columns x (array of regressors) and y, by row number t."""
    w = W.orderBy("date")
    terms = [*dates.fourier("date", order).values(), F.lit(1.0)]
    terms += [F.col(normal)] if normal and normal in df.columns else []
    terms += [F.lag(col, k).over(w) for k in sorted(lags)]
    x = F.array(*(F.when(finite(v), v) for v in terms))
    return df.select("date", (F.row_number().over(w) - 1).alias("t"), x.alias("x"), F.when(finite(col), F.col(col)).alias("y"))


def _sigma(u: str, window: int) -> Column:
    s = rolling(F.stddev_samp, u, rows((), ["date"], -window, -1), window // 2)
    return F.when(s != 0, s)


def surprises(df: DataFrame, cols: tuple[str, ...], suffix: str = NORMAL, train: int = 500, refit: int = 20, window: int = 756, sigma: int = 60, lags: tuple[int, ...] = (1, 2, 3, 5, 10)) -> DataFrame:
    """E_, U_ and Z_ of each column by walk-forward ridge regression."""
    out = df
    for n in (n for n in cols if n in df.columns):
        e = ridge.walk_forward(design(df, n, f"{n}_{suffix}", lags), train, refit, window).select("date", F.col("y_hat").alias(f"E_{n}"), F.col("u").alias(f"U_{n}"))
        e = e.withColumn(f"Z_{n}", F.col(f"U_{n}") / _sigma(f"U_{n}", sigma))
        out = out.join(e, "date", "left")
    return out


def shocks(df: DataFrame, cols: tuple[str, ...] = COLS, horizon: int = 5, suffix: str = NORMAL, train: int = 500, refit: int = 20, window: int = 756, lags: tuple[int, ...] = (1, 2, 3, 5, 10)) -> DataFrame:
    """W{col}_{h}d: mean of recursive forecasts less their normals, and its square; the last ``horizon`` rows are NULL."""
    out = df
    for n in (n for n in cols if n in df.columns):
        w = ridge.recursive(df.join(design(df, n, f"{n}_{suffix}", lags), "date"), f"{n}_{suffix}", horizon, train, refit, window, lags)
        out = out.join(w.select("date", F.col("shock").alias(f"W{n}_{horizon}d"), (F.col("shock") * F.col("shock")).alias(f"W{n}2_{horizon}d")), "date", "left")
    return out


def announcements(df: DataFrame) -> DataFrame:
    """(ann_date, storage_bcf, delta_storage_bcf, ann_prev, window_days): days on which the stock changed, but the first."""
    w = W.orderBy("date")
    delta = F.col("Storage") - F.lag("Storage").over(w)
    a = df.select(F.col("date").alias("ann_date"), F.col("Storage").alias("storage_bcf"), delta.alias("delta_storage_bcf")).where("delta_storage_bcf != 0")
    prev = F.lag("ann_date").over(W.orderBy("ann_date"))
    return a.withColumn("ann_prev", prev).withColumn("window_days", F.datediff("ann_date", "ann_prev")).where("ann_prev is not null")


def storage_windows(df: DataFrame, ann: DataFrame, cols: tuple[str, ...] = ("HDD", "HDD2", "CDD", "CDD2")) -> DataFrame:
    """Sum and variance of weather in (ann_prev, ann_date]; a sum without values is 0, a variance of one row NULL."""
    cols = tuple(n for n in cols if n in df.columns)
    met = joins.interval(ann.select("ann_date", "ann_prev"), df.select("date", *cols), "ann_prev", "ann_date")
    agg = met.groupBy("ann_date").agg(*(F.sum(n).alias(f"{n}_storage_window") for n in cols), *(F.var_samp(n).alias(f"{n}_var_storage_window") for n in cols))
    out = ann.join(agg, "ann_date", "left")
    return out.select(*ann.columns, *(F.coalesce(f"{n}_storage_window", F.lit(0.0)).alias(f"{n}_storage_window") for n in cols), *(f"{n}_var_storage_window" for n in cols))


def storage_surprises(ann: DataFrame, years: int = 5, days: int = 7, normal_least: int = 5, train: int = 104, refit: int = 4, window: int = 156, sigma: int = 26) -> DataFrame:
    """E_, U_, Z_DeltaStorage by walk-forward ridge at the announcements; gaps in regressors take the training window's means."""
    a = normals(ann, ("delta_storage_bcf",), years, days, normal_least, False, "ann_date").withColumnRenamed(f"delta_storage_bcf_normal_{years}y_pm{days}d", "StorageChange_normal")
    w = W.orderBy("ann_date")
    lags = [F.lag("delta_storage_bcf", k).over(w) for k in (1, 2, 3, 4)]
    months = [(F.month("ann_date") == m).cast("double") for m in range(1, 13)]
    names = [n for n in ann.columns if n.endswith("_storage_window")]
    x = F.array(*(F.when(finite(v), v) for v in [F.col("StorageChange_normal"), *map(F.col, names), *lags, *months]))
    d = a.select(F.col("ann_date").alias("date"), (F.row_number().over(w) - 1).alias("t"), x.alias("x"), F.col("delta_storage_bcf").alias("y"))
    e = ridge.walk_forward(d, train, refit, window, impute=True).select("date", F.col("y_hat").alias("E_DeltaStorage"), F.col("u").alias("U_DeltaStorage"))
    e = e.withColumn("Z_DeltaStorage", F.col("U_DeltaStorage") / _sigma("U_DeltaStorage", sigma)).withColumnRenamed("date", "ann_date")
    return a.join(e, "ann_date", "left")


def to_daily(df: DataFrame, ann: DataFrame) -> DataFrame:
    """Announcement flag, business days since, last values, timing dummies and their products with the surprises."""
    sources = {s: d for s, d in (("delta_storage_bcf", "DeltaStorage_last"), ("E_DeltaStorage", "E_DeltaStorage_last"), ("U_DeltaStorage", "U_DeltaStorage_last"), ("Z_DeltaStorage", "Z_DeltaStorage_last")) if s in ann.columns}
    a = ann.select(F.col("ann_date").alias("date"), *(F.col(s).alias(d) for s, d in sources.items()), F.lit(1).alias("is_storage_announcement_day"), dates.business_ordinal("ann_date").alias("__ann"))
    j = df.join(a, "date", "left").withColumn("is_storage_announcement_day", F.coalesce("is_storage_announcement_day", F.lit(0)))
    j = joins.forward_fill(j, [*sources.values(), "__ann"])
    since = (dates.business_ordinal("date") - F.col("__ann")).cast("double")
    j = j.withColumn("days_since_storage_announcement", since).drop("__ann")
    d = F.col("days_since_storage_announcement")
    dummies = {**{f"D_storage_{i}": F.coalesce(d == i, F.lit(False)).cast("double") for i in range(4)}, "D_storage_4plus": F.coalesce(d >= 4, F.lit(False)).cast("double")}
    j = j.select("*", *(v.alias(k) for k, v in dummies.items()))
    last = lambda n: F.col(n) if n in j.columns else F.lit(None).cast("double")
    return j.select("*", *((last(f"{p}_DeltaStorage_last") * F.col(f"D_storage_{i}")).alias(f"{p}Storage_x_D{i}") for p in ("U", "E") for i in range(4)))


def fundamental(weather: DataFrame, stock: DataFrame, train: int = 500, storage_train: int = 104) -> tuple[DataFrame, DataFrame]:
    """All steps: (daily, announcements)."""
    daily = weather.join(stock, "date", "full")
    daily = normals(rolling_features(base(daily)), ("HDD", "CDD", "HDD2", "CDD2"))
    daily = shocks(surprises(daily, ("HDD", "CDD", "HDD2", "CDD2"), train=train), train=train)
    ann = storage_surprises(storage_windows(daily, announcements(stock)), train=storage_train)
    return to_daily(daily, ann), ann


# The daily columns that the panel takes.
FAMILY_B = (
    "HDD", "CDD", "HDD2", "CDD2", "HDD_inc", "HDD_dec", "CDD_inc", "CDD_dec",
    "HDD_sum_5d", "CDD_sum_5d", "HDD_mean_5d", "CDD_mean_5d", "HDD_var_5d", "CDD_var_5d", "HDD_sum_10d", "CDD_sum_10d", "HDD_var_10d", "CDD_var_10d",
    "HDD_normal_4y_pm3d", "CDD_normal_4y_pm3d", "HDD2_normal_4y_pm3d", "CDD2_normal_4y_pm3d",
    "HDD_anom_normal", "CDD_anom_normal", "HDD2_anom_normal", "CDD2_anom_normal",
    "E_HDD", "U_HDD", "Z_HDD", "E_CDD", "U_CDD", "Z_CDD", "E_HDD2", "U_HDD2", "Z_HDD2", "E_CDD2", "U_CDD2", "Z_CDD2",
    "WHDD_5d", "WCDD_5d", "WHDD2_5d", "WCDD2_5d",
    "Storage", "DeltaStorage_last", "is_storage_announcement_day", "days_since_storage_announcement",
    "E_DeltaStorage_last", "U_DeltaStorage_last", "Z_DeltaStorage_last",
    "UStorage_x_D0", "UStorage_x_D1", "UStorage_x_D2", "UStorage_x_D3", "EStorage_x_D0", "EStorage_x_D1", "EStorage_x_D2", "EStorage_x_D3",
)
