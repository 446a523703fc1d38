"""Audits of feature panels: missing values, kinds of columns, balance, correlation, registries. One pass over the table each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tenorlake.functions.nulls import avg_rank, corr, div, finite, flag, kurt, skew
from tenorlake.operators.joins import pairs


def long(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, feature, value)."""
    keys = keys or []
    return df.select(*keys, *(F.col(n).cast("double").alias(n) for n in columns)).unpivot(keys or [F.lit(0).alias("__k")], columns, "feature", "value").select(*keys, "feature", "value")


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, mean, std, min, max, nan_pct, positive_pct, n_values, is_binary, skew, kurtosis)."""
    v = F.when(finite("value"), F.col("value"))
    return long(df, columns).groupBy("feature").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        (100 * F.avg(v.isNull().cast("double"))).alias("nan_pct"), (100 * F.avg(F.when(v.isNotNull(), flag(v > 0)))).alias("positive_pct"),
        F.countDistinct(v).alias("n_values"), F.coalesce((F.countDistinct(v) <= 2) & (F.min(v) >= 0) & (F.max(v) <= 1), F.lit(False)).alias("is_binary"),
        skew(v).alias("skew"), kurt(v).alias("kurtosis"),
    )


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, count, mean, std, min, q25, q50, q75, max), exact."""
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    d = long(df, columns).groupBy("feature").agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), q.alias("q"), F.max("value").alias("max"))
    return d.select("feature", "count", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")


def missing_buckets(profiled: DataFrame) -> DataFrame:
    return profiled.agg(F.count_if(F.col("nan_pct") == 0).alias("complete"), F.count_if((F.col("nan_pct") > 0) & (F.col("nan_pct") < 100)).alias("partial"), F.count_if(F.col("nan_pct") == 100).alias("empty"))


def balance(df: DataFrame, columns: list[str], slack: float = 10.0) -> DataFrame:
    """(feature, n_pos, n_neg, ratio, imbalanced) of positive and other values."""
    b = long(df, columns).where("value is not null").groupBy("feature").agg(F.count_if(F.col("value") > 0).alias("n_pos"), F.count_if(F.col("value") <= 0).alias("n_neg"))
    ratio = F.greatest("n_pos", "n_neg") / F.greatest(F.least("n_pos", "n_neg"), F.lit(1))
    return b.select("feature", "n_pos", "n_neg", ratio.alias("ratio"), (F.abs(100 * F.col("n_pos") / (F.col("n_pos") + F.col("n_neg")) - 50) > slack).alias("imbalanced"))


def eligible(profiled: DataFrame, most_missing: float = 50.0, least_std: float = 1e-10) -> DataFrame:
    return profiled.where((F.col("nan_pct") < most_missing) & (F.col("std") > least_std)).select("feature")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name_a, name_b, corr) of all pairs in one aggregate: the sums grow with the columns, not with the rows."""
    ns = sorted(columns)
    both = [(a, b) for i, a in enumerate(ns) for b in ns[i + 1 :]]
    one = df.agg(*(corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(both)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("name_a"), F.lit(b).alias("name_b"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(both)))).alias("p")).select("p.*")


def tenor_correlations(panel: DataFrame, value: str, rank: bool = False) -> DataFrame:
    """(name_a, name_b, corr) between tenors over common dates; of ranks over time if ``rank``."""
    x = panel.select("date", "tenor", (avg_rank(value, ("tenor",)) if rank else F.col(value)).alias("v"))
    return pairs(x, "date", "tenor", "v").groupBy("name_a", "name_b").agg(corr("a", "b").alias("corr"))


def high_pairs(corrs: DataFrame, bound: float = 0.8) -> DataFrame:
    """(feature, n): how many others each feature is that close to."""
    high = corrs.where(F.abs("corr") >= bound)
    return high.select(F.col("name_a").alias("feature")).unionByName(high.select(F.col("name_b").alias("feature"))).groupBy("feature").agg(F.count("*").alias("n"))


def histogram(df: DataFrame, x: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, left, n, density); values outside are left out, ``high`` is in the last bin."""
    width = (high - low) / bins
    v = df.where(F.col(x).between(low, high)).select(F.least(F.floor((F.col(x) - low) / width), F.lit(bins - 1)).cast("int").alias("bin"))
    h = v.groupBy("bin").agg(F.count("*").alias("n"))
    return h.select("bin", (low + F.col("bin") * width).alias("left"), "n", (F.col("n") / (F.sum("n").over(W.partitionBy()) * width)).alias("density"))


def registry(spark, columns: list[str], families: dict[str, list[str]]) -> DataFrame:
    """(family, n_present, n_missing, missing): never fails."""
    held = set(columns)
    rows = [(k, sum(n in held for n in v), sum(n not in held for n in v), [n for n in v if n not in held]) for k, v in families.items()]
    return spark.createDataFrame(rows, "family string, n_present int, n_missing int, missing array<string>")


def categories(columns: list[str]) -> dict[str, list[str]]:
    """Names by suffix: ts (time-slot z), cs (cross-section), dummies, raw."""
    out: dict[str, list[str]] = {"ts": [], "cs": [], "dummies": [], "raw": []}
    for n in columns:
        kind = "ts" if n.endswith("_z") else "cs" if n.endswith(("_cs", "_cs_family")) else "dummies" if n.startswith(("is_", "D_", "month_")) else "raw"
        out[kind].append(n)
    return out


def select_columns(df: DataFrame, prefix: str = "", suffix: str = "", contains: str = "", exclude: tuple[str, ...] = ()) -> list[str]:
    return [n for n in df.columns if n.startswith(prefix) and n.endswith(suffix) and contains in n and n not in exclude]


def rename_by(df: DataFrame, marks: dict[str, str]) -> DataFrame:
    """A column whose name holds a mark (case-insensitively) gets its new name; the first mark wins."""
    new = {n: next((v for k, v in marks.items() if k in n.lower()), n) for n in df.columns}
    return df.select(*(F.col(n).alias(m) for n, m in new.items()))


def distinct_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """n values of a key, the same in every run: those with the smallest hashes."""
    return df.select(key).distinct().orderBy(F.xxhash64(key), key).limit(n)


def every_nth(df: DataFrame, n: int, keys: tuple[str, ...], order: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumn("__i", F.row_number().over(w) - 1).where(F.col("__i") % n == 0).drop("__i")


def share(cond):
    return F.avg(flag(cond))


def normal_pdf(x: str, mean: float, std: float):
    z = (F.col(x) - mean) / std
    return F.exp(-z * z / 2) / (std * (2 * 3.141592653589793) ** 0.5)


def kernel_density(df: DataFrame, x: str, grid: DataFrame, at: str = "at") -> DataFrame:
    """Gaussian kernel density (Scott's width) of x at the points of a short grid."""
    v = df.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("__v"))
    h = v.agg((F.stddev_samp("__v") * F.pow(F.count("*").cast("double"), F.lit(-0.2))).alias("__h"))
    z = (F.col(at) - F.col("__v")) / F.col("__h")
    return v.crossJoin(F.broadcast(h)).crossJoin(F.broadcast(grid)).groupBy(at).agg(F.avg(div(F.exp(-z * z / 2), F.col("__h") * (2 * 3.141592653589793) ** 0.5)).alias("density"))
