"""Purged walk-forward splits by date ordinals, and preprocessing with statistics of the training window only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tenorlake.functions.nulls import c, div


def ordinals(dates: DataFrame, date: str = "date") -> DataFrame:
    return dates.select(date).distinct().withColumn("t", F.row_number().over(W.orderBy(date)) - 1)


def daily_splits(dates: DataFrame, train: int = 252, purge: int = 1, refit: int = 21, stage2: str | None = None, start: int | None = None, date: str = "date") -> DataFrame:
    """One row per test day: train_start, train_end, purge_date, n_train_days, is_refit, stage. One window over distinct dates."""
    t0 = train + purge if start is None else max(start, train + purge)
    before = lambda n: F.lag(date, n).over(W.orderBy(date))
    x = ordinals(dates, date).select("*", before(purge + train).alias("train_start"), before(purge + 1).alias("train_end"), before(max(purge, 1)).alias("purge_date"))
    stage = F.when(F.col(date) >= F.lit(stage2).cast("date"), "S2").otherwise("S1") if stage2 else F.lit("S1")
    return x.where(F.col("t") >= t0).select(F.col(date).alias("test_date"), "train_start", "train_end", "purge_date", F.lit(train).alias("n_train_days"), ((F.col("t") - t0) % refit == 0).alias("is_refit"), stage.alias("stage"))


def block_splits(dates: DataFrame, train: int = 756, val: int = 63, step: int = 63, purge: int = 6, insample_end: str | None = None, date: str = "date") -> DataFrame:
    """One row per split: split, train_start, train_end, val_start, val_end, stage; whole validation blocks only.

    The distinct dates become one sorted array, which a calendar bounds; splits are places in it.
    """
    days = dates.agg(F.array_sort(F.collect_set(date)).alias("d"))
    room = F.size("d") - (train + purge + val)
    s = days.where(room >= 0).select("d", F.posexplode(F.sequence(F.lit(0), room, F.lit(step))).alias("split", "a"))
    at = lambda n: F.get("d", F.col("a") + n)
    s = s.select((F.col("split") + 1).alias("split"), at(0).alias("train_start"), at(train - 1).alias("train_end"), at(train + purge).alias("val_start"), at(train + purge + val - 1).alias("val_end"))
    stage = F.when(F.col("val_end") <= F.lit(insample_end).cast("date"), "S1").otherwise("S2") if insample_end else F.lit("S1")
    return s.withColumn("stage", stage)


def refit_cycles(splits: DataFrame, rows_per_day: int = 1) -> DataFrame:
    """One row per refit: next refit, test days and rows of train and prediction blocks; the last runs to the last date."""
    cycle = splits.withColumn("__c", F.sum(F.col("is_refit").cast("int")).over(W.orderBy("test_date").rowsBetween(W.unboundedPreceding, 0)))
    g = cycle.groupBy("__c").agg(F.min("test_date").alias("refit_date"), F.max("test_date").alias("last_date"), F.count("*").alias("test_days"), F.first("n_train_days").alias("n_train_days"), F.min("stage").alias("stage"))
    nxt = F.lead("refit_date").over(W.orderBy("refit_date"))
    return g.select("refit_date", nxt.alias("next_refit"), "last_date", "test_days", (F.col("n_train_days") * rows_per_day).alias("train_rows"), (F.col("test_days") * rows_per_day).alias("prediction_rows"), "stage")


def winsor_fit(train: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """One row: bounds of each column, mean and deviation of the clipped values."""
    bounds = train.agg(*(F.percentile(c(n), F.array(F.lit(low), F.lit(high))).alias(n) for n in columns))
    b = bounds.select(*(F.col(n).alias(f"{n}__b") for n in columns))
    clipped = train.crossJoin(F.broadcast(b)).select(*(F.when(F.col(n).isNotNull(), F.least(F.greatest(F.col(n), F.col(f"{n}__b")[0]), F.col(f"{n}__b")[1])).alias(n) for n in columns))
    stats = clipped.agg(*(F.struct(F.avg(n).alias("mean"), F.stddev_samp(n).alias("std")).alias(f"{n}__s") for n in columns))
    return b.crossJoin(F.broadcast(stats))


def winsor_apply(df: DataFrame, fit: DataFrame, scale: tuple[str, ...] = (), clip: tuple[str, ...] = (), zero: tuple[str, ...] = ()) -> DataFrame:
    """scale: clipped and standardised; clip: clipped only; zero: NULL becomes 0."""
    x = df.crossJoin(F.broadcast(fit))
    bound = lambda n: F.when(F.col(n).isNotNull(), F.least(F.greatest(F.col(n), F.col(f"{n}__b")[0]), F.col(f"{n}__b")[1]))
    new = {**{n: bound(n) for n in clip}, **{n: div(bound(n) - F.col(f"{n}__s.mean"), F.col(f"{n}__s.std")) for n in scale}, **{n: F.coalesce(n, F.lit(0.0)) for n in zero}}
    return x.select(*(new[n].alias(n) if n in new else F.col(n) for n in df.columns))


def windows(dates: DataFrame, splits: DataFrame, date: str = "date") -> DataFrame:
    """(date, split, part): the days of each split's windows, part ``train`` or ``val``. A calendar has few rows, whatever the panel has."""
    days = dates.select(date).distinct()
    inside = lambda part: F.col(date).between(F.col(f"{part}_start"), F.col(f"{part}_end"))
    both = days.join(splits.select("split", "train_start", "train_end", "val_start", "val_end"), inside("train") | inside("val"))
    return both.select(date, "split", F.when(inside("train"), "train").otherwise("val").alias("part"))


def preprocess(df: DataFrame, splits: DataFrame, columns: list[str], date: str = "date", low: float = 0.01, high: float = 0.99, accuracy: int | None = None) -> DataFrame:
    """Validation rows of each split, standardised by its training window: bounds and moments are one row per split.

    Rows meet the days of the windows in an equi-join by date, and come to a split once for each window that holds
    them. Bounds are exact percentiles, for which a task holds a split's different values; with ``accuracy`` they are
    approximate, of bounded size (see ``percentile_approx``).
    """
    days = windows(df, splits, date)
    train = df.join(days.where("part = 'train'").drop("part"), date)
    quantiles = lambda n: F.percentile(c(n), F.array(F.lit(low), F.lit(high))) if accuracy is None else F.percentile_approx(n, [low, high], accuracy)
    b = train.groupBy("split").agg(*(quantiles(n).alias(f"{n}__b") for n in columns))
    bound = lambda n: F.when(F.col(n).isNotNull(), F.least(F.greatest(F.col(n), F.col(f"{n}__b")[0]), F.col(f"{n}__b")[1]))
    m = train.join(b, "split").groupBy("split").agg(*(F.struct(F.avg(bound(n)).alias("mean"), F.stddev_samp(bound(n)).alias("std")).alias(f"{n}__s") for n in columns))
    val = df.join(days.where("part = 'val'").drop("part"), date).join(b, "split").join(m, "split")
    return val.select("split", *(div(bound(n) - F.col(f"{n}__s.mean"), F.col(f"{n}__s.std")).alias(n) if n in columns else F.col(n) for n in df.columns))
