"""Conditioning frames: signals, event flags, terciles, and grids of means by regime."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tenorlake.functions.nulls import c, div
from tenorlake.operators import econ


def representative(df: DataFrame, names: dict[str, str], kind: str = "option_type", level: str = "mnes") -> DataFrame:
    """Rows with their kind's representative level, by a semi-join with the short list."""
    short = df.sparkSession.createDataFrame(list(names.items()), f"{kind} string, {level} string")
    return df.join(F.broadcast(short), [kind, level], "left_semi")


def lookup(x: Column | str, names: dict[str, str]) -> Column:
    """Label of a value, the value itself where there is none."""
    m = F.create_map(*(F.lit(v) for kv in names.items() for v in kv)) if names else F.create_map()
    return F.coalesce(F.try_element_at(m, c(x)), c(x)) if names else c(x)


def events(df: DataFrame, flags: dict[str, str]) -> Column:
    """Label by event columns in order, later ones win; ``none`` otherwise. Absent columns count as 0."""
    out = F.lit("none")
    for column, label in flags.items():
        if column in df.columns:
            out = F.when(F.coalesce(F.col(column), F.lit(0)) == 1, label).otherwise(out)
    return out


def lagged_spread(df: DataFrame, a: str, b: str, scale: float, order: str, out: str) -> DataFrame:
    """(scale a - b) of the row before; the first row goes."""
    x = df.withColumn(out, F.lag(F.col(a) * scale - F.col(b)).over(W.orderBy(order)))
    return x.where(F.col(out).isNotNull())


def standardised(df: DataFrame, columns: list[str], until: Column | None = None) -> DataFrame:
    """z-scores; moments of all rows, or of those where ``until`` holds."""
    cond = F.lit(True) if until is None else until
    m = df.where(cond).agg(*(F.struct(F.avg(n).alias("m"), F.stddev_samp(n).alias("s")).alias(f"__{n}") for n in columns))
    return df.crossJoin(F.broadcast(m)).select("*", *(div(F.col(n) - F.col(f"__{n}.m"), F.col(f"__{n}.s")).alias(f"{n}_z") for n in columns)).drop(*(f"__{n}" for n in columns))


def terciles(df: DataFrame, x: str, out: str, until: Column | None = None, labels: tuple[str, str, str] = ("low", "mid", "high")) -> DataFrame:
    """Right-closed terciles; edges of all rows, or of those where ``until`` holds."""
    edges = df.where(F.lit(True) if until is None else until).agg(F.percentile(x, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("__e"))
    v, e = F.col(x), F.col("__e")
    return df.crossJoin(F.broadcast(edges)).withColumn(out, F.when(v <= e[0], labels[0]).when(v <= e[1], labels[1]).when(v.isNotNull(), labels[2])).drop("__e")


def grid(df: DataFrame, signals: list[str], y: str, keys: tuple[str, ...]) -> DataFrame:
    """(signal, keys, regime, n, mean, se, t): means by tercile of each signal."""
    out = None
    for s in signals:
        one = terciles(df, s, "regime").where("regime is not null").groupBy(F.lit(s).alias("signal"), *keys, "regime").agg(F.count(y).alias("n"), F.avg(y).alias("mean"), econ.sem(y).alias("se"), econ.t_stat(y).alias("t"))
        out = one if out is None else out.unionByName(one)
    return out


def event_means(df: DataFrame, flag: Column, y: str, keys: tuple[str, ...], least: int = 3) -> DataFrame:
    """(keys, mean_event, mean_other, n_event, n_other, t): both sides need ``least`` values."""
    a, b = F.when(flag, F.col(y)), F.when(~flag, F.col(y))
    g = df.groupBy(*keys).agg(F.avg(a).alias("mean_event"), F.avg(b).alias("mean_other"), F.count(a).alias("n_event"), F.count(b).alias("n_other"), econ.welch(y, flag).alias("t"))
    return g.where((F.col("n_event") >= least) & (F.col("n_other") >= least))
