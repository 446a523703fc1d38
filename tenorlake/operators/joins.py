"""Joins by interval, by time and by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W


def interval(events: DataFrame, facts: DataFrame, after: str, upto: str, date: str = "date", width: int = 32) -> DataFrame:
    """Facts with after < date <= upto, as an equi-join on buckets of ``width`` days: no nested loop, however many rows.

    An event lies in each bucket that its interval touches, a fact in one.
    """
    bucket = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / width)
    e = events.withColumn("__bucket", F.explode(F.sequence(bucket(F.date_add(after, 1)), bucket(F.col(upto)))))
    f = facts.withColumn("__bucket", bucket(F.col(date)))
    return e.join(f, "__bucket").where((F.col(date) > F.col(after)) & (F.col(date) <= F.col(upto))).drop("__bucket")


def asof(left: DataFrame, right: DataFrame, on: str, values: list[str], keys: tuple[str, ...] = (), forward: bool = False) -> DataFrame:
    """For each left row the last right row not after it (or the first not before it): a union and one window, no join.

    Several right rows of one time: the largest values. NULL values of the right row are kept as such.
    """
    pack = F.struct(*values)
    r = right.groupBy(*keys, on).agg(F.max(pack).alias("__r")).withColumn("__side", F.lit(1 if forward else 0)).withColumn("__l", F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType))
    lhs = left.select(*keys, on, F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), F.lit(0 if forward else 1).alias("__side"), F.struct("*").alias("__l"))
    both = lhs.unionByName(r)
    w = W.partitionBy(*keys).orderBy(F.col(on), "__side")
    found = F.first("__r", True).over(w.rowsBetween(0, W.unboundedFollowing)) if forward else F.last("__r", True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("__r", found).where("__l is not null").select("__l.*", *(F.col(f"__r.{v}").alias(v) for v in values))


def forward_fill(df: DataFrame, columns: list[str], keys: tuple[str, ...] = (), order: str = "date") -> DataFrame:
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.select(*(n for n in df.columns if n not in columns), *(F.last(n, True).over(w).alias(n) for n in columns))


def nearest(events: DataFrame, dates: DataFrame, event: str = "event_date", date: str = "date") -> DataFrame:
    """Events with the nearest date (the earlier of two): candidates are the last date before and the first after, by two as-of joins."""
    back = asof(events, dates.select(F.col(date).alias(event), F.col(date).alias("__back")).distinct(), event, ["__back"])
    both = asof(back, dates.select(F.col(date).alias(event), F.col(date).alias("__next")).distinct(), event, ["__next"], forward=True)
    to_back, to_next = F.datediff(event, "__back"), F.datediff("__next", event)
    return both.withColumn("nearest", F.when(F.col("__next").isNull() | (to_back <= to_next), F.col("__back")).otherwise(F.col("__next"))).drop("__back", "__next")


def exact(events: DataFrame, facts: DataFrame, event: str = "event_date", date: str = "date") -> tuple[DataFrame, DataFrame]:
    """Facts of the events' dates, and the events without any."""
    on = F.col(event) == F.col(date)
    return events.join(facts, on), events.join(facts, on, "left_anti")


def around(events: DataFrame, series: DataFrame, half: int, event: str = "event_date", date: str = "date") -> DataFrame:
    """Rows at most ``half`` places from each event's place (the first date not before it), which is kept ``half`` rows off both ends."""
    placed = series.withColumn("__rn", F.row_number().over(W.orderBy(date)) - 1)
    n = series.agg(F.count("*").alias("__n"))
    at = asof(events, placed.select(F.col(date).alias(event), F.col("__rn").alias("__at")), event, ["__at"], forward=True).crossJoin(F.broadcast(n))
    place = F.greatest(F.lit(half), F.least(F.coalesce("__at", "__n"), F.col("__n") - half - 1))
    wanted = at.withColumn("__place", place).withColumn("__rn", F.explode(F.sequence(F.col("__place") - half, F.col("__place") + half)))
    return wanted.join(placed, "__rn").withColumn("offset", (F.col("__rn") - F.col("__place")).cast("int")).drop("__rn", "__at", "__n", "__place")


def pairs(long: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """(name_a, name_b, a, b): values of two names with the same key, first name smaller."""
    a = long.select(F.col(key), F.col(name).alias("name_a"), F.col(value).alias("a"))
    b = long.select(F.col(key), F.col(name).alias("name_b"), F.col(value).alias("b"))
    return a.join(b, key).where("name_a < name_b")


def grid(spark, names: dict[str, list], keep: str | None = None) -> DataFrame:
    """Product of parameter lists, with a condition. An empty list is an error, as nothing tells its type.

    A row's number tells the place of its value in each list, the last list's places changing fastest: no join, and as
    many tasks as a range has. Partitions of crossed frames multiply, to thousands of tasks for a few rows.
    """
    columns, step = [], 1
    for name, values in reversed(names.items()):
        kind = spark.createDataFrame([(v,) for v in values], [name]).schema[0].dataType
        place = F.expr(f"CAST(id div {step}L % {len(values)}L AS INT)")
        columns.insert(0, F.get(F.array(*map(F.lit, values)).cast(T.ArrayType(kind)), place).alias(name))
        step *= len(values)
    out = spark.range(step).select(*columns)
    return out.where(keep) if keep else out
