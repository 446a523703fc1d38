"""Calendar arithmetic; days are Monday to Friday business days, without holidays."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenorlake.functions.nulls import c


def business_days(spark: SparkSession, first: str, last: str, name: str = "date") -> DataFrame:
    days = F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr("interval 1 day"))).alias(name)
    return spark.range(1).select(days).where(F.weekday(name) < 5)


def month_starts(df: DataFrame, date: str = "date", out: str = "month") -> DataFrame:
    """First days of the months after the first date up to that of the last date's month and the next."""
    span = df.agg(F.min(date).alias("a"), F.max(date).alias("b"))
    return span.select(F.explode(F.sequence(F.trunc("a", "MM"), F.add_months(F.trunc("b", "MM"), 1), F.expr("interval 1 month"))).alias(out)).where("a is not null")


def roll_date(month: Column | str) -> Column:
    """Two business days before the first of a month."""
    m = c(month)
    return F.date_sub(m, F.when(F.weekday(m) <= 1, 4).when(F.weekday(m) == 6, 3).otherwise(2))


def business_ordinal(date: Column | str) -> Column:
    """Number of the business day; NULL on weekends."""
    d = c(date)
    days = F.datediff(d, F.lit("1970-01-05").cast("date"))
    return F.when(F.weekday(d) < 5, 5 * F.floor(days / 7) + F.weekday(d))


def fourier(date: Column | str, order: int = 2, period: float = 365.25) -> dict[str, Column]:
    angle = [2 * math.pi * k * F.dayofyear(c(date)) / period for k in range(1, order + 1)]
    return {f"{name}{k}": fn(a) for k, a in enumerate(angle, 1) for name, fn in (("sin", F.sin), ("cos", F.cos))}


def cyclic_distance(a: Column | str, b: Column | str, year: int = 365) -> Column:
    d = F.abs(c(a) - c(b))
    return F.least(d, F.lit(year) - d)


def season(date: Column | str) -> Column:
    return F.when(F.month(c(date)).between(4, 10), "Apr-Oct").otherwise("Nov-Mar")


def day_bucket(days: Column | str, last: int = 5) -> Column:
    d = c(days)
    return F.when(d <= last, F.concat(F.lit("D+"), d.cast("int").cast("string"))).when(d.isNotNull(), f"D+{last + 1}+")
