"""Scalar and window helpers with one rule for missing values: NULL, never NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x: Column | str) -> Column:
    """NaN becomes NULL."""
    return F.nanvl(c(x).cast("double"), F.lit(None).cast("double"))


def finite(x: Column | str) -> Column:
    v = c(x).cast("double")
    return F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False))


def div(a: Column | str, b: Column | str) -> Column:
    """a / b; NULL where b is 0."""
    d = c(b)
    return c(a) / F.when(d != 0, d)


def clip(x: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Both, lower or upper bound; NULL stays NULL."""
    v = out = c(x)
    out = out if low is None else F.greatest(out, F.lit(float(low)))
    out = out if high is None else F.least(out, F.lit(float(high)))
    return F.when(v.isNotNull(), out)


def is_close(a: Column | str, b: Column | str, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Within atol + rtol |b|; NULL equals NULL."""
    return c(a).eqNullSafe(c(b)) | F.coalesce(F.abs(c(a) - c(b)) <= atol + rtol * F.abs(c(b)), F.lit(False))


def flag(cond: Column) -> Column:
    """1.0 or 0.0; an unknown comparison is 0.0."""
    return F.coalesce(cond, F.lit(False)).cast("double")


def rows(keys: Sequence[str], order: Sequence[str], first: int | None, last: int | None) -> WindowSpec:
    """A frame of rows relative to the current one; None is unbounded."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return w.rowsBetween(Window.unboundedPreceding if first is None else first, Window.unboundedFollowing if last is None else last)


def rolling(fn, x: Column | str, w: WindowSpec, least: int) -> Column:
    """fn(x) over w where at least ``least`` values are there."""
    return F.when(F.count(c(x)).over(w) >= least, fn(c(x)).over(w))


def median(x: Column) -> Column:
    return F.percentile(x, F.lit(0.5))


def avg_rank(x: Column | str, keys: Sequence[str]) -> Column:
    """Rank with ties averaged, among the non-null values of the group."""
    v = c(x)
    below = F.rank().over(Window.partitionBy(*keys).orderBy(v.asc_nulls_last()))
    ties = F.count("*").over(Window.partitionBy(*keys, v))
    return F.when(v.isNotNull(), below + (ties - 1) / F.lit(2.0))


def corr(x: Column | str, y: Column | str) -> Column:
    """Aggregate: Pearson correlation over complete pairs; NULL where one side is constant."""
    a, b = c(x), c(y)
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return div(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def stars(p: Column | str) -> Column:
    p = c(p)
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").when(p.isNotNull(), "")


def safe_bin(x: Column | str, q: int, keys: Sequence[str], tie: Sequence[str]) -> Column:
    """Bins 1..q of equal size by rank, ties broken by ``tie``; NULL where fewer than q values are there."""
    v = c(x)
    here = v.isNotNull().cast("int")
    w = Window.partitionBy(*keys, here)
    r, n = F.row_number().over(w.orderBy(v, *tie)), F.count("*").over(w)
    up = F.when(n > 1, F.floor(((r - 1) * q + n - 2) / (n - 1))).otherwise(1)
    return F.when(v.isNotNull() & (n >= q), F.greatest(F.lit(1), up)).cast("int")


def cut(x: Column | str, edges: Column, q: int) -> Column:
    """Right-closed bin 1..q of x; ``edges``: the q - 1 inner edges."""
    v = c(x)
    return F.when(v.isNotNull(), 1 + sum(((v > edges[i]).cast("int") for i in range(q - 1)), F.lit(0)))


def inner_edges(x: Column | str, q: int) -> Column:
    """Aggregate: interpolated quantiles 1/q .. (q-1)/q."""
    return F.percentile(c(x), F.array(*(F.lit(i / q) for i in range(1, q))))


def skew(x: Column | str) -> Column:
    """Aggregate: bias-corrected skewness; NULL below 3 values or for a constant."""
    v = c(x)
    n = F.count(v).cast("double")
    return F.when((n > 2) & (F.stddev_pop(v) > 0), F.skewness(v) * F.sqrt(n * (n - 1)) / (n - 2))


def kurt(x: Column | str) -> Column:
    """Aggregate: bias-corrected excess kurtosis; NULL below 4 values or for a constant."""
    v = c(x)
    n = F.count(v).cast("double")
    return F.when((n > 3) & (F.stddev_pop(v) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(v) + 6))
