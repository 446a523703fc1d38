"""Walk-forward ridge regression and recursive forecasts of one ordered series.

Which rows a model is fitted on, and when, depends on which fits succeeded
before, so the schedule is an ordered scan. It runs as one grouped function per
series (``keys``); many series are spread over tasks. A series is some
thousand rows: its regressors are what one task holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def solve(x: np.ndarray, y: np.ndarray, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """Coefficients and intercept; the intercept isn't penalised."""
    mean, level = x.mean(0), y.mean()
    xc = x - mean
    b = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ (y - level))
    return b, float(level - mean @ b)


def models(x: np.ndarray, y: np.ndarray, train: int, refit: int, window: int, impute: bool) -> Iterator[tuple[int, np.ndarray, float, np.ndarray]]:
    """(row, coefficients, intercept, fill) from row ``train`` on, as soon as a first fit succeeds; a failed fit is tried again on the next row."""
    fitted, last = None, None
    for t in range(train, len(y)):
        if last is None or t - last >= refit:
            a, b = x[max(0, t - window) : t], y[max(0, t - window) : t]
            fill = np.zeros(x.shape[1])
            if impute and len(a):
                known = np.isfinite(a)
                n = known.sum(0)
                fill = np.where(n > 0, np.where(known, a, 0).sum(0) / np.maximum(n, 1), 0.0)
                a = np.where(known, a, fill)
            ok = np.isfinite(a).all(1) & np.isfinite(b)
            if ok.sum() >= train:
                fitted, last = (*solve(a[ok], b[ok]), fill), t
        if fitted:
            yield t, *fitted


SERIES = 200_000  # rows of a series at most: a row a day for five centuries


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    if len(pdf) > SERIES:
        raise ValueError(f"a series of {len(pdf)} rows; walk-forward fits take {SERIES} at most, give keys for several series")
    return np.array([[np.nan if v is None else v for v in row] for row in pdf.x], float).reshape(len(pdf), -1), pdf.y.to_numpy(float)


def walk_forward(df: DataFrame, train: int, refit: int, window: int, impute: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, date, y_hat, u): out-of-sample predictions and errors. ``df``: keys, date, t, x, y."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t").reset_index(drop=True)
        x, y = _arrays(pdf)
        hat = np.full(len(y), np.nan)
        for t, b, level, fill in models(x, y, train, refit, window, impute):
            row = np.where(np.isfinite(x[t]), x[t], fill) if impute else x[t]
            if np.isfinite(row).all() and np.isfinite(y[t]):
                hat[t] = row @ b + level
        return pdf[[*keys, "date"]].assign(y_hat=hat, u=y - hat)

    kind = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in (*keys, "date"))
    out = df.select(*keys, "date", "t", "x", "y").withColumn("__g", F.lit(0))
    got = out.groupBy(*keys or ["__g"]).applyInPandas(lambda p: run(p), f"{kind}, y_hat double, u double")
    return got.select(*keys, "date", F.nanvl("y_hat", F.lit(None).cast("double")).alias("y_hat"), F.nanvl("u", F.lit(None).cast("double")).alias("u"))


def recursive(df: DataFrame, normal: str, horizon: int, train: int, refit: int, window: int, lags: tuple[int, ...]) -> DataFrame:
    """(date, shock): mean over ``horizon`` recursive forecasts of forecast less normal. Regressors as in ``weather.design``: lags last, the normal before them."""
    lags = tuple(sorted(lags))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t").reset_index(drop=True)
        x, y = _arrays(pdf)
        norm = pdf[normal].to_numpy(float)
        out = np.full(len(y), np.nan)
        at = x.shape[1] - len(lags)
        for t, b, level, _ in models(x[: len(y) - horizon], y[: len(y) - horizon], train, refit, window, False):
            known = {i: y[i] for i in range(max(0, t - max(lags)), t + 1)}
            total = 0.0
            for m in range(t + 1, t + horizon + 1):
                row = x[m].copy()
                row[at:] = [known.get(m - k, np.nan) for k in lags]
                known[m] = row @ b + level
                total += known[m] - norm[m]
            out[t] = total / horizon
        return pd.DataFrame({"date": pdf.date, "shock": out})

    got = df.select("date", "t", "x", "y", normal).withColumn("__g", F.lit(0)).groupBy("__g").applyInPandas(run, "date date, shock double")
    return got.select("date", F.nanvl("shock", F.lit(None).cast("double")).alias("shock"))
