"""Factor-neutral long/short weights per date."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenorlake.operators.panel import ewm


@dataclass(frozen=True)
class Portfolio:
    top_k: int = 4
    bottom_k: int = 4
    gross: float = 1.0
    max_abs: float = 0.25
    exclude: tuple[int, ...] = (1, 12)
    neutralize: bool = True
    n_factors: int = 3
    ridge: float = 1e-6
    smoothing: float = 0.0  # alpha of the exponential mean; larger smooths less, 0 is off

    def project(self, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        """w less its part along the loadings and the constant; w itself if that can't be solved."""
        a = np.column_stack([b, np.full(len(w), len(w) ** -0.5)])
        try:
            return w - a @ np.linalg.solve(a.T @ a + self.ridge * np.eye(a.shape[1]), a.T @ w)
        except np.linalg.LinAlgError:
            return w

    def _scaled(self, w: np.ndarray | None) -> np.ndarray | None:
        if w is None or np.abs(w).sum() < 1e-10:
            return None
        return w * (self.gross / np.abs(w).sum())

    def weights(self, signal: np.ndarray, b: np.ndarray | None) -> np.ndarray | None:
        """Equal long and short legs, neutral, scaled, capped, neutral and scaled again; None if a weight ends above 1.25 caps.

        Of equal signals the first in order goes into the leg; a name in both legs is short.
        """
        n = len(signal)
        if n < self.top_k + self.bottom_k:
            return None
        neutral = (lambda x: self.project(x, b)) if self.neutralize and b is not None else (lambda x: x - x.mean())
        w = np.zeros(n)
        w[np.argsort(-signal, kind="stable")[: self.top_k]] = 1 / self.top_k
        w[np.argsort(signal, kind="stable")[: self.bottom_k]] = -1 / self.bottom_k
        w = self._scaled(w - w.mean())
        w = None if w is None else self._scaled(neutral(w))
        w = None if w is None else self._scaled(neutral(np.clip(w, -self.max_abs, self.max_abs)))
        return None if w is None or np.abs(w).max() > 1.25 * self.max_abs else w

    def panel(self, predictions: DataFrame, loadings: DataFrame | None = None) -> DataFrame:
        """(date, tenor, weight, factor_neutral) from (date, tenor, y_pred) and (date, tenor, factor, loading).

        Too few names: no rows. No loadings on a date: neutral in dollars only, as ``factor_neutral`` says. Tenors
        without all loadings are left out. A rejected date has rows of weight 0.
        """
        if self.neutralize and loadings is None:
            raise ValueError("loadings are needed to neutralise factors")
        p = predictions.select("date", "tenor", F.col("y_pred").cast("double").alias("y_pred"))
        if self.smoothing > 0:
            p = ewm(p, "y_pred", self.smoothing, ("tenor",), out="__s").select("date", "tenor", F.col("__s").alias("y_pred"))
        p = p.where(F.col("y_pred").isNotNull() & ~F.col("tenor").isin(*self.exclude))
        k = self.n_factors
        if self.neutralize:
            wide = loadings.where(F.col("factor") <= k).groupBy("date", "tenor").agg(F.array_sort(F.collect_list(F.struct("factor", "loading"))).alias("l"))
            wide = wide.withColumn("l", F.when(F.size("l") == k, F.transform("l", lambda x: x["loading"])))
            have = wide.select("date").distinct().withColumn("has", F.lit(True))
            p = p.join(wide, ["date", "tenor"], "left").join(have, "date", "left").where(F.col("has").isNull() | F.col("l").isNotNull())
        else:
            p = p.withColumn("l", F.lit(None).cast("array<double>"))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.assign(name="M" + pdf.tenor.astype(str)).sort_values("name")
            b = np.array(pdf.l.tolist(), float).reshape(len(pdf), -1) if self.neutralize and pdf.l.notna().all() else None
            if len(pdf) < self.top_k + self.bottom_k:
                return pd.DataFrame({"date": [], "tenor": [], "weight": [], "factor_neutral": []}, dtype=object)
            w = self.weights(pdf.y_pred.to_numpy(), b)
            return pd.DataFrame({"date": pdf.date, "tenor": pdf.tenor, "weight": 0.0 if w is None else w, "factor_neutral": b is not None})

        return p.select("date", "tenor", "y_pred", "l").groupBy("date").applyInPandas(run, "date date, tenor int, weight double, factor_neutral boolean")
