"""Returns, roll adjustment, data quality, outliers and their treatment, on long panels (date, tenor, value)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tenorlake.functions import dates
from tenorlake.functions.nulls import div, flag, median, rolling, rows

BY = ("tenor",)


def log_returns(panel: DataFrame, price: str = "price", out: str = "r") -> DataFrame:
    """(date, tenor, out): logarithm of the price over the one before; first rows and prices not above 0 give no row."""
    before = F.lag(price).over(W.partitionBy(*BY).orderBy("date"))
    r = F.when((F.col(price) > 0) & (before > 0), F.ln(F.col(price) / before))
    return panel.select("date", "tenor", r.alias(out)).where(F.col(out).isNotNull())


def roll_days(panel: DataFrame) -> DataFrame:
    """(date): roll dates of the panel's months."""
    return dates.month_starts(panel).select(dates.roll_date("month").alias("date"))


def roll_adjust(panel: DataFrame, rolls: DataFrame, price: str = "price") -> DataFrame:
    """(date, tenor, r, r_raw, is_roll): on roll dates the price over the next tenor's price before.

    Left as it is where that price is missing or not above 0. The last tenor, which only serves its neighbour, goes.
    """
    order = W.partitionBy("tenor").orderBy("date")
    lagged = panel.select("date", "tenor", F.col(price).alias("p"), F.lag(price).over(order).alias("p1"))
    lagged = lagged.withColumn("next1", F.lead("p1").over(W.partitionBy("date").orderBy("tenor"))).withColumn("next_tenor", F.lead("tenor").over(W.partitionBy("date").orderBy("tenor")))
    top = panel.agg(F.max("tenor").alias("__top"))
    marked = lagged.join(rolls.select("date").distinct().withColumn("__roll", F.lit(True)), "date", "left")
    is_roll = F.coalesce("__roll", F.lit(False))
    raw = F.when((F.col("p") > 0) & (F.col("p1") > 0), F.ln(F.col("p") / F.col("p1")))
    ok = is_roll & (F.col("next_tenor") == F.col("tenor") + 1) & (F.col("next1") > 0) & (F.col("p") > 0)
    adjusted = F.when(ok, F.ln(F.col("p") / F.col("next1"))).otherwise(raw)
    out = marked.crossJoin(F.broadcast(top)).where("tenor < __top and p1 is not null")
    return out.select("date", "tenor", adjusted.alias("r"), raw.alias("r_raw"), is_roll.alias("is_roll"))


def roll_comparison(adjusted: DataFrame) -> DataFrame:
    """By tenor: ratio of mean and of median absolute returns on roll days to other days, raw and adjusted."""
    out = [F.col("tenor")]
    agg = []
    for name in ("r_raw", "r"):
        for label, cond in (("roll", F.col("is_roll")), ("other", ~F.col("is_roll"))):
            x = F.when(cond, F.abs(name))
            agg += [F.avg(x).alias(f"{name}_{label}_mean"), median(x).alias(f"{name}_{label}_median")]
        out += [div(f"{name}_roll_mean", f"{name}_other_mean").alias(f"{name}_mean_ratio"), div(f"{name}_roll_median", f"{name}_other_median").alias(f"{name}_median_ratio")]
    return adjusted.groupBy("tenor").agg(*agg).select(*out)


def dq_report(panel: DataFrame, price: str = "price", extreme: float = 0.15) -> DataFrame:
    """By tenor: observations, dates, share missing, not positive, duplicate and stale prices, extreme returns."""
    order = W.partitionBy("tenor").orderBy("date")
    last = F.lag(price).over(order)
    full = panel.select("date").distinct().agg(F.count("*").alias("__dates"))
    x = panel.select("date", "tenor", F.col(price).alias("p"), last.alias("p1"), (F.lag("date").over(order) == F.col("date")).alias("dup"))
    x = x.withColumn("ret", F.when((F.col("p") > 0) & (F.col("p1") > 0), F.col("p") / F.col("p1") - 1))
    out = x.groupBy("tenor").agg(
        F.count("p").alias("n_obs"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.sum(flag(F.col("p") <= 0)).cast("long").alias("n_zero_neg"),
        F.sum(flag(F.col("dup"))).cast("long").alias("n_dup_dates"),
        F.sum(flag(F.col("p") == F.col("p1"))).cast("long").alias("n_stale"),
        F.max("ret").alias("max_pos_ret"),
        F.min("ret").alias("max_neg_ret"),
        F.sum(flag(F.abs("ret") > extreme)).cast("long").alias("n_extreme_ret"),
    )
    return out.crossJoin(F.broadcast(full)).withColumn("pct_missing", 100 * (1 - F.col("n_obs") / F.col("__dates"))).drop("__dates")


def outlier_scores(returns: DataFrame, r: str = "r", lookback: int = 252, min_periods: int = 126) -> DataFrame:
    """scale: lagged rolling median of |r|, 0 is NULL; score_d: |r| over it."""
    w = rows(BY, ["date"], -lookback, -1)
    scale = rolling(median, F.abs(F.col(r)), w, min_periods)
    out = returns.withColumn("scale", F.when(scale != 0, scale))
    return out.withColumn("score_d", F.abs(F.col(r)) / F.col("scale"))


def outlier_report(returns: DataFrame, r: str = "r", lookback: int = 252, min_periods: int = 126, d_max: float = 10.0, neighbour: float = 4.0) -> DataFrame:
    """Rows whose score is above ``d_max``, with neighbours, class and candidate; by score, date and tenor."""
    x = outlier_scores(returns, r, lookback, min_periods)
    across, along = W.partitionBy("date").orderBy("tenor"), W.partitionBy(*BY).orderBy("date")
    x = x.select("*", F.lag(r).over(across).alias("r_prev_mat"), F.lead(r).over(across).alias("r_next_mat"), F.lag(r).over(along).alias("r_prev_day"), F.lead(r).over(along).alias("r_next_day"), (F.row_number().over(along) - 1).alias("row_index"))
    moved = F.greatest(F.abs("r_prev_mat"), F.abs("r_next_mat")) > neighbour * F.col("scale")
    kind = F.when(F.coalesce(moved, F.lit(False)), "likely_genuine_market_event").otherwise("suspicious_isolated_outlier")
    action = F.when(kind == "suspicious_isolated_outlier", "review").otherwise("keep")
    return (
        x.where(F.col("score_d") > d_max)
        .select("date", "row_index", "tenor", F.col(r).alias("r_original"), "scale", "score_d", F.lit(float(d_max)).alias("d_max"), (d_max * F.col("scale")).alias("r_max"), (F.signum(r) * d_max * F.col("scale")).alias("r_winsorized_candidate"), "r_prev_mat", "r_next_mat", "r_prev_day", "r_next_day", kind.alias("auto_class"), action.alias("suggested_action"))
        .orderBy(F.desc("score_d"), "date", "tenor")
    )


def review(report: DataFrame, keep_dates: list[date] | tuple = ()) -> DataFrame:
    """Final action: listed dates are kept; what is suspicious and still up for review is winsorised; the rest is kept."""
    listed = F.col("date").isin(*keep_dates) if keep_dates else F.lit(False)
    suspicious = (F.col("auto_class") == "suspicious_isolated_outlier") & (F.col("suggested_action") == "review")
    return report.withColumn("final_action", F.when(listed, "keep").when(suspicious, "winsorize").otherwise("keep"))


def winsorize(returns: DataFrame, report: DataFrame, r: str = "r", action: str = "final_action") -> tuple[DataFrame, DataFrame]:
    """Returns after the report's actions (keep, winsorize, remove), and the log of treatments. Another action is an error when it is met."""
    a = report.select("date", "tenor", F.col(action).alias("action"), "r_winsorized_candidate", "score_d", "scale", "auto_class")
    x = returns.select("date", "tenor", F.col(r).alias("r_before_treatment")).join(a, ["date", "tenor"], "left")
    known = F.col("action").isNull() | F.col("action").isin("keep", "winsorize", "remove")
    after = (
        F.when(~known, F.raise_error(F.concat(F.lit("unknown action: "), "action")).cast("double"))
        .when(F.col("action") == "winsorize", F.col("r_winsorized_candidate"))
        .when(F.col("action") == "remove", F.lit(None).cast("double"))
        .otherwise(F.col("r_before_treatment"))
    )
    x = x.withColumn("r_after_treatment", after)
    log = x.where("action is not null").select("date", "tenor", "action", "r_before_treatment", "r_after_treatment", "score_d", "scale", "auto_class")
    return x.select("date", "tenor", F.col("r_after_treatment").alias(r)), log


def spreads(panel: DataFrame, pairs: list[tuple[int, int]], price: str = "price") -> DataFrame:
    """By date: price of the first tenor of each pair less that of the second."""
    at = lambda t: F.max(F.when(F.col("tenor") == t, F.col(price)))
    return panel.groupBy("date").agg(*((at(a) - at(b)).alias(f"spread_{a}_{b}") for a, b in pairs))
