"""Queries on the price panel: returns, quality, outliers, window features."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tenorlake.functions import dates
from tenorlake.functions.nulls import rolling, rows
from tenorlake.operators import audit, clean, econ, panel
from tenorlake.plans.registry import EPS, PANEL, RET, fin, query
from tenorlake.sources import tables


def returns(spark, d):
    return clean.log_returns(tables.price_panel(spark, d))


def eps(spark, d):
    return panel.demeaned(returns(spark, d))


@query(fin(PANEL, "date, tenor", "price", "SELECT * FROM panel"))
def s05_price_panel(spark, d):
    return tables.price_panel(spark, d)


@query(fin(PANEL, "date, tenor", "price", "SELECT * FROM panel WHERE date IN (SELECT date FROM panel GROUP BY date HAVING count(DISTINCT tenor) = (SELECT count(DISTINCT tenor) FROM panel))"))
def j01_balanced_panel(spark, d):
    return tables.balanced(tables.price_panel(spark, d))


@query(fin(PANEL, "date", "hh_1, hh_2, hh_3, hh_4, hh_5, hh_6, hh_7", "SELECT date, " + ", ".join(f"max(CASE WHEN tenor = {k} THEN price END) AS hh_{k}" for k in range(1, 8)) + " FROM panel GROUP BY date"))
def a14_wide_panel(spark, d):
    return tables.wide_panel(tables.price_panel(spark, d), "date", list(range(1, 8)), "price", "hh_")


@query(fin(PANEL, "date, tenor", "price", "SELECT * FROM panel"))
def a14_unpivot(spark, d):
    p = tables.price_panel(spark, d)
    return tables.long_panel(tables.wide_panel(p, "date", list(range(1, 8)), "price", "hh_"), "date", "hh_").where("price is not null")


@query(fin(RET, "date, tenor", "r", "SELECT * FROM ret"))
def w03_log_returns(spark, d):
    return returns(spark, d)


@query(fin(EPS, "date, tenor", "eps", "SELECT * FROM eps"))
def w18_demeaned(spark, d):
    return eps(spark, d)


@query(
    fin(
        PANEL,
        "tenor, n_obs, first_date, last_date, n_zero_neg, n_dup_dates, n_stale, n_extreme_ret",
        "max_pos_ret, max_neg_ret, pct_missing",
        "SELECT tenor, count(price) AS n_obs, min(date) AS first_date, max(date) AS last_date, count(*) FILTER (price <= 0) AS n_zero_neg, count(*) FILTER (date = d1) AS n_dup_dates, count(*) FILTER (price = p1) AS n_stale, max(price / p1 - 1) AS max_pos_ret, min(price / p1 - 1) AS max_neg_ret, count(*) FILTER (abs(price / p1 - 1) > 0.15) AS n_extreme_ret, 100 * (1 - count(price) / (SELECT count(DISTINCT date) FROM panel)) AS pct_missing FROM (SELECT *, lag(price) OVER w AS p1, lag(date) OVER w AS d1 FROM panel WINDOW w AS (PARTITION BY tenor ORDER BY date)) GROUP BY tenor",
    )
)
def a22_dq_report(spark, d):
    return clean.dq_report(tables.price_panel(spark, d))


ROLLS = "months AS (SELECT CAST(unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi) + INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS DATE) AS month FROM (SELECT min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders)), rolls AS (SELECT month, month - CASE isodow(month) WHEN 1 THEN 4 WHEN 2 THEN 4 WHEN 7 THEN 3 ELSE 2 END AS roll_date FROM months)"


@query(fin(ROLLS, "month, roll_date", "", "SELECT * FROM rolls"))
def f14_roll_dates(spark, d):
    orders = tables.table(spark, d, "orders", "o_orderdate").select(F.to_date("o_orderdate").alias("date"))
    m = dates.month_starts(orders)
    return m.select("month", dates.roll_date("month").alias("roll_date"))


def weekly_rolls(spark, d):
    """The first week of each month stands for the roll date, as the panel is weekly."""
    p = tables.price_panel(spark, d)
    return p, p.groupBy(F.trunc("date", "MM").alias("m")).agg(F.min("date").alias("date")).select("date")


ADJ = PANEL + (
    ", rolls AS (SELECT min(date) AS date FROM panel GROUP BY date_trunc('month', date)), l1 AS (SELECT date, tenor, price AS p, lag(price) OVER (PARTITION BY tenor ORDER BY date) AS p1 FROM panel), "
    "l2 AS (SELECT *, lead(p1) OVER (PARTITION BY date ORDER BY tenor) AS n1, lead(tenor) OVER (PARTITION BY date ORDER BY tenor) AS nt FROM l1), "
    "adj AS (SELECT date, tenor, CASE WHEN date IN (SELECT date FROM rolls) AND nt = tenor + 1 AND n1 > 0 THEN ln(p / n1) ELSE ln(p / p1) END AS r, ln(p / p1) AS r_raw, date IN (SELECT date FROM rolls) AS is_roll FROM l2 WHERE tenor < (SELECT max(tenor) FROM panel) AND p1 IS NOT NULL)"
)


@query(fin(ADJ, "date, tenor, is_roll", "r, r_raw", "SELECT * FROM adj"))
def x01_roll_adjust(spark, d):
    return clean.roll_adjust(*weekly_rolls(spark, d))


def _ratio(name, fn):
    return f"{fn.format(x=f'CASE WHEN is_roll THEN abs({name}) END')} / {fn.format(x=f'CASE WHEN NOT is_roll THEN abs({name}) END')}"


@query(fin(ADJ, "tenor", "r_raw_mean_ratio, r_raw_median_ratio, r_mean_ratio, r_median_ratio", "SELECT tenor, " + ", ".join(f"{_ratio(n, f)} AS {n}_{k}_ratio" for n in ("r_raw", "r") for k, f in (("mean", "avg({x})"), ("median", "median({x})"))) + " FROM adj GROUP BY tenor"))
def a23_roll_comparison(spark, d):
    return clean.roll_comparison(clean.roll_adjust(*weekly_rolls(spark, d)))


SCORES = RET + ", sc AS (SELECT *, CASE WHEN count(r) OVER w >= 20 THEN nullif(median(abs(r)) OVER w, 0) END AS scale FROM ret WINDOW w AS (PARTITION BY tenor ORDER BY date ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING))"


@query(fin(SCORES, "date, tenor", "r, scale, score_d", "SELECT *, abs(r) / scale AS score_d FROM sc"))
def w09_lagged_median(spark, d):
    return clean.outlier_scores(returns(spark, d), "r", 52, 20)


REPORT = SCORES + (
    ", nb AS (SELECT *, abs(r) / scale AS score_d, lag(r) OVER (PARTITION BY date ORDER BY tenor) AS r_prev_mat, lead(r) OVER (PARTITION BY date ORDER BY tenor) AS r_next_mat, lag(r) OVER (PARTITION BY tenor ORDER BY date) AS r_prev_day, lead(r) OVER (PARTITION BY tenor ORDER BY date) AS r_next_day, row_number() OVER (PARTITION BY tenor ORDER BY date) - 1 AS row_index FROM sc), "
    "rep AS (SELECT date, row_index, tenor, r AS r_original, scale, score_d, 3.0::DOUBLE AS d_max, 3 * scale AS r_max, sign(r) * 3 * scale AS r_winsorized_candidate, r_prev_mat, r_next_mat, r_prev_day, r_next_day, CASE WHEN greatest(abs(r_prev_mat), abs(r_next_mat)) > 2 * scale THEN 'likely_genuine_market_event' ELSE 'suspicious_isolated_outlier' END AS auto_class FROM nb WHERE score_d > 3), "
    "rep2 AS (SELECT *, CASE WHEN auto_class = 'suspicious_isolated_outlier' THEN 'review' ELSE 'keep' END AS suggested_action, CASE WHEN date = DATE '1997-06-02' THEN 'keep' WHEN auto_class = 'suspicious_isolated_outlier' THEN 'winsorize' ELSE 'keep' END AS final_action FROM rep)"
)


def _report(spark, d):
    from datetime import date

    return clean.review(clean.outlier_report(returns(spark, d), "r", 52, 20, 3.0, 2.0), [date(1997, 6, 2)])


@query(fin(REPORT, "date, CAST(row_index AS INTEGER) AS row_index, tenor, auto_class, suggested_action, final_action", "r_original, scale, score_d, d_max, r_max, r_winsorized_candidate, r_prev_mat, r_next_mat, r_prev_day, r_next_day", "SELECT * FROM rep2"))
def x02_outlier_report(spark, d):
    return _report(spark, d)


@query(fin(REPORT, "date, tenor", "r", "SELECT ret.date, ret.tenor, CASE WHEN rep2.final_action = 'winsorize' THEN rep2.r_winsorized_candidate ELSE ret.r END AS r FROM ret LEFT JOIN rep2 USING (date, tenor)"))
def x04_winsorize(spark, d):
    return clean.winsorize(returns(spark, d), _report(spark, d))[0]


@query(fin(REPORT, "date, tenor, action, auto_class", "r_before_treatment, r_after_treatment, score_d, scale", "SELECT date, tenor, final_action AS action, auto_class, r_original AS r_before_treatment, CASE WHEN final_action = 'winsorize' THEN r_winsorized_candidate ELSE r_original END AS r_after_treatment, score_d, scale FROM rep2"))
def x03_treatment_log(spark, d):
    return clean.winsorize(returns(spark, d), _report(spark, d))[1]


def _roll(fn, n, k):
    return f"CASE WHEN count(eps) OVER w{n} >= {k} THEN {fn}(eps) OVER w{n} END"


RESID = EPS + (
    f", f1 AS (SELECT date, tenor, eps, lag(eps, 1) OVER w AS eps_lag_1, lag(eps, 5) OVER w AS eps_lag_5, {_roll('avg', 5, 3)} AS m5, {_roll('avg', 20, 10)} AS m20, {_roll('stddev_samp', 20, 10)} AS s20, {_roll('stddev_samp', 63, 30)} AS s63, {_roll('sum', 5, 3)} AS c5, {_roll('sum', 20, 10)} AS c20, eps - avg(eps) OVER (PARTITION BY date) AS eps_vs_curve, stddev_samp(eps) OVER (PARTITION BY date) AS eps_curve_std, "
    "lag(eps, 2) OVER c AS b2, lag(eps) OVER c AS b1, lead(eps) OVER c AS a1, lead(eps, 2) OVER c AS a2, row_number() OVER c AS k, count(*) OVER (PARTITION BY date) AS n FROM eps "
    "WINDOW w AS (PARTITION BY tenor ORDER BY date), c AS (PARTITION BY date ORDER BY tenor), " + ", ".join(f"w{n} AS (PARTITION BY tenor ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (5, 20, 63)) + "), "
    "feat AS (SELECT date, tenor, eps, eps_lag_1, eps_lag_5, m5 AS eps_rolling_mean_5, m20 AS eps_rolling_mean_20, s20 AS eps_rolling_std_20, s63 AS eps_rolling_std_63, eps / nullif(s20, 0) AS eps_zscore_20, eps / nullif(s63, 0) AS eps_zscore_63, m5 / nullif(s20, 0) AS eps_momentum_5, m20 / nullif(s20, 0) AS eps_momentum_20, c5 AS cum_dislocation_5, c20 AS cum_dislocation_20, c5 / nullif(sqrt(5) * s63, 0) AS eps_cum5_zscore, eps_vs_curve, eps_curve_std, CASE WHEN n < 3 THEN NULL WHEN k = 1 THEN a2 - 2 * a1 + eps WHEN k = n THEN eps - 2 * b1 + b2 ELSE a1 - 2 * eps + b1 END AS eps_local_curvature FROM f1)"
)


@query(fin(RESID, "date, tenor", ", ".join(panel.RESIDUAL_FEATURES), "SELECT * FROM feat"))
def x05_residual_features(spark, d):
    return panel.residual_features(eps(spark, d))


@query(fin(RESID, "date, tenor", "eps_local_curvature", "SELECT * FROM feat"))
def j15_local_curvature(spark, d):
    return panel.residual_features(eps(spark, d)).select("date", "tenor", "eps_local_curvature")


TARGET = EPS + ", tg AS (SELECT date, tenor, CASE WHEN count(eps) OVER a >= 5 THEN sum(eps) OVER a END AS y_raw, CASE WHEN count(eps) OVER b >= 30 THEN stddev_samp(eps) OVER b END AS sd FROM eps WINDOW a AS (PARTITION BY tenor ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), b AS (PARTITION BY tenor ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)), target AS (SELECT date, tenor, y_raw, CASE WHEN y_raw IS NOT NULL AND sd IS NOT NULL THEN least(greatest(y_raw / nullif(sqrt(5) * sd, 0), -3), 3) END AS y_z FROM tg)"


@query(fin(TARGET, "date, tenor", "y_raw, y_z", "SELECT * FROM target"))
def w20_forward_target(spark, d):
    return panel.forward_target(eps(spark, d), bound=3.0)


@query(fin(EPS, "date, tenor", "x, past, future", "SELECT date, tenor, eps AS x, CASE WHEN count(eps) OVER a >= 21 THEN stddev_samp(eps) OVER a END AS past, CASE WHEN count(eps) OVER b >= 5 THEN avg(eps) OVER b END AS future FROM eps WINDOW a AS (PARTITION BY tenor ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY tenor ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"))
def w08_lagged_std_w21_future_mean(spark, d):
    past, future = rows(("tenor",), ["date"], -60, -1), rows(("tenor",), ["date"], 1, 5)
    return eps(spark, d).select("date", "tenor", F.col("eps").alias("x"), rolling(F.stddev_samp, "eps", past, 21).alias("past"), rolling(F.avg, "eps", future, 5).alias("future"))


@query(fin(RET, "date, tenor", "vol21, vol30, vol63", "SELECT date, tenor, " + ", ".join(f"CASE WHEN count(r) OVER w{n} = {n} THEN stddev_samp(r) OVER w{n} * sqrt(252) END AS vol{n}" for n in (21, 30, 63)) + " FROM ret WINDOW " + ", ".join(f"w{n} AS (PARTITION BY tenor ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (21, 30, 63))))
def w10_rolling_vol(spark, d):
    return returns(spark, d).select("date", "tenor", *((rolling(F.stddev_samp, "r", rows(("tenor",), ["date"], -n + 1, 0), n) * 252**0.5).alias(f"vol{n}") for n in (21, 30, 63)))


@query(fin(EPS, "date, tenor", "ewm", "SELECT a.date, a.tenor, sum(b.eps * pow(0.7, a.k - b.k)) / sum(pow(0.7, a.k - b.k)) AS ewm FROM (SELECT *, row_number() OVER (PARTITION BY tenor ORDER BY date) AS k FROM eps) a JOIN (SELECT *, row_number() OVER (PARTITION BY tenor ORDER BY date) AS k FROM eps) b ON a.tenor = b.tenor AND b.k <= a.k GROUP BY 1, 2"))
def w19_ewm_signal(spark, d):
    return panel.ewm(eps(spark, d), "eps", 0.3, ("tenor",)).select("date", "tenor", "ewm")


@query(fin(EPS, "date, tenor", "weight, held", "SELECT date, tenor, eps AS weight, avg(eps) OVER (PARTITION BY tenor ORDER BY date ROWS BETWEEN 6 PRECEDING AND 2 PRECEDING) AS held FROM eps"))
def w22_overlap_weights(spark, d):
    return panel.overlap(eps(spark, d).withColumnRenamed("eps", "weight"))


@query(fin(RET, "date, tenor", "cum, drawdown", "SELECT date, tenor, cum, cum - max(cum) OVER (PARTITION BY tenor ORDER BY date) AS drawdown FROM (SELECT date, tenor, sum(r) OVER (PARTITION BY tenor ORDER BY date) AS cum FROM ret)"))
def w13_drawdown(spark, d):
    return panel.drawdown(returns(spark, d), "r", ("tenor",), "date").select("date", "tenor", "cum", "drawdown")


@query(fin(RET, "passed, total", "", "SELECT count(*) FILTER (r1 IS NOT DISTINCT FROM l) AS passed, count(*) AS total FROM (SELECT r1, lag(r) OVER (PARTITION BY tenor ORDER BY date) AS l FROM (SELECT *, lag(r) OVER (PARTITION BY tenor ORDER BY date) AS r1 FROM ret))"))
def x23_lag_check(spark, d):
    r = returns(spark, d)
    return panel.lag_check(r.withColumn("r1", F.lag("r").over(W.partitionBy("tenor").orderBy("date"))), "r", "r1", ("tenor",))


@query(fin(PANEL, "date", "spread_1_7, spread_1_6, spread_3_5", "SELECT date, max(CASE WHEN tenor = 1 THEN price END) - max(CASE WHEN tenor = 7 THEN price END) AS spread_1_7, max(CASE WHEN tenor = 1 THEN price END) - max(CASE WHEN tenor = 6 THEN price END) AS spread_1_6, max(CASE WHEN tenor = 3 THEN price END) - max(CASE WHEN tenor = 5 THEN price END) AS spread_3_5 FROM panel GROUP BY date"))
def x27_curve_spreads(spark, d):
    return clean.spreads(tables.price_panel(spark, d), [(1, 7), (1, 6), (3, 5)])


@query(fin(PANEL, "date", "spread_1_7", "SELECT date, max(CASE WHEN tenor = 1 THEN price END) - max(CASE WHEN tenor = 7 THEN price END) AS spread_1_7 FROM panel GROUP BY date ORDER BY spread_1_7 DESC NULLS LAST, date LIMIT 10"))
def o02_top_backwardation(spark, d):
    s = clean.spreads(tables.price_panel(spark, d), [(1, 7)])
    return s.orderBy(F.desc_nulls_last("spread_1_7"), "date").limit(10)


CORR = "covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"


@query(fin(RET, "name_a, name_b", "corr", f"SELECT a.tenor AS name_a, b.tenor AS name_b, {CORR.format(a='a.r', b='b.r')} AS corr FROM ret a JOIN ret b ON a.date = b.date AND a.tenor < b.tenor GROUP BY 1, 2"))
def a15_corr_pairs(spark, d):
    return audit.tenor_correlations(returns(spark, d), "r")


RANKED = RET + ", rk AS (SELECT date, tenor, rank() OVER (PARTITION BY tenor ORDER BY r) + (count(*) OVER (PARTITION BY tenor, r) - 1) / 2.0 AS v FROM ret)"


@query(fin(RANKED, "name_a, name_b", "corr", f"SELECT a.tenor AS name_a, b.tenor AS name_b, {CORR.format(a='a.v', b='b.v')} AS corr FROM rk a JOIN rk b ON a.date = b.date AND a.tenor < b.tenor GROUP BY 1, 2"))
def a16_spearman_matrix(spark, d):
    return audit.tenor_correlations(returns(spark, d), "r", rank=True)


@query(fin(RET, "", "mean_abs, max_abs", f"SELECT avg(abs(c)) AS mean_abs, max(abs(c)) AS max_abs FROM (SELECT {CORR.format(a='a.r', b='b.r')} AS c FROM ret a JOIN ret b ON a.date = b.date AND a.tenor < b.tenor GROUP BY a.tenor, b.tenor)"))
def a17_off_diagonal(spark, d):
    from tenorlake.operators import factor

    return factor.off_diagonal(returns(spark, d), "r")


@query(fin(RET, "tenor", "skew, kurtosis", "SELECT tenor, skewness(r) AS skew, kurtosis(r) AS kurtosis FROM ret GROUP BY tenor"))
def a20_skew_kurtosis(spark, d):
    from tenorlake.functions.nulls import kurt, skew

    return returns(spark, d).groupBy("tenor").agg(skew("r").alias("skew"), kurt("r").alias("kurtosis"))


@query(fin(RET, "bin, n", "lft, density", "SELECT bin, CAST(-0.5 + bin * 0.05 AS DOUBLE) AS lft, n, n / (sum(n) OVER () * 0.05::DOUBLE) AS density FROM (SELECT least(CAST(floor((r + 0.5) / 0.05::DOUBLE) AS INTEGER), 19) AS bin, count(*) AS n FROM ret WHERE r BETWEEN -0.5 AND 0.5 GROUP BY 1)"))
def a21_histogram(spark, d):
    return audit.histogram(returns(spark, d), "r", -0.5, 0.5, 20).withColumnRenamed("left", "lft")


@query(fin(RET, "feature, count", "mean, std, min, q25, q50, q75, max", "SELECT 'r' AS feature, count(r) AS count, avg(r) AS mean, stddev_samp(r) AS std, min(r) AS min, quantile_cont(r, 0.25) AS q25, quantile_cont(r, 0.5) AS q50, quantile_cont(r, 0.75) AS q75, max(r) AS max FROM ret"))
def a02_describe(spark, d):
    return audit.describe(returns(spark, d), ["r"])


@query(fin(RET, "tenor, n", "mean, std, min, max, total, median", "SELECT tenor, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS std, min(r) AS min, max(r) AS max, sum(r) AS total, median(r) AS median FROM ret GROUP BY tenor"))
def a01_basic_aggregates(spark, d):
    return returns(spark, d).groupBy("tenor").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.min("r").alias("min"), F.max("r").alias("max"), F.sum("r").alias("total"), F.percentile("r", F.lit(0.5)).alias("median"))


@query(fin(EPS, "tenor", "raw_vol, residual_vol, ratio, raw_ann, residual_ann", "SELECT tenor, stddev_samp(r) AS raw_vol, stddev_samp(eps) AS residual_vol, stddev_samp(eps) / stddev_samp(r) AS ratio, stddev_samp(r) * sqrt(252) AS raw_ann, stddev_samp(eps) * sqrt(252) AS residual_ann FROM ret JOIN eps USING (date, tenor) GROUP BY tenor"))
def a32_vol_table(spark, d):
    x = returns(spark, d).select("date", "tenor", "r", (F.col("r") - F.avg("r").over(W.partitionBy("date"))).alias("eps"))
    raw, res = F.stddev_samp("r"), F.stddev_samp("eps")
    return x.groupBy("tenor").agg(raw.alias("raw_vol"), res.alias("residual_vol"), (res / raw).alias("ratio"), (raw * 252**0.5).alias("raw_ann"), (res * 252**0.5).alias("residual_ann"))


@query(fin(EPS, "tenor", "r2, rmse, mae", "SELECT tenor, 1 - sum(eps * eps) / (var_pop(r) * count(r)) AS r2, sqrt(avg(eps * eps)) AS rmse, avg(abs(eps)) AS mae FROM ret JOIN eps USING (date, tenor) GROUP BY tenor"))
def a19_decomposition_r2(spark, d):
    x = returns(spark, d).select("tenor", "r", (F.col("r") - F.avg("r").over(W.partitionBy("date"))).alias("eps"))
    return x.groupBy("tenor").agg((1 - F.sum(F.col("eps") * F.col("eps")) / (F.var_pop("r") * F.count("r"))).alias("r2"), F.sqrt(F.avg(F.col("eps") * F.col("eps"))).alias("rmse"), F.avg(F.abs("eps")).alias("mae"))


@query(fin(PANEL, "date, tenor", "price", "SELECT date, tenor, price FROM (SELECT *, row_number() OVER (PARTITION BY tenor ORDER BY date) AS k FROM panel) WHERE (k - 1) % 7 = 0"))
def p07_every_nth(spark, d):
    return audit.every_nth(tables.price_panel(spark, d), 7, ("tenor",), "date")


@query(fin(PANEL, "tenor", "price", "SELECT tenor, price FROM panel WHERE date = (SELECT max(date) FROM panel)"))
def o04_last_date_slice(spark, d):
    p = tables.price_panel(spark, d)
    return p.join(F.broadcast(p.agg(F.max("date").alias("date"))), "date", "left_semi").select("tenor", "price")


@query(fin(RET, "tenor, lag", "acf", "SELECT tenor, k AS lag, sum(u * v) / sum(u * u) AS acf FROM (SELECT tenor, u, k, lag(u, k) OVER (PARTITION BY tenor, k ORDER BY date) AS v FROM (SELECT tenor, date, r - avg(r) OVER (PARTITION BY tenor) AS u FROM ret) CROSS JOIN (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS k)) GROUP BY 1, 2"))
def m32_autocorrelation(spark, d):
    return econ.autocorrelation(returns(spark, d), "r", ("tenor",), "date", 3).select("tenor", "lag", "acf")


ACF = RET + ", kk AS (SELECT tenor, k, sum(u * v) / sum(u * u) AS r FROM (SELECT tenor, u, k, lag(u, k) OVER (PARTITION BY tenor, k ORDER BY date) AS v FROM (SELECT tenor, date, r - avg(r) OVER (PARTITION BY tenor) AS u FROM ret) CROSS JOIN (SELECT CAST(unnest(generate_series(1, 60)) AS INTEGER) AS k)) GROUP BY 1, 2)"


@query(fin(ACF + ", w AS (SELECT tenor, max(r) FILTER (k = 1) AS a, max(r) FILTER (k = 2) AS b, max(r) FILTER (k = 3) AS c FROM kk GROUP BY tenor)", "tenor, lag", "pacf", "SELECT tenor, 1 AS lag, a AS pacf FROM w UNION ALL SELECT tenor, 2, (b - a * a) / (1 - a * a) FROM w UNION ALL SELECT tenor, 3, (a * a * a - 2 * a * b + a * b * b + c - a * a * c) / (1 - 2 * a * a - b * b + 2 * a * a * b) FROM w"))
def m32_partial_autocorrelation(spark, d):
    return econ.partial_autocorrelation(econ.autocorrelation(returns(spark, d), "r", ("tenor",), "date", 3), ("tenor",))


KPSS = ACF + (
    ", us AS (SELECT tenor, u, sum(u) OVER (PARTITION BY tenor ORDER BY date ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT tenor, date, r - avg(r) OVER (PARTITION BY tenor) AS u FROM ret)), "
    "bs AS (SELECT tenor, sum(s * s) AS ss, sum(u * u) AS uu, count(*) AS n FROM us GROUP BY tenor), "
    "fw AS (SELECT tenor, 2 * sum(k * r) / (1 + 2 * sum(r)) AS q FROM kk JOIN bs USING (tenor) WHERE k <= floor(pow(n, 2.0 / 9)) GROUP BY tenor), "
    "lg AS (SELECT bs.*, CAST(least(floor(1.1447 * pow(q * q, 1.0 / 3) * pow(n, 1.0 / 3)), n - 1, 60) AS INTEGER) AS lags FROM bs JOIN fw USING (tenor)), "
    "sp AS (SELECT tenor, sum((1 - k / (lags + 1.0::DOUBLE)) * r) AS m FROM kk JOIN lg USING (tenor) WHERE k <= lags GROUP BY tenor), "
    "kp AS (SELECT tenor, lags, n, ss / (n * CAST(n AS DOUBLE)) / (uu / n * (1 + 2 * coalesce(m, 0))) AS kpss FROM lg LEFT JOIN sp USING (tenor))"
)


@query(fin(KPSS, "tenor, lags, n", "kpss, p", "SELECT *, CASE WHEN kpss < 0.347 THEN 0.1::DOUBLE WHEN kpss < 0.463 THEN 0.1::DOUBLE - (kpss - 0.347) / 0.116 * 0.05 WHEN kpss < 0.574 THEN 0.05::DOUBLE - (kpss - 0.463) / 0.111 * 0.025 WHEN kpss < 0.739 THEN 0.025::DOUBLE - (kpss - 0.574) / 0.165 * 0.015 ELSE 0.01::DOUBLE END AS p FROM kp"))
def m32_kpss(spark, d):
    return econ.kpss(returns(spark, d), "r", ("tenor",), "date")


@query()
def m32_unit_root(spark, d):
    return econ.unit_root(returns(spark, d), "r", "tenor", "date")


@query()
def m32_ljung_box_arch(spark, d):
    r = returns(spark, d)
    q = econ.ljung_box(econ.autocorrelation(r, "r", ("tenor",), "date"), ("tenor",)).withColumn("key", F.col("tenor").cast("string"))
    return q.join(econ.arch_lm(r, "r", ("tenor",), "date"), "key").select("tenor", "q", "lm")


@query(fin(RET + ", h AS (SELECT stddev_samp(r) * pow(count(*), -0.2) AS h FROM ret), gr AS (SELECT k / 20.0::DOUBLE AS at_ FROM (SELECT unnest(range(-10, 11)) AS k))", "", "point, density, normal", "SELECT at_ AS point, avg(exp(-0.5::DOUBLE * ((at_ - r) / h) ** 2) / (h * sqrt(2 * pi()))) AS density, exp(-0.5::DOUBLE * (at_ / 0.1::DOUBLE) ** 2) / (0.1::DOUBLE * sqrt(2 * pi())) AS normal FROM gr, h, ret GROUP BY at_"))
def m33_kernel_density(spark, d):
    grid = spark.range(-10, 11).select((F.col("id") / 20).alias("at"))
    k = audit.kernel_density(returns(spark, d), "r", grid)
    return k.withColumn("normal", audit.normal_pdf("at", 0.0, 0.1)).withColumnRenamed("at", "point")
