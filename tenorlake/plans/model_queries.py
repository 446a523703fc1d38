"""Queries on predictions: rank correlations, P&L rules, regressions, regimes, factor models, weights, streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tenorlake.functions.nulls import safe_bin
from tenorlake.operators import audit, econ, evaluate, factor, models, panel, portfolio, regimes
from tenorlake.plans.panel_queries import eps, returns
from tenorlake.plans.registry import EPS, IC, INTRA, PRED, RET, fin, query
from tenorlake.sources import tables
from tenorlake.streaming import bars


def predictions(spark, d):
    """A reversal signal: yesterday's residual with its sign turned."""
    w = W.partitionBy("tenor").orderBy("date")
    return eps(spark, d).select("date", "tenor", F.col("eps").alias("y_true"), (-F.lag("eps").over(w)).alias("y_pred")).where("y_pred is not null")


def ics(spark, d):
    return evaluate.spearman(predictions(spark, d), "y_pred", "y_true", ("date",))


def intraday(spark, d):
    return tables.intraday_panel(spark, d)


@query(fin(IC, "date, n", "ic", "SELECT * FROM ic"))
def m19_spearman_ic(spark, d):
    return ics(spark, d)


@query(fin(IC, "n", "mean_ic, sem, icir, t", "SELECT count(ic) AS n, avg(ic) AS mean_ic, stddev_samp(ic) / sqrt(count(ic)) AS sem, avg(ic) / stddev_samp(ic) AS icir, avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) AS t FROM ic"))
def a06_ic_summary(spark, d):
    return evaluate.ic_summary(ics(spark, d))


@query(fin(IC, "date", "ic, ic_mean, ic_std, icir_roll, ic_cum", "SELECT date, ic, m AS ic_mean, s AS ic_std, m / nullif(s, 0) AS icir_roll, sum(ic) OVER (ORDER BY date) AS ic_cum FROM (SELECT date, ic, CASE WHEN count(ic) OVER w >= 21 THEN avg(ic) OVER w END AS m, CASE WHEN count(ic) OVER w >= 21 THEN stddev_samp(ic) OVER w END AS s FROM ic WINDOW w AS (ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))"))
def w11_rolling_ic(spark, d):
    return evaluate.rolling_ic(ics(spark, d)).drop("n")


DECAY = PRED + (
    ", ah AS (SELECT date, tenor, h, y_pred, lead(y_true, CAST(h AS INTEGER)) OVER (PARTITION BY tenor, h ORDER BY date) AS v FROM pred CROSS JOIN (SELECT unnest(generate_series(1, 10)) AS h)), "
    "rr AS (SELECT date, h, rank() OVER (PARTITION BY date, h ORDER BY y_pred) AS a, rank() OVER (PARTITION BY date, h ORDER BY v) AS b FROM ah WHERE v IS NOT NULL), "
    "di AS (SELECT date, h, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS ic FROM rr GROUP BY 1, 2 HAVING count(*) >= 4)"
)


@query(fin(DECAY, "h, n", "mean_ic, t", "SELECT CAST(h AS INTEGER) AS h, count(ic) AS n, avg(ic) AS mean_ic, avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) AS t FROM di GROUP BY h"))
def m20_signal_decay(spark, d):
    return evaluate.decay(predictions(spark, d), "y_pred", "y_true", 10)


@query(fin(PRED + ", rt AS (SELECT tenor, y_pred, y_true, rank() OVER (PARTITION BY tenor ORDER BY y_pred) AS a, rank() OVER (PARTITION BY tenor ORDER BY y_true) AS b FROM pred)", "tenor, n", "ic, mse", "SELECT tenor, count(*) AS n, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS ic, avg((y_pred - y_true) ** 2) AS mse FROM rt GROUP BY tenor HAVING count(*) >= 10"))
def m25_ts_ic_by_tenor(spark, d):
    return evaluate.by_tenor(predictions(spark, d), "y_pred", "y_true")


@query(fin(PRED, "tenor", "slope, intercept", "SELECT tenor, regr_slope(y_true, y_pred) AS slope, regr_intercept(y_true, y_pred) AS intercept FROM pred GROUP BY tenor"))
def m26_calibration_slope(spark, d):
    return evaluate.calibration(predictions(spark, d), "y_pred", "y_true", ("tenor",))


@query(fin(PRED, "", "dir_acc, r2, rmse, mae, corr", "SELECT avg(CAST(sign(y_pred) = sign(y_true) AS INTEGER)) AS dir_acc, 1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*)) AS r2, sqrt(avg((y_true - y_pred) ** 2)) AS rmse, avg(abs(y_true - y_pred)) AS mae, corr(y_true, y_pred) AS corr FROM pred"))
def m24_regression_scores(spark, d):
    return predictions(spark, d).agg(evaluate.hit_rate("y_pred", "y_true").alias("dir_acc"), *evaluate.regression_scores("y_pred", "y_true"))


SEG = "CASE WHEN tenor <= 2 THEN 'front' WHEN tenor <= 5 THEN 'belly' ELSE 'back' END"


@query(fin(PRED + f", sg AS (SELECT {SEG} AS segment, CAST(date_trunc('month', date) AS DATE) AS month, y_pred, y_true FROM pred), rs AS (SELECT segment, month, rank() OVER (PARTITION BY segment, month ORDER BY y_pred) AS a, rank() OVER (PARTITION BY segment, month ORDER BY y_true) AS b FROM sg)", "segment, month, n", "ic", "SELECT segment, month, count(*) AS n, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS ic FROM rs GROUP BY 1, 2 HAVING count(*) >= 4"))
def m27_segment_ic(spark, d):
    x = predictions(spark, d).withColumn("segment", evaluate.segments("tenor")).withColumn("month", F.trunc("date", "MM"))
    return evaluate.spearman(x, "y_pred", "y_true", ("segment", "month"))


@query(fin(IC, "bin, n", "mean, se, ci95, t", "SELECT bin, count(ic) AS n, avg(ic) AS mean, stddev_samp(ic) / sqrt(count(ic)) AS se, 1.96 * stddev_samp(ic) / sqrt(count(ic)) AS ci95, avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) AS t FROM (SELECT ic, CASE WHEN month(date) BETWEEN 4 AND 10 THEN 'Apr-Oct' ELSE 'Nov-Mar' END AS bin FROM ic) GROUP BY bin"))
def m29_ic_by_season(spark, d):
    from tenorlake.functions import dates

    return evaluate.by_bin(ics(spark, d).withColumn("bin", dates.season("date")), "bin", "ic")


@query(fin(PRED + ", q AS (SELECT quantile_cont(y_pred, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM pred)", "bin, n", "mean, se, ci95, t", "SELECT bin, count(y_true) AS n, avg(y_true) AS mean, stddev_samp(y_true) / sqrt(count(*)) AS se, 1.96 * stddev_samp(y_true) / sqrt(count(*)) AS ci95, avg(y_true) / (stddev_samp(y_true) / sqrt(count(*))) AS t FROM (SELECT y_true, CAST(1 + len(list_filter(e, lambda x: y_pred > x)) AS INTEGER) AS bin FROM pred, q) GROUP BY bin"))
def f06_decile_conviction(spark, d):
    return evaluate.by_bin(evaluate.quantile_bins(predictions(spark, d), "y_pred", 10), "bin", "y_true")


@query(fin(PRED + ", so AS (SELECT date, tenor, row_number() OVER (PARTITION BY date ORDER BY y_pred, tenor) AS r, count(*) OVER (PARTITION BY date) AS n FROM pred)", "date, tenor, bin", "", "SELECT date, tenor, CASE WHEN n >= 4 THEN CAST(greatest(1, ceil(((r - 1) * 4) / (n - 1))) AS INTEGER) END AS bin FROM so"))
def f07_safe_quartile(spark, d):
    return predictions(spark, d).select("date", "tenor", safe_bin("y_pred", 4, ["date"], ["tenor"]).alias("bin"))


@query(fin(PRED + ", so AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY y_pred, tenor) AS up, count(*) OVER (PARTITION BY date) AS n FROM pred), ps AS (SELECT date, tenor, y_true, CASE WHEN up <= 2 THEN -1 WHEN up > n - 2 THEN 1 ELSE 0 END AS position FROM so)", "date", "pnl", "SELECT date, sum(position * y_true) AS pnl FROM ps GROUP BY date"))
def m30_topk_pnl(spark, d):
    p = evaluate.extremes(predictions(spark, d), "y_pred", 2, ("date",), ("tenor",))
    return p.groupBy("date").agg(F.sum(F.col("position") * F.col("y_true")).alias("pnl"))


@query(fin(PRED, "tenor, trades", "pnl, sharpe", "SELECT tenor, count(*) FILTER (abs(y_pred) >= 0.02) AS trades, sum(CASE WHEN abs(y_pred) >= 0.02 THEN sign(y_pred) ELSE 0 END * y_true) AS pnl, avg(CASE WHEN abs(y_pred) >= 0.02 THEN sign(y_pred) ELSE 0 END * y_true) / stddev_samp(CASE WHEN abs(y_pred) >= 0.02 THEN sign(y_pred) ELSE 0 END * y_true) * sqrt(252) AS sharpe FROM pred GROUP BY tenor"))
def m28_threshold_pnl_sharpe(spark, d):
    p = predictions(spark, d).withColumn("z", evaluate.threshold_rule("y_pred", 0.02)).withColumn("pnl", F.col("z") * F.col("y_true"))
    return p.groupBy("tenor").agg(F.count_if(F.abs("y_pred") >= 0.02).alias("trades"), F.sum("pnl").alias("pnl"), econ.sharpe("pnl").alias("sharpe2")).withColumnRenamed("sharpe2", "sharpe")


@query(fin(IC + ", s AS (SELECT *, month(date) IN (1, 2) AS ev FROM ic)", "", "t", "SELECT (avg(ic) FILTER (ev) - avg(ic) FILTER (NOT ev)) / sqrt(var_samp(ic) FILTER (ev) / count(*) FILTER (ev) + var_samp(ic) FILTER (NOT ev) / count(*) FILTER (NOT ev)) AS t FROM s"))
def m15_welch_t(spark, d):
    return ics(spark, d).agg(econ.welch("ic", F.month("date").isin(1, 2)).alias("t"))


NW = IC + (
    ", u AS (SELECT ic - avg(ic) OVER () AS u, avg(ic) OVER () AS m, count(*) OVER () AS n, row_number() OVER (ORDER BY date) AS i FROM ic WHERE ic IS NOT NULL), "
    "g AS (SELECT k.l, sum(a.u * b.u) AS s FROM (SELECT unnest(generate_series(0, (SELECT CAST(floor(4 * pow(max(n) / 100, 2.0 / 9)) AS BIGINT) FROM u))) AS l) k JOIN u a ON true JOIN u b ON b.i = a.i - k.l GROUP BY 1)"
)


@query(fin(NW, "n", "mean, t_nw", "SELECT (SELECT max(n) FROM u) AS n, (SELECT max(m) FROM u) AS mean, (SELECT max(m) FROM u) / sqrt((SELECT sum(CASE WHEN l = 0 THEN 1 ELSE 2 * (1 - l / ((SELECT max(l) FROM g) + 1)) END * s) FROM g) / (SELECT max(n) * max(n) FROM u)) AS t_nw"))
def m11_nw_tstat(spark, d):
    return econ.newey_west(ics(spark, d).withColumn("k", F.lit(1)), "ic", ("k",), "date").select("n", "mean", "t_nw")


@query(fin(IC, "year, n", "t", "SELECT CAST(year(date) AS INTEGER) AS year, count(ic) AS n, avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)), 0) AS t FROM ic GROUP BY 1"))
def a25_t_by_year(spark, d):
    return ics(spark, d).groupBy(F.year("date").alias("year")).agg(F.count("ic").alias("n"), econ.t_stat("ic").alias("t"))


@query()
def m16_p_values(spark, d):
    x = ics(spark, d).groupBy(F.year("date").alias("year")).agg(F.count("ic").alias("n"), econ.t_stat("ic").alias("t"))
    p = econ.t_pvalue("t", F.col("n") - 1.0)
    return x.select("year", "n", "t", p.alias("p"), econ.f_pvalue(F.col("t") * F.col("t"), F.lit(1.0), F.col("n") - 1.0).alias("p_f"))


@query(fin(INTRA, "quote_date, quote_time, option_type, mnes", "y", "SELECT * FROM intra"))
def s05_intraday_panel(spark, d):
    return intraday(spark, d)


@query(fin(INTRA, "quote_date, quote_time, option_type, mnes", "z, z_family, y_rank", "SELECT *, (y - avg(y) OVER a) / nullif(stddev_samp(y) OVER a, 0) AS z, (y - avg(y) OVER b) / nullif(stddev_samp(y) OVER b, 0) AS z_family, rank() OVER (PARTITION BY quote_date, quote_time ORDER BY y) + (count(*) OVER (PARTITION BY quote_date, quote_time, y) - 1) / 2.0::DOUBLE AS y_rank FROM intra WINDOW a AS (PARTITION BY quote_date, quote_time), b AS (PARTITION BY quote_date, quote_time, option_type)"))
def w24_cs_zscore(spark, d):
    from tenorlake.functions.nulls import avg_rank

    k = ("quote_date", "quote_time")
    return intraday(spark, d).select(*k, "option_type", "mnes", panel.z_by("y", k).alias("z"), panel.z_by("y", (*k, "option_type")).alias("z_family"), avg_rank("y", k).alias("y_rank"))


@query(fin(INTRA, "quote_date, quote_time, option_type, mnes", "z", "SELECT *, CASE WHEN count(y) OVER w >= 5 THEN (y - avg(y) OVER w) / nullif(stddev_samp(y) OVER w, 0) END AS z FROM intra WINDOW w AS (PARTITION BY option_type, mnes ORDER BY quote_date, quote_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
def w23_timeslot_z(spark, d):
    return intraday(spark, d).select("quote_date", "quote_time", "option_type", "mnes", panel.expanding_z("y", ("option_type", "mnes"), ["quote_date", "quote_time"], 5).alias("z"))


@query(fin(INTRA, "option_type", ", ".join(f"m_{k}" for k in range(8)), "SELECT option_type, " + ", ".join(f"avg(CASE WHEN mnes = '{k}' THEN y END) AS m_{k}" for k in range(8)) + " FROM intra GROUP BY 1"))
def a13_pivot_means(spark, d):
    p = intraday(spark, d).groupBy("option_type").pivot("mnes", [str(k) for k in range(8)]).agg(F.avg("y"))
    return p.select("option_type", *(F.col(str(k)).alias(f"m_{k}") for k in range(8)))


def _intraday_pred(spark, d):
    w = W.partitionBy("option_type", "mnes").orderBy("quote_date", "quote_time")
    return intraday(spark, d).withColumn("y_hat", -F.lag("y").over(w)).where("y_hat is not null")


INTRA_IC = INTRA + (
    ", ip AS (SELECT * FROM (SELECT *, -lag(y) OVER (PARTITION BY option_type, mnes ORDER BY quote_date, quote_time) AS y_hat FROM intra) WHERE y_hat IS NOT NULL), "
    "ir AS (SELECT quote_date, quote_time, rank() OVER (PARTITION BY quote_date, quote_time ORDER BY y_hat) + (count(*) OVER (PARTITION BY quote_date, quote_time, y_hat) - 1) / 2.0 AS a, rank() OVER (PARTITION BY quote_date, quote_time ORDER BY y) + (count(*) OVER (PARTITION BY quote_date, quote_time, y) - 1) / 2.0 AS b FROM ip), "
    "sl AS (SELECT quote_date, quote_time, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS ic FROM ir GROUP BY 1, 2 HAVING count(*) >= 4), "
    "dd AS (SELECT d.quote_date, x.ic FROM (SELECT DISTINCT quote_date FROM ip) d LEFT JOIN (SELECT quote_date, avg(ic) AS ic FROM sl GROUP BY 1) x USING (quote_date))"
)


@query(fin(INTRA_IC, "quote_date", "ic", "SELECT * FROM dd"))
def m21_intraday_ic(spark, d):
    return evaluate.intraday_ic(_intraday_pred(spark, d), "y_hat", "y")


@query(fin(INTRA_IC, "dead_days", "icir, ic_mean", "SELECT count(*) FILTER (ic IS NULL) AS dead_days, avg(coalesce(ic, 0)) / stddev_samp(coalesce(ic, 0)) AS icir, avg(coalesce(ic, 0)) AS ic_mean FROM dd"))
def m22_icir(spark, d):
    return evaluate.icir(evaluate.intraday_ic(_intraday_pred(spark, d), "y_hat", "y"))


@query()
def m23_model_comparison(spark, d):
    x = _intraday_pred(spark, d).withColumn("train", F.dayofmonth("quote_date") <= 12)
    both = x.withColumn("model_id", F.lit("reversal")).unionByName(x.withColumn("model_id", F.lit("momentum")).withColumn("y_hat", -F.col("y_hat")))
    return evaluate.comparison(both, "y_hat", "y", "train")


@query(fin(INTRA, "option_type, mnes", "y_within", "SELECT option_type, mnes, avg(abs(b)) AS y_within FROM (SELECT option_type, mnes, a - avg(a) OVER (PARTITION BY quote_time) AS b FROM (SELECT *, y - avg(y) OVER (PARTITION BY mnes) AS a FROM intra)) GROUP BY 1, 2"))
def a26_within_demean(spark, d):
    x = econ.within(intraday(spark, d), ["y"], ("mnes", "quote_time"))
    return x.groupBy("option_type", "mnes").agg(F.avg(F.abs("y")).alias("y_within"))


IP = INTRA + ", ip AS (SELECT * FROM (SELECT *, -lag(y) OVER (PARTITION BY option_type, mnes ORDER BY quote_date, quote_time) AS y_hat FROM intra) WHERE y_hat IS NOT NULL)"
CLUSTERED = IP + (
    ", w1 AS (SELECT option_type AS g, quote_date, quote_time, y - avg(y) OVER (PARTITION BY option_type, mnes) AS y, y_hat - avg(y_hat) OVER (PARTITION BY option_type, mnes) AS x FROM ip), "
    "w2 AS (SELECT g, quote_date, y - avg(y) OVER (PARTITION BY g, quote_time) AS y, x - avg(x) OVER (PARTITION BY g, quote_time) AS x FROM w1), "
    "sm AS (SELECT g, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM w2 GROUP BY g HAVING count(*) >= 30), "
    "be AS (SELECT *, n * sxx - sx * sx AS det, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b, (sxx * sy - sx * sxy) / (n * sxx - sx * sx) AS a FROM sm), "
    "sc AS (SELECT g, quote_date, sum(u) AS s0, sum(x * u) AS s1, sum(u * u) AS ssr FROM (SELECT w2.g, quote_date, x, y - a - b * x AS u FROM w2 JOIN be ON w2.g = be.g) GROUP BY 1, 2), "
    "me AS (SELECT g, count(*) AS c, sum(s0 * s0) AS m00, sum(s0 * s1) AS m01, sum(s1 * s1) AS m11, sum(ssr) AS ssr FROM sc GROUP BY g), "
    "vv AS (SELECT be.*, c, ssr, c / (c - 1.0) * (n - 1.0) / (n - 2.0) * (sxx * sxx * m00 - 2 * sx * sxx * m01 + sx * sx * m11) / (det * det) AS v0, c / (c - 1.0) * (n - 1.0) / (n - 2.0) * (sx * sx * m00 - 2 * n * sx * m01 + n * CAST(n AS DOUBLE) * m11) / (det * det) AS v1 FROM be JOIN me USING (g))"
)


@query(fin(CLUSTERED, '"group", term, n, clusters', "coef, se, t, r2_adj, wald_f", "SELECT g AS \"group\", term, n, c AS clusters, coef, se, coef / se AS t, 1 - ssr / (n - 2) / ((syy - sy * sy / n) / (n - 1)) AS r2_adj, b * b / v1 AS wald_f FROM (SELECT *, 'const' AS term, a AS coef, sqrt(v0) AS se FROM vv UNION ALL SELECT *, 'y_hat', b, sqrt(v1) FROM vv)"))
def m12_panel_ols_cluster(spark, d):
    return econ.panel_ols(_intraday_pred(spark, d), "y", ["y_hat"], "option_type", ("mnes", "quote_time")).drop("p")


@query()
def m13_event_panel(spark, d):
    x = _intraday_pred(spark, d).withColumn("is_event", (F.dayofmonth("quote_date") % 7 == 0).cast("double")).withColumn("is_late", (F.col("quote_time") >= "12:00").cast("double"))
    return econ.panel_ols(x, "y", ["y_hat", "is_event", "is_late"], "option_type", ("mnes",))


@query()
def m10_factor_hac(spark, d):
    f = _factors(spark, d)["factors"].groupBy("date").pivot("factor", [1, 2]).agg(F.first("value")).select("date", F.col("1").alias("f1"), F.col("2").alias("f2"))
    return econ.hac_ols(returns(spark, d).join(f, "date"), "r", ["f1", "f2"], "tenor", "date")


@query(fin(INTRA + ", q AS (SELECT quantile_cont(y, 1.0 / 3) AS a, quantile_cont(y, 2.0 / 3) AS b FROM intra)", "option_type, regime, n", "mean, se, t", "SELECT option_type, regime, count(y) AS n, avg(y) AS mean, stddev_samp(y) / sqrt(count(y)) AS se, avg(y) / nullif(stddev_samp(y) / sqrt(count(y)), 0) AS t FROM (SELECT *, CASE WHEN y <= a THEN 'low' WHEN y <= b THEN 'mid' ELSE 'high' END AS regime FROM intra, q) GROUP BY 1, 2"))
def x26_regime_grid(spark, d):
    return regimes.grid(intraday(spark, d), ["y"], "y", ("option_type",)).drop("signal")


@query(fin(INTRA, "option_type, n_event, n_other", "mean_event, mean_other, t", "SELECT option_type, count(*) FILTER (e) AS n_event, count(*) FILTER (NOT e) AS n_other, avg(y) FILTER (e) AS mean_event, avg(y) FILTER (NOT e) AS mean_other, (avg(y) FILTER (e) - avg(y) FILTER (NOT e)) / sqrt(var_samp(y) FILTER (e) / count(*) FILTER (e) + var_samp(y) FILTER (NOT e) / count(*) FILTER (NOT e)) AS t FROM (SELECT *, day(quote_date) % 7 = 0 AS e FROM intra) GROUP BY 1 HAVING count(*) FILTER (e) >= 3 AND count(*) FILTER (NOT e) >= 3"))
def a24_event_means(spark, d):
    return regimes.event_means(intraday(spark, d), F.dayofmonth("quote_date") % 7 == 0, "y", ("option_type",))


@query(fin(INTRA, "quote_date, event", "y_lag", "SELECT quote_date, CASE WHEN day(quote_date) % 5 = 0 THEN 'nfp' WHEN day(quote_date) % 3 = 0 THEN 'cpi' WHEN day(quote_date) % 2 = 0 THEN 'fomc' ELSE 'none' END AS event, y_lag FROM (SELECT quote_date, lag(y * 2 - 1) OVER (ORDER BY quote_date) AS y_lag FROM (SELECT quote_date, avg(y) AS y FROM intra GROUP BY 1)) WHERE y_lag IS NOT NULL"))
def x25_conditioning_frame(spark, d):
    x = intraday(spark, d).groupBy("quote_date").agg(F.avg("y").alias("y")).withColumn("one", F.lit(1.0))
    for name, k in (("is_fomc", 2), ("is_cpi", 3), ("is_nfp", 5)):
        x = x.withColumn(name, (F.dayofmonth("quote_date") % k == 0).cast("int"))
    x = x.withColumn("event", regimes.events(x, {"is_fomc": "fomc", "is_cpi": "cpi", "is_nfp": "nfp"}))
    return regimes.lagged_spread(x, "y", "one", 2.0, "quote_date", "y_lag").select("quote_date", "event", "y_lag")


@query(fin(INTRA, "option_type, mnes, n", "mean", "SELECT option_type, mnes, count(*) AS n, avg(y) AS mean FROM intra WHERE (option_type = 'click' AND mnes = '1') OR (option_type = 'view' AND mnes = '2') GROUP BY 1, 2"))
def p13_representative_level(spark, d):
    x = regimes.representative(intraday(spark, d), {"click": "1", "view": "2"})
    return x.groupBy("option_type", "mnes").agg(F.count("*").alias("n"), F.avg("y").alias("mean"))


BARS = "SELECT CAST(date_trunc('hour', ts) + CAST(floor(minute(ts) / 5) AS INTEGER) * INTERVAL 5 MINUTE AS TIMESTAMP) AS bar, event_type, count(*) AS n, sum(value) AS total, avg(value) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2"


@query(fin("", "bar, event_type, n", "total, mean, low, high", BARS))
def w_intraday_bars(spark, d):
    b = bars.bars(tables.table(spark, d, "events", "ts", "event_type", "value"))
    return b.withColumnRenamed("start", "bar").drop("end")


@query(fin(PRED + ", fam AS (SELECT tenor, avg(y_pred * y_true) AS m FROM pred GROUP BY tenor)", "family", "total, pct", f"SELECT {SEG} AS family, sum(m) AS total, 100 * sum(m) / sum(abs(sum(m))) OVER () AS pct FROM fam GROUP BY 1"))
def a28_family_contribution(spark, d):
    imp = predictions(spark, d).select(F.lit("MDA").alias("type"), F.concat(F.lit("t"), "tenor").alias("feature"), (F.col("y_pred") * F.col("y_true")).alias("importance"))
    g = {"front": ["t1", "t2"], "belly": ["t3", "t4", "t5"], "back": ["t6", "t7"]}
    return evaluate.family_contribution(evaluate.importance(imp), g).drop("type")


@query(fin(PRED, "type, feature, rank", "mean, std", "SELECT 'MDI' AS type, 't' || tenor AS feature, CAST(row_number() OVER (ORDER BY avg(abs(y_pred)) DESC, 't' || tenor) AS INTEGER) AS rank, avg(abs(y_pred)) AS mean, stddev_samp(abs(y_pred)) AS std FROM pred GROUP BY tenor"))
def m31_importance(spark, d):
    return evaluate.importance(predictions(spark, d).select(F.lit("MDI").alias("type"), F.concat(F.lit("t"), "tenor").alias("feature"), F.abs("y_pred").alias("importance")))


@query()
def m31_permutation_importance(spark, d):
    x = panel.residual_features(eps(spark, d)).dropna(subset=["eps_lag_1", "eps_vs_curve", "eps"])
    cut = F.col("date") < F.lit("1999-01-01").cast("date")
    return models.permutation_importance(x.where(cut), x.where(~cut), "eps", ["eps_lag_1", "eps_vs_curve"])


@query(fin(EPS, "i, j", "g", "SELECT CAST(a.tenor - 1 AS INTEGER) AS i, CAST(b.tenor - 1 AS INTEGER) AS j, sum(a.r * b.r) AS g FROM ret a JOIN ret b ON a.date = b.date AND a.tenor <= b.tenor GROUP BY 1, 2"))
def m03_gram_matrix(spark, d):
    return factor.gram(factor.vectors(returns(spark, d)), "v", 7)


@query(fin("", "i, j", "g", "SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, sum(CAST(embedding[i + 1] AS DOUBLE) * embedding[j + 1]) AS g FROM embeddings, (SELECT unnest(range(64)) AS i), (SELECT unnest(range(64)) AS j) WHERE i <= j GROUP BY 1, 2"))
def m03_embedding_gram(spark, d):
    return factor.gram(tables.table(spark, d, "embeddings", "embedding").select(F.col("embedding").cast("array<double>").alias("v")), "v", 64)


def _models(spark, d):
    return factor.rolling_models(factor.vectors(returns(spark, d)), 104, 21, 63, 3, 3)


def _factors(spark, d):
    return factor.frames(_models(spark, d))


@query()
def m02_rolling_pca(spark, d):
    return factor.rolling_pca(factor.vectors(returns(spark, d)), 126)


@query()
def m04_rolling_factors(spark, d):
    return _factors(spark, d)["factors"]


@query()
def m04_residuals(spark, d):
    return _factors(spark, d)["residuals"]


@query()
def m04_loadings(spark, d):
    return _factors(spark, d)["loadings"]


@query()
def m04_eigenvalues(spark, d):
    return _factors(spark, d)["eigenvalues"]


@query()
def m04_stability(spark, d):
    return factor.stability(_factors(spark, d)["diagnostics"])


@query()
def m05_scree(spark, d):
    return factor.scree(factor.vectors(returns(spark, d)), 126)


@query()
def m06_factor_counts(spark, d):
    return factor.factor_counts(factor.scree(factor.vectors(returns(spark, d)), 126), 7, 126)


@query(fin(RET + ", full_ AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM ret GROUP BY date HAVING count(*) = 7)", "date, tenor", "total", "SELECT date, tenor, r AS total FROM ret JOIN full_ USING (date) WHERE i > 104"))
def m07_reconstruction(spark, d):
    f = _factors(spark, d)
    return f["fitted"].join(f["residuals"], ["date", "tenor"]).select("date", "tenor", (F.col("fit") + F.col("eps")).alias("total"))


@query()
def m07_reconstruction_error(spark, d):
    return factor.reconstruction_error(_models(spark, d))


@query()
def m08_shock_profile(spark, d):
    return factor.shock_profile(_factors(spark, d))


@query()
def m09_spec_grid(spark, d):
    return factor.spec_grid(factor.vectors(returns(spark, d)), 7)


@query()
def a32_fit_quality(spark, d):
    return factor.fit_quality(_models(spark, d))


def _weights(spark, d, **kw):
    p = portfolio.Portfolio(top_k=2, bottom_k=2, max_abs=0.5, exclude=(1,), n_factors=2, **kw)
    load = _factors(spark, d)["loadings"].select("date", "tenor", "factor", "loading")
    return p.panel(predictions(spark, d).select("date", "tenor", "y_pred"), load)


@query()
def x17_portfolio_weights(spark, d):
    return _weights(spark, d)


@query()
def x17_smoothed_weights(spark, d):
    return _weights(spark, d, smoothing=0.5)


@query()
def m18_random_forest(spark, d):
    x = panel.residual_features(eps(spark, d)).dropna()
    cut = F.col("date") < F.lit("2000-01-01").cast("date")
    return models.fit_predict(x.where(cut), x.where(~cut), "eps", ["eps_lag_1", "eps_rolling_mean_5", "eps_curve_std"], "RandomForest", {"numTrees": 10, "maxDepth": 4}).select("date", "tenor", "y_hat")


RIDGE = EPS + ", z AS (SELECT * FROM (SELECT date, tenor, eps AS y, lag(eps) OVER (PARTITION BY tenor ORDER BY date) AS x FROM eps) WHERE x IS NOT NULL)"


@query(fin(RIDGE + ", b AS (SELECT covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + 1) AS b, avg(x) AS mx, avg(y) AS my FROM z)", "date, tenor", "y_hat", "SELECT date, tenor, my + b * (x - mx) AS y_hat FROM z, b"))
def m17_ridge(spark, d):
    w = W.partitionBy("tenor").orderBy("date")
    z = eps(spark, d).select("date", "tenor", F.col("eps").alias("y"), F.lag("eps").over(w).alias("x")).where("x is not null")
    return models.fit_predict(z, z, "y", ["x"]).select("date", "tenor", "y_hat")


@query(fin("", "T, m, tau_fast, tau_slow", "", "SELECT CAST(a AS BIGINT) AS T, CAST(b AS BIGINT) AS m, CAST(c AS BIGINT) AS tau_fast, CAST(e AS BIGINT) AS tau_slow FROM (SELECT unnest([126, 252, 504]) AS a), (SELECT unnest([3, 4]) AS b), (SELECT unnest([15, 21]) AS c), (SELECT unnest([126, 252]) AS e) WHERE c < e AND e <= a"))
def j18_parameter_grid(spark, d):
    from tenorlake.operators import joins

    return joins.grid(spark, {"T": [126, 252, 504], "m": [3, 4], "tau_fast": [15, 21], "tau_slow": [126, 252]}, "tau_fast < tau_slow and tau_slow <= T")


FEATS = "ft AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)"


@query(fin(FEATS, "name_a, name_b", "corr", " UNION ALL ".join(f"SELECT '{a}' AS name_a, '{b}' AS name_b, corr({a}, {b}) AS corr FROM ft" for a, b in (("l_discount", "l_extendedprice"), ("l_discount", "l_quantity"), ("l_discount", "l_tax"), ("l_extendedprice", "l_quantity"), ("l_extendedprice", "l_tax"), ("l_quantity", "l_tax")))))
def j19_feature_correlations(spark, d):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return audit.correlations(tables.table(spark, d, "lineitem", *names), names)


HIGH = RET + ", cc AS (SELECT a.tenor AS a, b.tenor AS b, corr(a.r, b.r) AS c FROM ret a JOIN ret b ON a.date = b.date AND a.tenor < b.tenor GROUP BY 1, 2)"


@query(fin(HIGH, "feature, n", "", "SELECT CAST(f AS VARCHAR) AS feature, count(*) AS n FROM (SELECT unnest([a, b]) AS f FROM cc WHERE abs(c) >= 0.05) GROUP BY 1"))
def a29_high_correlations(spark, d):
    high = audit.high_pairs(audit.tenor_correlations(returns(spark, d), "r"), 0.05)
    return high.select(F.col("feature").cast("string").alias("feature"), "n")
