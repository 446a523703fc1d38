"""Queries on the daily series: weather, storage, joins by time, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenorlake.functions import dates
from tenorlake.operators import audit, joins, splits, weather
from tenorlake.plans.registry import ANN, DAILY, STOCK, fin, query
from tenorlake.sources import tables


def daily(spark, d):
    return tables.daily_series(spark, d)


def stock(spark, d):
    return tables.weekly_stock(spark, d)


@query(fin(DAILY, "date", "HDD, CDD", "SELECT * FROM daily"))
def s04_daily_series(spark, d):
    return daily(spark, d)


@query(fin(STOCK, "date", "Storage", "SELECT * FROM stock"))
def s04_weekly_stock(spark, d):
    return stock(spark, d)


@query(fin(DAILY + ", " + STOCK, "date", "HDD, CDD, Storage", "SELECT coalesce(a.date, b.date) AS date, HDD, CDD, Storage FROM daily a FULL JOIN stock b ON a.date = b.date"))
def j02_weather_storage(spark, d):
    return daily(spark, d).join(stock(spark, d), "date", "full")


BASE = DAILY + ", " + ", ".join(
    [
        "ch AS (SELECT *, HDD - lag(HDD) OVER (ORDER BY date) AS dh, CDD - lag(CDD) OVER (ORDER BY date) AS dc FROM daily)",
        "base AS (SELECT date, HDD, CDD, HDD * HDD AS HDD2, CDD * CDD AS CDD2, " + ", ".join(f"CASE WHEN {v} IS NOT NULL THEN greatest({s}{v}, 0) END AS {n}_{k}" for n, v in (("HDD", "dh"), ("CDD", "dc")) for k, s in (("inc", ""), ("dec", "-"))) + " FROM ch)",
    ]
)


@query(fin(BASE, "date", "HDD, CDD, HDD2, CDD2, HDD_inc, HDD_dec, CDD_inc, CDD_dec", "SELECT * FROM base"))
def x06_weather_base(spark, d):
    return weather.base(daily(spark, d))


@query(fin(DAILY, "date", "HDD, CDD, HDD2, CDD2", "SELECT date, lag(HDD) OVER (ORDER BY date) AS HDD, lag(CDD) OVER (ORDER BY date) AS CDD, lag(HDD) OVER (ORDER BY date) ** 2 AS HDD2, lag(CDD) OVER (ORDER BY date) ** 2 AS CDD2 FROM daily"))
def x06_weather_base_lagged(spark, d):
    return weather.base(daily(spark, d), lag=True).select("date", "HDD", "CDD", "HDD2", "CDD2")


_ROLL = (("sum_5d", "sum", 5, 3), ("mean_5d", "avg", 5, 3), ("var_5d", "var_samp", 5, 2), ("sum_10d", "sum", 10, 5), ("var_10d", "var_samp", 10, 5))


@query(
    fin(
        DAILY,
        "date",
        "HDD, CDD, " + ", ".join(f"{c}_{n}" for c in ("HDD", "CDD") for n, *_ in _ROLL),
        "SELECT date, HDD, CDD, " + ", ".join(f"CASE WHEN count({c}) OVER w{w} >= {k} THEN {f}({c}) OVER w{w} END AS {c}_{n}" for c in ("HDD", "CDD") for n, f, w, k in _ROLL) + " FROM daily WINDOW w5 AS (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), w10 AS (ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)",
    )
)
def x07_weather_rolling(spark, d):
    return weather.rolling_features(daily(spark, d))


@query(
    fin(
        DAILY,
        "date",
        "HDD, HDD_normal_4y_pm3d, HDD_anom_normal",
        "SELECT a.date, a.HDD, CASE WHEN count(b.HDD) >= 5 THEN avg(b.HDD) END AS HDD_normal_4y_pm3d, a.HDD - CASE WHEN count(b.HDD) >= 5 THEN avg(b.HDD) END AS HDD_anom_normal FROM daily a LEFT JOIN daily b ON year(b.date) BETWEEN year(a.date) - 4 AND year(a.date) - 1 AND least(abs(dayofyear(a.date) - dayofyear(b.date)), 365 - abs(dayofyear(a.date) - dayofyear(b.date))) <= 3 GROUP BY a.date, a.HDD",
    )
)
def x08_climate_normals(spark, d):
    return weather.normals(daily(spark, d), ("HDD", "absent"), least=5).select("date", "HDD", "HDD_normal_4y_pm3d", "HDD_anom_normal")


@query(fin(ANN, "ann_date, ann_prev, CAST(window_days AS INTEGER) AS window_days", "storage_bcf, delta_storage_bcf", "SELECT * FROM ann"))
def x11_announcements(spark, d):
    return weather.announcements(stock(spark, d))


@query(fin(BASE + ", " + ANN, "ann_date", ", ".join(f"{c}_storage_window, {c}_var_storage_window" for c in ("HDD", "HDD2", "CDD", "CDD2")), "SELECT ann_date, " + ", ".join(f"coalesce(sum({c}), 0) AS {c}_storage_window, var_samp({c}) AS {c}_var_storage_window" for c in ("HDD", "HDD2", "CDD", "CDD2")) + " FROM ann LEFT JOIN base ON base.date > ann_prev AND base.date <= ann_date GROUP BY ann_date"))
def x12_storage_window(spark, d):
    w = weather.storage_windows(weather.base(daily(spark, d)), weather.announcements(stock(spark, d)))
    return w.select("ann_date", *(n for n in w.columns if n.endswith("storage_window")))


_BD = "CASE WHEN isodow({d}) <= 5 THEN 5 * CAST(floor(({d} - DATE '1970-01-05') / 7) AS BIGINT) + isodow({d}) - 1 END"
TO_DAILY = ANN + (
    f", j0 AS (SELECT d.date, a.ann_date IS NOT NULL AS hit, a.delta_storage_bcf AS dl, {_BD.format(d='a.ann_date')} AS ab FROM stock d LEFT JOIN ann a ON a.ann_date = d.date), "
    "j1 AS (SELECT date, CAST(hit AS INTEGER) AS is_storage_announcement_day, last_value(dl IGNORE NULLS) OVER w AS DeltaStorage_last, last_value(ab IGNORE NULLS) OVER w AS ab FROM j0 WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), "
    f"j2 AS (SELECT *, CAST({_BD.format(d='date')} - ab AS DOUBLE) AS days_since_storage_announcement FROM j1)"
)


@query(fin(TO_DAILY, "date, is_storage_announcement_day", "DeltaStorage_last, days_since_storage_announcement, D_storage_0, D_storage_1, D_storage_2, D_storage_3, D_storage_4plus", "SELECT *, " + ", ".join(f"CAST(coalesce(days_since_storage_announcement = {i}, false) AS DOUBLE) AS D_storage_{i}" for i in range(4)) + ", CAST(coalesce(days_since_storage_announcement >= 4, false) AS DOUBLE) AS D_storage_4plus FROM j2"))
def x14_storage_daily_merge(spark, d):
    out = weather.to_daily(stock(spark, d), weather.announcements(stock(spark, d)))
    return out.select("date", "is_storage_announcement_day", "DeltaStorage_last", "days_since_storage_announcement", *(n for n in out.columns if n.startswith("D_storage")))


@query()
def x09_weather_surprises(spark, d):
    base = weather.normals(daily(spark, d), ("HDD",), least=5)
    return weather.surprises(base, ("HDD",), train=200, window=400).select("date", "HDD", "E_HDD", "U_HDD", "Z_HDD")


@query()
def x10_weather_shocks(spark, d):
    base = weather.normals(daily(spark, d), ("HDD",), least=5)
    return weather.shocks(base, ("HDD",), train=200, window=400).select("date", "WHDD_5d", "WHDD2_5d")


@query()
def x13_storage_surprises(spark, d):
    ann = weather.storage_windows(weather.base(daily(spark, d)), weather.announcements(stock(spark, d)))
    return weather.storage_surprises(ann, train=60).select("ann_date", "StorageChange_normal", "E_DeltaStorage", "U_DeltaStorage", "Z_DeltaStorage")


@query()
def x15_fundamental_features(spark, d):
    out, _ = weather.fundamental(daily(spark, d), stock(spark, d), train=200, storage_train=60)
    return out.select("date", *weather.FAMILY_B)


@query(fin(DAILY, "date, month, year, doy, day, season", "sin1, cos1, sin2, cos2", "SELECT date, CAST(month(date) AS INTEGER) AS month, CAST(year(date) AS INTEGER) AS year, CAST(dayofyear(date) AS INTEGER) AS doy, dayname(date) AS day, CASE WHEN month(date) BETWEEN 4 AND 10 THEN 'Apr-Oct' ELSE 'Nov-Mar' END AS season, " + ", ".join(f"{f}(2 * pi() * {k} * dayofyear(date) / 365.25) AS {f}{k}" for k in (1, 2) for f in ("sin", "cos")) + " FROM daily"))
def f02_calendar_features(spark, d):
    x = daily(spark, d)
    return x.select("date", F.month("date").alias("month"), F.year("date").alias("year"), F.dayofyear("date").alias("doy"), F.date_format("date", "EEEE").alias("day"), dates.season("date").alias("season"), *(v.alias(k) for k, v in dates.fourier("date").items()))


@query(fin("", "date", "", "SELECT CAST(d AS DATE) AS date FROM generate_series(DATE '1997-01-01', DATE '1997-12-31', INTERVAL 1 DAY) t(d) WHERE isodow(d) <= 5"))
def s09_business_days(spark, d):
    return dates.business_days(spark, "1997-01-01", "1997-12-31")


EVENTS = "ev AS (SELECT unnest([DATE '1996-02-29', DATE '1997-07-04', DATE '1999-12-25', DATE '2003-01-01']) AS event_date)"


def _events(spark):
    return spark.createDataFrame([("1996-02-29",), ("1997-07-04",), ("1999-12-25",), ("2003-01-01",)], "e string").select(F.to_date("e").alias("event_date"))


@query(fin(DAILY + ", " + EVENTS, "event_date, nearest", "", "SELECT event_date, date AS nearest FROM (SELECT event_date, date, row_number() OVER (PARTITION BY event_date ORDER BY abs(date - event_date), date) AS k FROM ev, daily WHERE extract('day' FROM date) < 25) WHERE k = 1"))
def j10_nearest_event(spark, d):
    return joins.nearest(_events(spark), daily(spark, d).where(F.dayofmonth("date") < 25))


@query(fin(DAILY + ", " + EVENTS, "event_date, found", "HDD", "SELECT event_date, daily.date IS NOT NULL AS found, HDD FROM ev LEFT JOIN daily ON daily.date = event_date"))
def j20_exact_date(spark, d):
    hit, miss = joins.exact(_events(spark), daily(spark, d))
    return hit.select("event_date", F.lit(True).alias("found"), "HDD").unionByName(miss.select("event_date", F.lit(False).alias("found"), F.lit(None).cast("double").alias("HDD")))


@query(fin(DAILY + ", " + ANN, "date", "last_delta", "SELECT date, (SELECT arg_max(delta_storage_bcf, ann_date) FROM ann WHERE ann_date <= date) AS last_delta FROM daily"))
def j09_asof_backward(spark, d):
    ann = weather.announcements(stock(spark, d)).select(F.col("ann_date").alias("date"), F.col("delta_storage_bcf").alias("last_delta"))
    return joins.asof(daily(spark, d).select("date"), ann, "date", ["last_delta"])


@query(fin(DAILY + ", " + ANN, "date", "next_delta", "SELECT date, (SELECT arg_min(delta_storage_bcf, ann_date) FROM ann WHERE ann_date >= date) AS next_delta FROM daily"))
def j11_asof_forward(spark, d):
    ann = weather.announcements(stock(spark, d)).select(F.col("ann_date").alias("date"), F.col("delta_storage_bcf").alias("next_delta"))
    return joins.asof(daily(spark, d).select("date"), ann, "date", ["next_delta"], forward=True)


@query(fin(DAILY + ", " + EVENTS + ", pl AS (SELECT date, HDD, row_number() OVER (ORDER BY date) - 1 AS rn, count(*) OVER () AS n FROM daily), pt AS (SELECT event_date, greatest(15, least(coalesce((SELECT min(rn) FROM pl WHERE date >= event_date), (SELECT max(n) FROM pl)), (SELECT max(n) FROM pl) - 16)) AS place FROM ev)", "event_date, date, CAST(pos AS INTEGER) AS pos", "HDD", "SELECT event_date, date, rn - place AS pos, HDD FROM pt JOIN pl ON rn BETWEEN place - 15 AND place + 15"))
def x28_event_windows(spark, d):
    return joins.around(_events(spark), daily(spark, d), 15).select("event_date", "date", F.col("offset").alias("pos"), "HDD")


@query(fin(DAILY + ", " + ANN, "ann_date, n", "total", "SELECT ann_date, count(*) AS n, sum(HDD) AS total FROM ann JOIN daily ON date > ann_prev AND date <= ann_date GROUP BY 1"))
def j08_interval_join(spark, d):
    ann = weather.announcements(stock(spark, d)).select("ann_date", "ann_prev")
    return joins.interval(ann, daily(spark, d), "ann_prev", "ann_date").groupBy("ann_date").agg(F.count("*").alias("n"), F.sum("HDD").alias("total"))


@query(fin(DAILY + ", " + ANN, "date", "HDD", "SELECT date, HDD FROM daily WHERE date NOT IN (SELECT ann_date FROM ann)"))
def j17_anti_announcements(spark, d):
    ann = weather.announcements(stock(spark, d))
    return daily(spark, d).select("date", "HDD").join(ann, F.col("date") == F.col("ann_date"), "left_anti")


SPLITS = DAILY + ", o AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM daily)"


@query(fin(SPLITS, "test_date, train_start, train_end, purge_date, CAST(252 AS INTEGER) AS n_train_days, is_refit, stage", "", "SELECT a.date AS test_date, b.date AS train_start, c.date AS train_end, e.date AS purge_date, (a.t - 253) % 21 = 0 AS is_refit, CASE WHEN a.date >= DATE '2000-01-01' THEN 'S2' ELSE 'S1' END AS stage FROM o a JOIN o b ON b.t = a.t - 253 JOIN o c ON c.t = a.t - 2 JOIN o e ON e.t = a.t - 1 WHERE a.t >= 253"))
def x20_wf_splits(spark, d):
    return splits.daily_splits(daily(spark, d), stage2="2000-01-01")


@query(fin(SPLITS, "split, train_start, train_end, val_start, val_end, stage", "", "SELECT CAST(k + 1 AS INTEGER) AS split, b.date AS train_start, c.date AS train_end, e.date AS val_start, f.date AS val_end, CASE WHEN f.date <= DATE '1999-12-31' THEN 'S1' ELSE 'S2' END AS stage FROM (SELECT unnest(generate_series(0, (SELECT (count(*) - 825) // 63 FROM o))) AS k) JOIN o b ON b.t = 63 * k JOIN o c ON c.t = 63 * k + 755 JOIN o e ON e.t = 63 * k + 762 JOIN o f ON f.t = 63 * k + 824"))
def x21_purged_cv(spark, d):
    return splits.block_splits(daily(spark, d), insample_end="1999-12-31")


@query(fin(SPLITS + ", te AS (SELECT date, t, (t - 253) // 21 AS c FROM o WHERE t >= 253), cy AS (SELECT c, min(date) AS refit_date, max(date) AS last_date, count(*) AS test_days FROM te GROUP BY c)", "refit_date, next_refit, last_date, test_days, train_rows, prediction_rows, stage", "", "SELECT refit_date, lead(refit_date) OVER (ORDER BY refit_date) AS next_refit, last_date, test_days, CAST(252 * 64 AS INTEGER) AS train_rows, test_days * 64 AS prediction_rows, 'S1' AS stage FROM cy"))
def v02_refit_cycles(spark, d):
    return splits.refit_cycles(splits.daily_splits(daily(spark, d)), 64)


@query(
    fin(
        SPLITS + ", sp AS (SELECT CAST(k + 1 AS INTEGER) AS split, 63 * k AS a FROM (SELECT unnest(generate_series(0, (SELECT (count(*) - 825) // 63 FROM o))) AS k)), v AS (SELECT o.t, daily.* FROM daily JOIN o USING (date)), bd AS (SELECT split, quantile_cont(HDD, 0.01) AS lo, quantile_cont(HDD, 0.99) AS hi FROM sp JOIN v ON t BETWEEN a AND a + 755 GROUP BY 1), mo AS (SELECT split, avg(least(greatest(HDD, lo), hi)) AS m, stddev_samp(least(greatest(HDD, lo), hi)) AS s FROM sp JOIN v ON t BETWEEN a AND a + 755 JOIN bd USING (split) GROUP BY 1)",
        "split, date",
        "HDD",
        "SELECT split, date, (least(greatest(HDD, lo), hi) - m) / nullif(s, 0) AS HDD FROM sp JOIN v ON t BETWEEN a + 762 AND a + 824 JOIN bd USING (split) JOIN mo USING (split)",
    )
)
def x22_winsor_train_window(spark, d):
    x = daily(spark, d)
    return splits.preprocess(x.select("date", "HDD"), splits.block_splits(x), ["HDD"])


@query(fin(DAILY, "feature, n, n_values, is_binary", "mean, std, min, max, nan_pct, positive_pct", "SELECT feature, count(v) AS n, count(DISTINCT v) AS n_values, coalesce(count(DISTINCT v) <= 2 AND min(v) >= 0 AND max(v) <= 1, false) AS is_binary, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max, 100 * avg(CAST(v IS NULL AS INTEGER)) AS nan_pct, 100 * avg(CASE WHEN v IS NOT NULL THEN CAST(v > 0 AS INTEGER) END) AS positive_pct FROM (SELECT 'HDD' AS feature, HDD AS v FROM daily UNION ALL SELECT 'CDD', CASE WHEN CDD > 5 THEN CDD END FROM daily UNION ALL SELECT 'is_friday', CAST(isodow(date) = 5 AS DOUBLE) FROM daily) GROUP BY feature"))
def a10_column_profile(spark, d):
    return audit.profile(_features(spark, d), ["HDD", "CDD", "is_friday"]).drop("skew", "kurtosis")


def _features(spark, d):
    return daily(spark, d).select("date", "HDD", F.when(F.col("CDD") > 5, F.col("CDD")).alias("CDD"), (F.weekday("date") == 4).cast("double").alias("is_friday"))


@query(fin(DAILY, "complete, partial, empty", "", "SELECT 2::BIGINT AS complete, 1::BIGINT AS partial, 0::BIGINT AS empty"))
def a09_missing_buckets(spark, d):
    return audit.missing_buckets(audit.profile(_features(spark, d), ["HDD", "CDD", "is_friday"]))


@query(fin(DAILY, "feature, n_pos, n_neg, imbalanced", "ratio", "SELECT feature, count(*) FILTER (v > 0) AS n_pos, count(*) FILTER (v <= 0) AS n_neg, greatest(count(*) FILTER (v > 0), count(*) FILTER (v <= 0)) / greatest(least(count(*) FILTER (v > 0), count(*) FILTER (v <= 0)), 1) AS ratio, abs(100.0::DOUBLE * count(*) FILTER (v > 0) / count(*) - 50) > 10 AS imbalanced FROM (SELECT 'HDD' AS feature, HDD AS v FROM daily UNION ALL SELECT 'is_friday', CAST(isodow(date) = 5 AS DOUBLE) FROM daily) GROUP BY feature"))
def a11_class_balance(spark, d):
    return audit.balance(_features(spark, d), ["HDD", "is_friday"])


@query(fin(DAILY, "feature, value", "share", "SELECT feature, value, count(*) / sum(count(*)) OVER (PARTITION BY feature) AS share FROM (SELECT 'month' AS feature, CAST(month(date) AS INTEGER) AS value FROM daily) GROUP BY feature, value"))
def a04_value_counts(spark, d):
    from pyspark.sql.window import Window as W

    g = daily(spark, d).groupBy(F.lit("month").alias("feature"), F.month("date").alias("value")).count()
    return g.select("feature", "value", (F.col("count") / F.sum("count").over(W.partitionBy("feature"))).alias("share"))


@query(fin("", "weight_age", "weight", "SELECT k AS weight_age, 252 * exp(-k / 21) / sum(exp(-k / 21)) OVER () AS weight FROM (SELECT unnest(generate_series(0, 251)) AS k)"))
def m01_time_weights(spark, d):
    from tenorlake.operators import factor

    return factor.weights_table(spark, 252, 21).withColumnRenamed("age", "weight_age")


@query(fin("", "family, n_present, n_missing, missing", "", "SELECT 'base' AS family, 4::INTEGER AS n_present, 0::INTEGER AS n_missing, []::VARCHAR[] AS missing UNION ALL SELECT 'storage', 0, 2, ['Storage', 'DeltaStorage_last']"))
def x24_feature_registry(spark, d):
    return audit.registry(spark, weather.base(daily(spark, d)).columns, {"base": ["HDD", "CDD", "HDD2", "CDD2"], "storage": ["Storage", "DeltaStorage_last"]})


@query(fin(DAILY, "rows, first_date, last_date, dates", "", "SELECT count(*) AS rows, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS dates FROM daily"))
def s12_summary(spark, d):
    return tables.summary(daily(spark, d), "date")


@query(fin(DAILY, "bucket, n", "mean", "SELECT CASE WHEN k <= 5 THEN 'D+' || k ELSE 'D+6+' END AS bucket, count(*) AS n, avg(HDD) AS mean FROM (SELECT least((row_number() OVER (ORDER BY date) - 1) % 9, 7) AS k, HDD FROM daily) GROUP BY 1"))
def f13_day_bucket(spark, d):
    from pyspark.sql.window import Window as W

    x = daily(spark, d).select(F.least((F.row_number().over(W.orderBy("date")) - 1) % 9, F.lit(7)).alias("k"), "HDD")
    return x.groupBy(dates.day_bucket("k").alias("bucket")).agg(F.count("*").alias("n"), F.avg("HDD").alias("mean"))
