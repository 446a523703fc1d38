"""Properties and hand-checked values of the panel operators."""

from __future__ import annotations

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenorlake.functions import dates, nulls
from tenorlake.operators import audit, clean, econ, evaluate, factor, joins, models, panel, portfolio, regimes, ridge, splits, weather
from tenorlake.sources import tables
from tenorlake.streaming import bars

DAY = dt.date(2020, 1, 1)


def day(i):
    return DAY + dt.timedelta(days=i)


def series(spark, values, name="x"):
    return spark.createDataFrame([(day(i), 1, v) for i, v in enumerate(values)], f"date date, tenor int, {name} double")


# --- scalars


def test_null_rules(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 2.0), (float("nan"), 2.0), (4.0, 2.0)], "a double, b double")
    out = df.select(nulls.div(nulls.clean("a"), "b").alias("d"), nulls.clip(nulls.clean("a"), 2, 3).alias("c"), nulls.finite("a").alias("f"), nulls.is_close("a", "b").alias("k"), nulls.flag(F.col("a") > 2).alias("g")).collect()
    assert [r.d for r in out] == [None, None, None, 2.0]
    assert [r.c for r in out] == [2.0, None, None, 3.0]
    assert [r.f for r in out] == [True, False, False, True]
    assert out[1].g == 0.0 and not out[1].k


def test_ranks_and_bins(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([3.0, 1.0, 3.0, None, 2.0])], "i int, v double")
    assert [r[0] for r in df.select("i", nulls.avg_rank("v", ()).alias("r")).orderBy("i").select("r").collect()] == [3.5, 1.0, 3.5, None, 2.0]
    for n in (3, 4, 9, 23):
        for q in (4, 5):
            got = [r[0] for r in spark.range(n).select(F.col("id").cast("double").alias("v"), "id").select("v", nulls.safe_bin("v", q, [], ["id"]).alias("b")).orderBy("v").select("b").collect()]
            want = [None] * n if n < q else [max(1, math.ceil(i * q / (n - 1))) for i in range(n)]
            assert got == want
    const = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert const.agg(nulls.corr("a", "b")).head()[0] is None


def test_roll_dates(spark):
    months = spark.createDataFrame([(f"2020-{m:02d}-01",) for m in range(1, 13)], "m string").select(F.to_date("m").alias("m"))
    for m, r in months.select("m", dates.roll_date("m")).collect():
        d, k = m, 2
        while k:
            d -= dt.timedelta(days=1)
            k -= d.weekday() < 5
        assert r == d
    assert {r[0] for r in months.select(dates.roll_date("m")).collect()} >= {dt.date(2020, 3, 30), dt.date(2020, 5, 28), dt.date(2020, 6, 29)}


def test_business_days(spark):
    d = dates.business_days(spark, "2022-04-04", "2026-05-30")
    s = splits.daily_splits(d)
    assert d.count() == 1085 and s.count() == 832 and s.where("is_refit").count() == 40
    assert s.agg(F.min("test_date")).head()[0] == dt.date(2023, 3, 23)
    o = {r[0]: r[1] for r in spark.range(30).select(F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("d")).select("d", dates.business_ordinal("d")).collect()}
    days = [x for x in sorted(o) if x.weekday() < 5]
    assert [o[x] - o[days[0]] for x in days] == list(range(len(days))) and all(o[x] is None for x in o if x.weekday() >= 5)


# --- cleaning


def test_dq_and_outliers(spark):
    rng = np.random.default_rng(1)
    r = rng.normal(size=(200, 3)) * 0.01
    r[150, 1] = 0.9  # alone
    r[170] = [0.5, 0.6, 0.5]  # together
    rows = [(day(i), t + 1, float(r[i, t])) for i in range(200) for t in range(3)]
    ret = spark.createDataFrame(rows, "date date, tenor int, r double")
    rep = clean.review(clean.outlier_report(ret, lookback=100, min_periods=50))
    got = {(x.date, x.tenor): x for x in rep.collect()}
    assert set(got) == {(day(150), 2), (day(170), 1), (day(170), 2), (day(170), 3)}
    assert got[day(150), 2].final_action == "winsorize" and got[day(170), 2].final_action == "keep"
    out, log = clean.winsorize(ret, rep)
    fixed = {(x.date, x.tenor): x.r for x in out.collect()}
    assert 0 < fixed[day(150), 2] < 0.2 and fixed[day(170), 2] == 0.6 and log.count() == 4
    with pytest.raises(Exception, match="unknown action"):
        clean.winsorize(ret, rep.withColumn("final_action", F.lit("burn")))[0].collect()
    prices = spark.createDataFrame([(day(0), 1, 5.0), (day(1), 1, 5.0), (day(1), 1, 6.0), (day(2), 1, -1.0)], "date date, tenor int, price double")
    q = clean.dq_report(prices).head()
    assert (q.n_dup_dates, q.n_stale, q.n_zero_neg, q.n_extreme_ret) == (1, 1, 1, 1)


def test_roll_adjustment_counts(spark):
    rows = [(day(i), t, 10.0 + i + t) for i in range(90) for t in range(1, 5)]
    p = spark.createDataFrame(rows, "date date, tenor int, price double")
    rolls = clean.roll_days(p)
    out = clean.roll_adjust(p, rolls)
    n = rolls.join(p.select("date").distinct(), "date").count()
    assert out.where("is_roll").count() == 3 * n and out.agg(F.max("tenor")).head()[0] == 3
    x = out.where("is_roll").head()
    i = (x.date - DAY).days
    assert x.r == pytest.approx(math.log((10 + i + x.tenor) / (10 + i - 1 + x.tenor + 1)))


# --- no look-ahead: cutting the input after t doesn't change row t


@pytest.mark.parametrize(
    "op",
    [
        panel.residual_features,
        lambda e: clean.outlier_scores(e.withColumnRenamed("eps", "r"), lookback=20, min_periods=5),
        lambda e: panel.ewm(e, "eps", 0.2, ("tenor",)),
        lambda e: panel.drawdown(e, "eps", ("tenor",), "date"),
        lambda e: panel.overlap(e.withColumnRenamed("eps", "weight")),
    ],
)
def test_no_lookahead(spark, op):
    rng = np.random.default_rng(2)
    e = spark.createDataFrame([(day(i), t, float(rng.normal())) for i in range(90) for t in range(1, 4)], "date date, tenor int, eps double")
    cut = F.col("date") <= day(70)
    key = lambda df: sorted(map(str, df.where(F.col("date") == day(70)).collect()))
    assert key(op(e)) == key(op(e.where(cut)))


def test_ewm_of_long_series(spark):
    rng = np.random.default_rng(3)
    v = [None if i % 7 == 3 else float(rng.normal()) for i in range(1500)]
    for alpha in (0.01, 0.5, 0.9):
        got = [r.ewm for r in panel.ewm(series(spark, v), "x", alpha, ("tenor",)).orderBy("date").collect()]
        num = den = 0.0
        for x, g in zip(v, got, strict=True):
            num, den = num * (1 - alpha), den * (1 - alpha)
            if x is not None:
                num, den = num + x, den + 1
            assert g == pytest.approx(num / den, rel=1e-9, abs=1e-12)


# --- factor model


def test_two_stage_equals_svd():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 6)) @ rng.normal(size=(6, 6)) * 0.01
    s = factor.two_stage(x, 21, 63, 3, 2)
    w = factor.time_weights(120, 21)
    assert w.sum() == pytest.approx(120)
    a = x.T * np.sqrt(w)
    u, d, v = np.linalg.svd(a, full_matrices=False)
    sigma = np.sqrt(np.mean((a - (u[:, :3] * d[:3]) @ v[:3]) ** 2, axis=1))
    assert np.allclose(s["sigma"], sigma, rtol=1e-9)
    u, d, _ = np.linalg.svd(x.T / sigma[:, None] * np.sqrt(factor.time_weights(120, 63)), full_matrices=False)
    assert np.allclose(s["lambda_raw"], d**2 / 120)
    b = sigma[:, None] * u[:, :2]
    assert np.allclose(s["loadings"] @ s["loadings"].T, b @ b.T)


def test_rolling_models(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 5)) @ rng.normal(size=(5, 5))
    ret = spark.createDataFrame([(day(i), t + 1, float(x[i, t])) for i in range(150) for t in range(5)], "date date, tenor int, r double")
    m = factor.rolling_models(factor.vectors(ret), 40, 10, 20, 2, 2)
    rows = {r.date: r for r in m.collect()}
    assert len(rows) == 110
    before = None
    for i in range(40, 150):
        s, r = factor.two_stage(x[i - 40 : i], 10, 20, 2, 2), rows[day(i)]
        b = s["loadings"]
        f = (b / s["sigma"][:, None] ** 2).T @ x[i]
        if before is not None:
            flip = np.where((b * before).sum(0) < 0, -1.0, 1.0)
            b, f = b * flip, f * flip
        before = b
        assert np.allclose(np.array(r.b).T, b) and np.allclose(r.f, f) and np.allclose(np.array(r.fitted) + np.array(r.residual), x[i], atol=1e-12)
    assert factor.reconstruction_error(m).head()[0] < 1e-12
    g = factor.gram(factor.vectors(ret), "v", 5).collect()
    assert all(r.g == pytest.approx((x.T @ x)[r.i, r.j]) for r in g) and len(g) == 15


# --- weather


def test_walk_forward_ridge(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=90) * 0.1
    y[50] = np.nan
    df = spark.createDataFrame([(day(i), i, x[i].tolist(), None if math.isnan(y[i]) else float(y[i])) for i in range(90)], "date date, t int, x array<double>, y double")
    got = [r.y_hat for r in ridge.walk_forward(df, 30, 10, 40).orderBy("date").collect()]
    fit = None
    for t in range(90):
        if t >= 30 and (fit is None or t - last >= 10):
            a, b = x[max(0, t - 40) : t], y[max(0, t - 40) : t]
            ok = np.isfinite(b)
            xc = a[ok] - a[ok].mean(0)
            beta = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ (b[ok] - b[ok].mean()))
            fit, last = (beta, b[ok].mean() - a[ok].mean(0) @ beta), t
        if fit is None or math.isnan(y[t]):
            assert got[t] is None
        else:
            assert got[t] == pytest.approx(float(x[t] @ fit[0] + fit[1]))


def test_fundamental_registry(spark):
    n = 420
    w = spark.createDataFrame([(day(i), 10 + 8 * math.sin(i / 58) + i % 5, max(0.0, 5.0 - i % 9)) for i in range(n)], "date date, HDD double, CDD double")
    level, rows = 100.0, []
    for i in range(n):
        level += (i % 11 - 5) if day(i).weekday() == 3 else 0
        rows.append((day(i), level))
    out, ann = weather.fundamental(w, spark.createDataFrame(rows, "date date, Storage double"), train=120, storage_train=20)
    assert set(weather.FAMILY_B) <= set(out.columns) and len(weather.FAMILY_B) == 57
    for r in out.collect():
        total = r.D_storage_0 + r.D_storage_1 + r.D_storage_2 + r.D_storage_3 + r.D_storage_4plus
        assert total == (1.0 if r.days_since_storage_announcement is not None else 0.0)
    assert out.count() == n and {r.window_days % 7 for r in ann.collect()} == {0}


# --- joins


def test_asof_and_nearest(spark):
    left = spark.createDataFrame([(k, day(i)) for k in "ab" for i in range(0, 20, 3)], "k string, date date")
    right = spark.createDataFrame([("a", day(i), float(i)) for i in (1, 4, 4, 11)] + [("b", day(30), None)], "k string, date date, v double")
    got = {(r.k, (r.date - DAY).days): r.v for r in joins.asof(left, right, "date", ["v"], ("k",)).collect()}
    assert got == {("a", i): max((float(j) for j in (1, 4, 11) if j <= i), default=None) for i in range(0, 20, 3)} | {("b", i): None for i in range(0, 20, 3)}
    ev = spark.createDataFrame([(day(3),), (day(9),), (day(99),)], "event_date date")
    facts = spark.createDataFrame([(day(2),), (day(4),), (day(20),)], "date date")
    assert {(r.event_date, r.nearest) for r in joins.nearest(ev, facts).collect()} == {(day(3), day(2)), (day(9), day(4)), (day(99), day(20))}


def test_grid_is_the_product_in_few_tasks(spark):
    names = {"a": [3, 1, 1], "b": [0.5, None], "c": ["x", "y"], "d": [True, False], "e": [DAY, day(1)], "f": [2**40]}
    out = joins.grid(spark, names)
    assert out.dtypes == [("a", "bigint"), ("b", "double"), ("c", "string"), ("d", "boolean"), ("e", "date"), ("f", "bigint")]
    assert out.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert [tuple(r) for r in out.collect()] == list(itertools.product(*names.values()))
    assert joins.grid(spark, names, "a = 1 and b is null").count() == 16
    with pytest.raises(ValueError):
        joins.grid(spark, {"a": [1], "b": []})


# --- statistics


def test_p_values():
    assert econ.incomplete_beta(5.0, 0.5, 10 / (10 + 2.0**2)) == pytest.approx(0.0733880, abs=1e-6)
    assert econ.incomplete_beta(0.5, 0.5, 0.5) == pytest.approx(0.5)
    assert econ.incomplete_beta(2.0, 3.0, 0.4) == pytest.approx(0.5248)
    x = np.linspace(0, 1, 101)
    assert np.allclose(econ.incomplete_beta(1.0, 1.0, x), x, atol=1e-9)
    assert np.allclose(econ.incomplete_beta(40.0, 7.0, x) + econ.incomplete_beta(7.0, 40.0, 1 - x), 1, atol=1e-9)


def test_panel_ols(spark):
    rng = np.random.default_rng(7)
    rows = [(day(i // 8), f"m{i % 4}", float(rng.normal()), float(rng.normal())) for i in range(240)]
    rows = [(d, m, x, z, 2 * x - z + int(m[1]) + rng.normal() * 0.5) for d, m, x, z in rows]
    df = spark.createDataFrame([(*r[:4], float(r[4])) for r in rows], "quote_date date, mnes string, x double, z double, y double")
    out = {r.term: r for r in econ.panel_ols(df, "y", ["x", "z"], None, ("mnes",)).collect()}
    v = {n: np.array([r[i] for r in rows], float) for n, i in (("x", 2), ("z", 3), ("y", 4))}
    names = np.array([r[1] for r in rows])
    for n in v:
        for m in set(names):
            v[n][names == m] -= v[n][names == m].mean()
    a = np.column_stack([np.ones(240), v["x"], v["z"]])
    inv = np.linalg.inv(a.T @ a)
    b = inv @ a.T @ v["y"]
    u = v["y"] - a @ b
    g = np.array([a[i : i + 8].T @ u[i : i + 8] for i in range(0, 240, 8)])
    cov = inv @ g.T @ g @ inv * (30 / 29) * (239 / 237)
    for k, t in enumerate(("const", "x", "z")):
        assert out[t].coef == pytest.approx(b[k], abs=1e-9) and out[t].se == pytest.approx(math.sqrt(cov[k, k]))
    assert out["x"].p < 1e-6 and econ.panel_ols(df.limit(20), "y", ["x"]).count() == 0


def test_comparison_and_rules(spark):
    rng = np.random.default_rng(8)
    rows = [(day(i), f"{h}:00", m, float(rng.normal()), i < 20) for i in range(60) for h in (10, 11) for m in "abcdef"]
    df = spark.createDataFrame(rows, "quote_date date, quote_time string, mnes string, y double, train boolean")
    both = df.withColumn("model_id", F.lit("good")).withColumn("y_hat", F.col("y")).unionByName(df.withColumn("model_id", F.lit("noise")).withColumn("y_hat", F.rand(3)))
    out = {r.model_id: r for r in evaluate.comparison(both, "y_hat", "y", "train").collect()}
    assert out["good"].ic_oos == pytest.approx(1.0) and out["good"].dir_acc == 1.0 and out["noise"].ic_oos < 0.5 and not out["noise"].sig_bhy
    legs = evaluate.extremes(df, "y", 4, ("quote_date", "quote_time"), ("mnes",)).groupBy("position").count().collect()
    assert {r.position: r["count"] for r in legs} == {-1: 480, 1: 240}


def test_portfolio(spark):
    rng = np.random.default_rng(9)
    b = rng.normal(size=(9, 3)) * 0.1
    p = portfolio.Portfolio(top_k=3, bottom_k=3, max_abs=0.4)
    w = p.weights(rng.normal(size=9), b)
    if w is not None:
        assert abs(w.sum()) < 1e-3 and np.abs(b.T @ w).max() < 1e-3 and np.abs(w).sum() == pytest.approx(1) and np.abs(w).max() <= 0.5
    pred = spark.createDataFrame([(day(i), t, float(rng.normal())) for i in range(6) for t in range(1, 13)] + [(day(7), 2, 1.0)], "date date, tenor int, y_pred double")
    load = spark.createDataFrame([(day(i), t, k, float(rng.normal())) for i in range(5) for t in range(1, 13) for k in (1, 2, 3) if (t, k) != (4, 3)], "date date, tenor int, factor int, loading double")
    out = portfolio.Portfolio(max_abs=1.0).panel(pred, load).collect()
    assert {r.date for r in out} == {day(i) for i in range(6)} and not any(r.tenor in (1, 12) for r in out)
    assert not any(r.tenor == 4 for r in out if r.date < day(5)) and any(r.tenor == 4 for r in out if r.date == day(5))
    assert all(r.factor_neutral == (r.date < day(5)) for r in out)
    with pytest.raises(ValueError):
        portfolio.Portfolio().panel(pred)
    strict = portfolio.Portfolio(max_abs=0.01).panel(pred, load).collect()
    assert strict and all(r.weight == 0 for r in strict)


def test_models(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(300, 2))
    df = spark.createDataFrame([(float(a), float(b), float(3 * a - b + 1)) for a, b in x], "a double, b double, y double")
    beta, level = models.ridge(df, "y", ["a", "b"], 0.0)
    assert beta == pytest.approx([3, -1]) and level == pytest.approx(1)
    imp = {r.feature: r.importance for r in models.permutation_importance(df, df, "y", ["a", "b"]).collect()}
    assert imp["a"] > imp["b"] > 0
    for kind in ("Linear", "Lasso", "RandomForest", "XGB"):
        assert models.fit_predict(df, df, "y", ["a", "b"], kind, {} if kind in ("Linear", "Lasso") else {"maxDepth": 3}).where("y_hat is not null").count() == 300
    with pytest.raises(ValueError):
        models.fit_predict(df, df, "y", ["a"], "Oracle")


def test_regimes_and_audit(spark):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(9)], "x double, is_cpi int")
    assert [r[0] for r in regimes.terciles(df, "x", "t").orderBy("x").select("t").collect()] == ["low"] * 3 + ["mid"] * 3 + ["high"] * 3
    assert df.select(regimes.events(df, {"is_fomc": "f", "is_cpi": "c"})).distinct().count() == 2
    assert df.select(regimes.lookup(F.lit("a"), {"a": "A"}), regimes.lookup(F.lit("b"), {"a": "A"})).head() == ("A", "b")
    assert audit.categories(["x_z", "x_cs", "is_a", "raw"]) == {"ts": ["x_z"], "cs": ["x_cs"], "dummies": ["is_a"], "raw": ["raw"]}
    assert audit.rename_by(df, {"cpi": "flag"}).columns == ["x", "flag"]
    assert audit.distinct_sample(df, "x", 4).count() == 4 and audit.select_columns(df, prefix="is_") == ["is_cpi"]
    assert audit.eligible(audit.profile(df, ["x", "is_cpi"])).count() == 2
    f = splits.winsor_fit(df, ["x"], 0.25, 0.75)
    assert [r.x for r in splits.winsor_apply(df, f, clip=("x",)).orderBy("x").collect()][::8] == [2.0, 6.0]


# --- files


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("junk\nmore,junk,here\n Exchange Date ,Open, Close \n2020-01-02,1,5\n2020-01-03,1,bad\n2020-01-02,1,6\nnever,1,7\n")
    out, missing = tables.contracts(spark, {1: f"{tmp_path}/a.csv", 2: f"{tmp_path}/none.csv"})
    assert out.collect() == [(dt.date(2020, 1, 2), 1, 6.0)] and missing == [2]
    (tmp_path / "b.csv").write_text("no,header\n")
    with pytest.raises(ValueError):
        tables.contract(spark, f"{tmp_path}/b.csv", 1)
    for i, name in enumerate(("old", "new")):
        (tmp_path / f"spec_{name}.json").write_text('{"model_name": "%s", "model_class": "Ridge", "model_params": {"alpha": "1.0"}, "global_ic": 0.1}' % name)
        import os

        os.utime(tmp_path / f"spec_{name}.json", (1000 + i, 1000 + i))
    assert [r.model_name for r in tables.model_specs(spark, f"{tmp_path}/spec_*.json").collect()] == ["new", "old"]
    df = series(spark, [1.0, None, 3.0])
    assert tables.write_parquet(df, f"{tmp_path}/p").count() == 3
    tables.write_csv(df, f"{tmp_path}/c")
    assert tables.read_csv(spark, f"{tmp_path}/c", "date date, tenor int, x double").where("x is null").count() == 1
    long = tables.long_panel(tables.wide_panel(df, "date", [1], "x", "hh_"), "date", "hh_", "x")
    assert long.count() == 3 and long.select("tenor").distinct().head()[0] == 1


# --- streams


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2020, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=7 * i), i % 3, "view", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    df.unionByName(df.limit(5)).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: bars.read(spark, f"{tmp_path}/in", df._jdf.schema().toDDL())

    def run(out, name, mode="append"):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    want = {(r.start, r.n) for r in bars.bars(df, "1 hour").collect()}
    got = {(r.start, r.n) for r in run(bars.bars(bars.once(stream()), "1 hour", None), "b1").collect()}
    assert got <= want and len(got) >= len(want) - 2
    assert run(bars.once(stream()), "b2").count() == 60
    assert bars.sessions(df, "10 minutes").count() == 60
    assert run(bars.trailing_mean(bars.once(stream()), 3), "b3").count() == 60


def test_serial_diagnostics(spark):
    """Unit root with chosen lags, and level stationarity, against plain formulas."""
    rng = np.random.default_rng(3)
    noise = rng.normal(size=300)
    series = {"white": noise, "walk": np.cumsum(noise), "ar": np.zeros(300), "flat": np.ones(300), "short": noise[:4]}
    for t in range(1, 300):
        series["ar"][t] = 0.6 * series["ar"][t - 1] + noise[t]
    df = spark.createDataFrame([(k, i, float(v)) for k, vs in series.items() for i, v in enumerate(vs)], "key string, i int, x double")
    out = {r.key: r for r in econ.unit_root(df, "x", "key", "i").collect()}

    def regression(y, lags, skip):
        d = np.diff(y)
        rows = range(skip, len(d))
        x = np.array([[1.0, y[t], *(d[t - k] for k in range(1, lags + 1))] for t in rows])
        v = d[list(rows)]
        b, *_ = np.linalg.lstsq(x, v, rcond=None)
        ssr = ((v - x @ b) ** 2).sum()
        se = np.sqrt(ssr / (len(v) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
        return b[1] / se, len(v) * (np.log(2 * np.pi * ssr / len(v)) + 1) + 2 * x.shape[1]

    for key in ("white", "walk", "ar"):
        most = int(np.ceil(12 * 3**0.25))
        best = min(range(most + 1), key=lambda k: regression(series[key], k, most)[1])
        assert out[key].lags == best and out[key].adf_t == pytest.approx(regression(series[key], best, best)[0])
    assert out["walk"].p > 0.1 > 0.01 > out["white"].p and out["flat"].adf_t is None and out["flat"].p is None
    at = spark.createDataFrame([(-2.86,), (-3.43,), (-2.57,), (5.0,), (-50.0,)], "t double")
    assert [r.p for r in at.select(econ.adf_pvalue("t").alias("p")).collect()] == pytest.approx([0.05, 0.01, 0.10, 1, 0], abs=2e-3)
    level = {r.key: r for r in econ.kpss(df, "x", ("key",), "i").collect()}
    assert level["walk"].p == 0.01 and level["white"].p == 0.10 and level["flat"].kpss is None
    acf = econ.autocorrelation(df.where("key = 'ar'"), "x", ("key",), "i", 6)
    pacf = [r.pacf for r in econ.partial_autocorrelation(acf, ("key",)).orderBy("lag").collect()]
    r = [1.0, *(x.acf for x in acf.orderBy("lag").collect())]
    want = [np.linalg.solve([[r[abs(i - j)] for j in range(k)] for i in range(k)], r[1 : k + 1])[-1] for k in range(1, 7)]
    assert pacf == pytest.approx(want)
    assert econ.unit_root(df.limit(0), "x", "key", "i").count() == econ.kpss(df.limit(0), "x", ("key",), "i").count() == 0


def test_linear_restrictions(spark):
    rng = np.random.default_rng(8)
    n = 400
    x = rng.normal(size=(n, 2))
    y = 1 + x @ [0.5, 0.45] + rng.normal(size=n)
    day = rng.integers(0, 30, n)
    df = spark.createDataFrame([(int(d), float(a), float(b), float(v)) for d, (a, b), v in zip(day, x, y, strict=True)], "quote_date int, a double, b double, y double")
    tests = {"same": [{"a": 1, "b": -1}], "none": [{"a": 1}, {"b": 1}], "twice": [{"a": 1}, {"a": 2}]}
    out = {r.test: r for r in econ.panel_ols(df, "y", ["a", "b"], restrictions=tests).collect()}
    m = np.column_stack([np.ones(n), x])
    inv = np.linalg.inv(m.T @ m)
    beta = inv @ m.T @ y
    u = y - m @ beta
    s = np.array([(m[day == d] * u[day == d, None]).sum(0) for d in np.unique(day)])
    g = len(s)
    v = inv @ s.T @ s @ inv * g / (g - 1) * (n - 1) / (n - 3)
    for name, r in (("same", [[0, 1, -1]]), ("none", [[0, 1, 0], [0, 0, 1]])):
        r = np.array(r, float)
        f = (r @ beta) @ np.linalg.solve(r @ v @ r.T, r @ beta) / len(r)
        assert out[name].f == pytest.approx(f) and (out[name].df1, out[name].df2) == (len(r), g - 1)
    assert out["twice"].f is None and out["same"].p > 0.05 > out["none"].p


def test_importance_of_one_fit(spark):
    rng = np.random.default_rng(4)
    rows = [(float(a), float(b), float(3 * a + 0.1 * rng.normal())) for a, b in rng.normal(size=(500, 2))]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    fitted = models.fit(df, "y", ["a", "b"], "RandomForest", {"numTrees": 5, "maxDepth": 4})
    mdi = {r.feature: r.importance for r in models.impurity_importance(fitted, spark).collect()}
    mda = {r.feature: r.importance for r in models.permuted(fitted, df, "y", 4).collect()}
    assert mdi["a"] > 0.9 and sum(mdi.values()) == pytest.approx(1) and mda["a"] > 5 > abs(mda["b"])
    linear = models.fit(df, "y", ["a", "b"])
    (got,) = [r.importance for r in models.permuted(linear, df, "y", 1).collect() if r.feature == "a"]
    assert got == pytest.approx(18, rel=0.2) and linear.mdi() == {}
    assert models.fitted_by("XGB") == "GBTRegressor" and models.fitted_by("Ridge") == "Ridge"


def test_spec_grid_equals_single_models(spark):
    from tenorlake.operators import factor

    rng = np.random.default_rng(6)
    rows = [(f"2020-{1 + i // 28:02d}-{1 + i % 28:02d}", t, float(v)) for i in range(200) for t, v in enumerate(rng.normal(size=5) + rng.normal(), 1)]
    vecs = factor.vectors(spark.createDataFrame(rows, "date string, tenor int, r double").withColumn("date", F.to_date("date")))
    grid = factor.spec_grid(vecs, 5, (40, 80, 900), (2, 3), (10,), (20, 40))
    out = {(r["T"], r.m, r.tau_slow): r for r in grid.collect()}
    assert len(out) == 12 and out[900, 2, 20].r2 is None and out[900, 2, 20]["rank"] is None
    m = factor.rolling_models(vecs, 80, 10, 40, 3, 2)
    fr = factor.frames(m)
    one = out[80, 2, 40]
    fit = factor.fit_quality(m).agg(F.avg("r2"), F.avg("vol_ratio"), F.min("r2")).head()
    assert (one.r2, one.vol_ratio, one.min_r2) == pytest.approx(tuple(fit))
    off = factor.off_diagonal(fr["residuals"], "eps").head()
    assert (one.resid_corr, one.max_resid_corr) == pytest.approx((off.mean_abs, off.max_abs))
    assert one.stability == pytest.approx(fr["diagnostics"].agg(F.avg("cos_sim")).head()[0])
    assert one.cumevr == pytest.approx(fr["eigenvalues"].where("k = 2").agg(F.avg("cumevr")).head()[0])
    ranked = sorted((r for r in out.values() if r["rank"]), key=lambda r: r["rank"])
    assert len(ranked) == 8 and all(a.score >= b.score for a, b in zip(ranked, ranked[1:], strict=False))
    by = {r.m: r for r in factor.grid_summary(grid, "m").collect()}
    assert by[2].specs == 4 and by[2].r2 == pytest.approx(np.mean([r.r2 for k, r in out.items() if k[1] == 2 and r.r2 is not None]))


def test_scratch_folder_is_shared(spark, monkeypatch):
    from types import SimpleNamespace

    from tenorlake.sources import scratch

    assert scratch.own(spark).startswith(scratch.root(spark))
    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda k: None)))
    with pytest.raises(RuntimeError):
        scratch.root(bare)
