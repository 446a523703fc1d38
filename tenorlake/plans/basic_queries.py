"""Queries of single operators: projections, equi-joins, aggregates, windows, sets, scalars."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tenorlake.functions import dates
from tenorlake.functions.nulls import avg_rank, clip, flag, is_close, rolling, rows, safe_bin, stars
from tenorlake.operators import audit, econ, evaluate, joins, regimes
from tenorlake.plans.model_queries import predictions
from tenorlake.plans.panel_queries import eps, returns
from tenorlake.plans.registry import DAILY, EPS, IC, INTRA, PANEL, PRED, RET, STOCK, fin, query
from tenorlake.plans.series_queries import daily, stock
from tenorlake.sources import tables

# --- projections


@query(fin(PANEL, "label, tenor, date", "price", "SELECT 'M' || tenor AS label, tenor, date, price FROM panel"))
def p02_tenor_labels(spark, d):
    x = tables.price_panel(spark, d).withColumn("label", F.concat(F.lit("M"), "tenor"))
    return x.select("label", tables.tenor_number("label").alias("tenor"), "date", "price")


@query(fin(RET, "date, tenor", "r", "SELECT date, tenor, r FROM ret WHERE r IS NOT NULL AND tenor NOT IN (1, 7) AND date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'"))
def p05_p06_membership_and_slice(spark, d):
    return returns(spark, d).where(F.col("r").isNotNull() & ~F.col("tenor").isin(1, 7) & F.col("date").between("1998-01-01", "1999-12-31"))


@query(fin(EPS, "date, tenor, label", "eps", "SELECT date, tenor, CASE WHEN abs(eps) > 0.2 THEN 'large' WHEN eps > 0 THEN 'up' ELSE 'down' END AS label, eps FROM eps"))
def p08_conditional_assignment(spark, d):
    return eps(spark, d).select("date", "tenor", F.when(F.abs("eps") > 0.2, "large").when(F.col("eps") > 0, "up").otherwise("down").alias("label"), "eps")


@query(fin(RET, "same, close", "", "SELECT count(*) FILTER (r IS NOT DISTINCT FROM r) AS same, count(*) FILTER (abs(r - (r + 1e-9::DOUBLE)) <= 1e-8::DOUBLE + 1e-5::DOUBLE * abs(r + 1e-9::DOUBLE)) AS close FROM ret"))
def p11_is_close(spark, d):
    return returns(spark, d).agg(F.count_if(is_close("r", "r")).alias("same"), F.count_if(is_close(F.col("r"), F.col("r") + 1e-9)).alias("close"))


@query(fin(INTRA, "family, n", "", "SELECT coalesce(CASE option_type WHEN 'click' THEN 'act' WHEN 'purchase' THEN 'act' END, option_type) AS family, count(*) AS n FROM intra GROUP BY 1"))
def p12_lookup_default(spark, d):
    x = tables.intraday_panel(spark, d)
    return x.groupBy(regimes.lookup("option_type", {"click": "act", "purchase": "act"}).alias("family")).agg(F.count("*").alias("n"))


@query(fin(EPS, "date, tenor", "lagged", "SELECT date, tenor, coalesce(lag(eps) OVER (PARTITION BY tenor ORDER BY date), 0) AS lagged FROM eps"))
def p14_fill_zero(spark, d):
    return eps(spark, d).select("date", "tenor", F.coalesce(F.lag("eps").over(W.partitionBy("tenor").orderBy("date")), F.lit(0.0)).alias("lagged"))


# --- equi-joins


@query(fin(EPS, "date, tenor", "r, eps", "SELECT date, tenor, r, eps FROM ret JOIN eps USING (date, tenor)"))
def j03_two_keys(spark, d):
    return returns(spark, d).join(eps(spark, d), ["date", "tenor"])


@query(fin(PANEL + ", " + DAILY, "date, tenor", "price, HDD", "SELECT panel.date, tenor, price, HDD FROM panel LEFT JOIN daily USING (date)"))
def j04_broadcast_daily(spark, d):
    return tables.price_panel(spark, d).join(daily(spark, d), "date", "left").select("date", "tenor", "price", "HDD")


@query(fin(IC + ", " + DAILY + ", " + STOCK, "date", "ic, HDD, Storage", "SELECT ic.date, ic, HDD, Storage FROM ic JOIN daily USING (date) JOIN stock USING (date)"))
def j05_inner_chain(spark, d):
    ic = evaluate.spearman(predictions(spark, d), "y_pred", "y_true", ("date",))
    return ic.join(daily(spark, d), "date").join(stock(spark, d), "date").select("date", "ic", "HDD", "Storage")


@query(fin(RET, "tenor, date", "r0", "SELECT k.tenor, k.date, ret.r AS r0 FROM (SELECT * FROM (SELECT DISTINCT date FROM panel), (SELECT DISTINCT tenor FROM panel)) k LEFT JOIN ret USING (date, tenor)"))
def j16_reindex(spark, d):
    p = tables.price_panel(spark, d)
    spine = p.select("date").distinct().crossJoin(F.broadcast(p.select("tenor").distinct()))
    return spine.join(returns(spark, d), ["date", "tenor"], "left").select("tenor", "date", F.col("r").alias("r0"))


@query(fin(PANEL, "date, tenor", "carry", "SELECT date, tenor, ln(price / p1) AS carry FROM (SELECT a.date, a.tenor, a.price, (SELECT price FROM panel b WHERE b.tenor = a.tenor + 1 AND b.date = a.d1) AS p1 FROM (SELECT *, lag(date) OVER (PARTITION BY tenor ORDER BY date) AS d1 FROM panel) a) WHERE p1 IS NOT NULL"))
def j14_next_tenor_before(spark, d):
    p = tables.price_panel(spark, d)
    a = p.withColumn("d1", F.lag("date").over(W.partitionBy("tenor").orderBy("date")))
    b = p.select(F.col("date").alias("d1"), (F.col("tenor") - 1).alias("tenor"), F.col("price").alias("p1"))
    return a.join(b, ["d1", "tenor"]).select("date", "tenor", F.ln(F.col("price") / F.col("p1")).alias("carry"))


# --- aggregates


@query(fin(INTRA, "option_type, quote_time, n", "mean, low, high", "SELECT option_type, quote_time, count(*) AS n, avg(y) AS mean, min(y) AS low, max(y) AS high FROM intra GROUP BY 1, 2"))
def a03_group_multi_agg(spark, d):
    return tables.intraday_panel(spark, d).groupBy("option_type", "quote_time").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.min("y").alias("low"), F.max("y").alias("high"))


@query(fin(INTRA, "quote_date, quote_time", "level", "SELECT quote_date, quote_time, max(round(y, 0)) AS level FROM intra GROUP BY 1, 2"))
def a05_group_first(spark, d):
    return tables.intraday_panel(spark, d).groupBy("quote_date", "quote_time").agg(F.max(F.round("y", 0)).alias("level"))


@query(fin(RET, "tenor", "share_up, share_large", "SELECT tenor, avg(CAST(r > 0 AS INTEGER)) AS share_up, avg(CAST(abs(r) > 0.2 AS INTEGER)) AS share_large FROM ret GROUP BY 1"))
def a07_shares(spark, d):
    return returns(spark, d).groupBy("tenor").agg(F.avg(flag(F.col("r") > 0)).alias("share_up"), F.avg(flag(F.abs("r") > 0.2)).alias("share_large"))


LAGS = EPS + ", lg AS (SELECT lag(eps, 1) OVER w AS lag_1, lag(eps, 5) OVER w AS lag_5, lag(eps, 20) OVER w AS lag_20 FROM eps WINDOW w AS (PARTITION BY tenor ORDER BY date))"


@query(fin(LAGS, "feature", "missing", " UNION ALL ".join(f"SELECT 'lag_{k}' AS feature, avg(CAST(lag_{k} IS NULL AS INTEGER)) AS missing FROM lg" for k in (1, 5, 20))))
def a08_missing_share(spark, d):
    w = W.partitionBy("tenor").orderBy("date")
    x = eps(spark, d).select(*(F.lag("eps", k).over(w).alias(f"lag_{k}") for k in (1, 5, 20)))
    return audit.long(x, x.columns).groupBy("feature").agg(F.avg(F.col("value").isNull().cast("double")).alias("missing"))


@query(fin(INTRA, "option_type, mnes", "positive", "SELECT option_type, mnes, avg(CAST(y > 50 AS INTEGER)) AS positive FROM intra GROUP BY 1, 2"))
def a12_positive_rate(spark, d):
    return tables.intraday_panel(spark, d).groupBy("option_type", "mnes").agg(F.avg(flag(F.col("y") > 50)).alias("positive"))


@query(fin(RET, "tenor, top, low", "", "SELECT tenor, arg_max(date, r) AS top, arg_min(date, r) AS low FROM ret GROUP BY 1"))
def a18_argmax(spark, d):
    return returns(spark, d).groupBy("tenor").agg(F.max_by("date", "r").alias("top"), F.min_by("date", "r").alias("low"))


@query(fin(INTRA, "quote_date, option_type", "total", "SELECT quote_date, option_type, coalesce(sum(y), 0) AS total FROM intra GROUP BY 1, 2"))
def a27_daily_sum(spark, d):
    return tables.intraday_panel(spark, d).groupBy("quote_date", "option_type").agg(F.coalesce(F.sum("y"), F.lit(0.0)).alias("total"))


@query(fin(INTRA, "option_type, mnes, n", "mean", "SELECT option_type, mnes, count(*) AS n, avg(y) AS mean FROM intra GROUP BY CUBE (option_type, mnes)"))
def a30_cube(spark, d):
    return tables.intraday_panel(spark, d).cube("option_type", "mnes").agg(F.count("*").alias("n"), F.avg("y").alias("mean"))


@query(fin("", "feature", "", "SELECT unnest(['l_quantity', 'l_tax']) AS feature"))
def a31_eligible_columns(spark, d):
    x = tables.table(spark, d, "lineitem", "l_quantity", "l_tax").withColumn("constant", F.lit(1.0)).withColumn("empty", F.lit(None).cast("double"))
    return audit.eligible(audit.profile(x, x.columns))


# --- windows


@query(fin(RET, "date, tenor", "lag1, lead2, diff", "SELECT date, tenor, lag(r) OVER w AS lag1, lead(r, 2) OVER w AS lead2, r - lag(r) OVER w AS diff FROM ret WINDOW w AS (PARTITION BY tenor ORDER BY date)"))
def w01_w02_lag_lead_diff(spark, d):
    w = W.partitionBy("tenor").orderBy("date")
    return returns(spark, d).select("date", "tenor", F.lag("r").over(w).alias("lag1"), F.lead("r", 2).over(w).alias("lead2"), (F.col("r") - F.lag("r").over(w)).alias("diff"))


@query(fin(EPS, "date, tenor", "mean5, std20, sum5", "SELECT date, tenor, CASE WHEN count(eps) OVER a >= 3 THEN avg(eps) OVER a END AS mean5, CASE WHEN count(eps) OVER b >= 10 THEN stddev_samp(eps) OVER b END AS std20, CASE WHEN count(eps) OVER a >= 3 THEN sum(eps) OVER a END AS sum5 FROM eps WINDOW a AS (PARTITION BY tenor ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), b AS (PARTITION BY tenor ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"))
def w04_w05_w06_rolling(spark, d):
    a, b = rows(("tenor",), ["date"], -4, 0), rows(("tenor",), ["date"], -19, 0)
    return eps(spark, d).select("date", "tenor", rolling(F.avg, "eps", a, 3).alias("mean5"), rolling(F.stddev_samp, "eps", b, 10).alias("std20"), rolling(F.sum, "eps", a, 3).alias("sum5"))


@query(fin(DAILY + ", gaps AS (SELECT date, CASE WHEN day(date) % 4 = 0 THEN HDD END AS x FROM daily)", "date", "filled", "SELECT date, last_value(x IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM gaps"))
def w14_forward_fill(spark, d):
    x = daily(spark, d).select("date", F.when(F.dayofmonth("date") % 4 == 0, F.col("HDD")).alias("filled"))
    return joins.forward_fill(x, ["filled"])


@query(fin(INTRA, "quote_date, option_type, mnes, quote_time, bar", "", "SELECT *, row_number() OVER (PARTITION BY quote_date, option_type, mnes ORDER BY quote_time) - 1 AS bar FROM intra"))
def w15_cumcount(spark, d):
    return tables.intraday_panel(spark, d).select("quote_date", "option_type", "mnes", "quote_time", (F.row_number().over(W.partitionBy("quote_date", "option_type", "mnes").orderBy("quote_time")) - 1).cast("long").alias("bar"))


@query(fin(PRED, "date, tenor, position", "", "SELECT date, tenor, CAST(CASE WHEN up <= 1 THEN -1 WHEN up > n - 1 THEN 1 ELSE 0 END AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY y_pred, tenor) AS up, count(*) OVER (PARTITION BY date) AS n FROM pred)"))
def w16_top_bottom(spark, d):
    return evaluate.extremes(predictions(spark, d), "y_pred", 1, ("date",), ("tenor",)).select("date", "tenor", "position")


@query(fin(PRED, "date, tenor", "r, pct", "SELECT date, tenor, r, r / count(*) OVER (PARTITION BY date) AS pct FROM (SELECT date, tenor, rank() OVER (PARTITION BY date ORDER BY round(y_pred, 1)) + (count(*) OVER (PARTITION BY date, round(y_pred, 1)) - 1) / 2.0::DOUBLE AS r FROM pred)"))
def w17_average_rank(spark, d):
    x = predictions(spark, d).withColumn("v", F.round("y_pred", 1))
    return x.withColumn("r", avg_rank("v", ("date",))).select("date", "tenor", "r", (F.col("r") / F.count("*").over(W.partitionBy("date"))).alias("pct"))


@query(fin(RET, "date, tenor", "sign", "SELECT date, tenor, CASE WHEN sum(CAST(r < 0 AS INTEGER)) OVER (PARTITION BY tenor ORDER BY date) % 2 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sign FROM ret"))
def w25_running_parity(spark, d):
    n = F.sum((F.col("r") < 0).cast("int")).over(rows(("tenor",), ["date"], None, 0))
    return returns(spark, d).select("date", "tenor", F.when(n % 2 == 1, -1.0).otherwise(1.0).alias("sign"))


@query(fin(RET, "date, tenor, tile", "pct_rank, cume", "SELECT date, tenor, CAST(ntile(4) OVER w AS INTEGER) AS tile, percent_rank() OVER w AS pct_rank, cume_dist() OVER w AS cume FROM ret WINDOW w AS (PARTITION BY tenor ORDER BY r)"))
def w26_ranking_functions(spark, d):
    w = W.partitionBy("tenor").orderBy("r")
    return returns(spark, d).select("date", "tenor", F.ntile(4).over(w).alias("tile"), F.percent_rank().over(w).alias("pct_rank"), F.cume_dist().over(w).alias("cume"))


# --- sorts and sets


@query(fin(PANEL, "date, tenor", "price", "SELECT date, tenor, price FROM (SELECT *, row_number() OVER (PARTITION BY tenor ORDER BY price DESC, date) AS k FROM panel) WHERE k <= 3"))
def o02_grouped_top_k(spark, d):
    k = F.row_number().over(W.partitionBy("tenor").orderBy(F.desc("price"), "date"))
    return tables.price_panel(spark, d).withColumn("k", k).where("k <= 3").drop("k")


@query(fin(PANEL, "month, tenor", "price", "SELECT month, tenor, price FROM (SELECT CAST(date_trunc('month', date) AS DATE) AS month, tenor, price, row_number() OVER (PARTITION BY date_trunc('month', date), tenor ORDER BY date DESC) AS k FROM panel) WHERE k = 1"))
def o03_keep_last(spark, d):
    x = tables.price_panel(spark, d).groupBy(F.trunc("date", "MM").alias("month"), "tenor")
    return x.agg(F.max_by("price", "date").alias("price"))


@query()
def o05_hash_sample(spark, d):
    return audit.distinct_sample(daily(spark, d), "date", 80)


@query(fin(PANEL, "tenor, part", "price", "SELECT tenor, 'low' AS part, price FROM panel WHERE tenor <= 2 UNION ALL SELECT tenor, 'high', price FROM panel WHERE tenor >= 6"))
def u01_union_all(spark, d):
    p = tables.price_panel(spark, d)
    return p.where("tenor <= 2").select("tenor", F.lit("low").alias("part"), "price").unionByName(p.where("tenor >= 6").select("tenor", F.lit("high").alias("part"), "price"))


@query(fin(PANEL + ", " + DAILY, "kind, date", "", "SELECT 'both' AS kind, date FROM (SELECT date FROM panel INTERSECT SELECT date FROM daily) UNION ALL SELECT 'panel only', date FROM (SELECT date FROM panel EXCEPT SELECT date FROM daily)"))
def u02_intersect_except(spark, d):
    a, b = tables.price_panel(spark, d).select("date"), daily(spark, d).select("date")
    return a.intersect(b).select(F.lit("both").alias("kind"), "date").unionByName(a.distinct().exceptAll(b).select(F.lit("panel only").alias("kind"), "date"))


@query(fin("", "key", "", "SELECT l_returnflag AS key FROM lineitem UNION SELECT l_linestatus FROM lineitem"))
def u03_unique_of_two(spark, d):
    x = tables.table(spark, d, "lineitem", "l_returnflag", "l_linestatus")
    return x.select(F.col("l_returnflag").alias("key")).distinct().union(x.select("l_linestatus").distinct()).distinct()


# --- scalars


@query(fin(EPS, "date, tenor", "e, s, q, a, g, lo, hi, mid, r2", "SELECT date, tenor, exp(eps) AS e, sqrt(abs(eps)) AS s, eps * eps AS q, abs(eps) AS a, CAST(sign(eps) AS DOUBLE) AS g, greatest(eps, -0.1) AS lo, least(eps, 0.1) AS hi, least(greatest(eps, -0.1), 0.1) AS mid, round(eps, 2) AS r2 FROM eps"))
def f01_f03_f04_scalars(spark, d):
    x = F.col("eps")
    return eps(spark, d).select("date", "tenor", F.exp(x).alias("e"), F.sqrt(F.abs(x)).alias("s"), (x * x).alias("q"), F.abs(x).alias("a"), F.signum(x).alias("g"), clip(x, -0.1).alias("lo"), clip(x, None, 0.1).alias("hi"), clip(x, -0.1, 0.1).alias("mid"), F.round(x, 2).alias("r2"))


@query(fin(EPS + ", q AS (SELECT quantile_cont(eps, 1.0 / 3) AS a, quantile_cont(eps, 2.0 / 3) AS b FROM eps)", "date, tenor, bin", "", "SELECT date, tenor, CASE WHEN eps <= a THEN 'low' WHEN eps <= b THEN 'mid' ELSE 'high' END AS bin FROM eps, q"))
def f05_terciles(spark, d):
    return regimes.terciles(eps(spark, d), "eps", "bin").select("date", "tenor", "bin")


@query(fin(DAILY, "date, month, m1, m12, gap, lag_days", "", "SELECT date, CAST(month(date) AS INTEGER) AS month, CAST(month(date) = 1 AS INTEGER) AS m1, CAST(month(date) = 12 AS INTEGER) AS m12, CAST(least(abs(dayofyear(date) - 1), 365 - abs(dayofyear(date) - 1)) AS INTEGER) AS gap, CAST(date - lag(date) OVER (ORDER BY date) AS INTEGER) AS lag_days FROM daily"))
def f08_f10_f11_calendar(spark, d):
    m = F.month("date")
    return daily(spark, d).select("date", m.alias("month"), (m == 1).cast("int").alias("m1"), (m == 12).cast("int").alias("m12"), dates.cyclic_distance(F.dayofyear("date"), F.lit(1)).alias("gap"), F.datediff("date", F.lag("date").over(W.orderBy("date"))).alias("lag_days"))


@query(fin(DAILY, "date, k", "", "SELECT date, CASE WHEN isodow(date) <= 5 THEN 5 * CAST(floor((date - DATE '1970-01-05') / 7) AS BIGINT) + isodow(date) - 1 END AS k FROM daily"))
def f12_business_ordinal(spark, d):
    return daily(spark, d).select("date", dates.business_ordinal("date").alias("k"))


@query(fin("", "p_partkey, name, word, head, swapped, starts", "", "SELECT p_partkey, trim(p_name) AS name, split_part(p_name, ' ', 2) AS word, substr(p_brand, 1, 5) AS head, replace(p_brand, 'Brand', 'B') AS swapped, starts_with(p_type, 'ECON') AS starts FROM part"))
def f15_strings(spark, d):
    x = tables.table(spark, d, "part", "p_partkey", "p_name", "p_type", "p_brand")
    return x.select("p_partkey", F.trim("p_name").alias("name"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("word"), F.substring("p_brand", 1, 5).alias("head"), F.replace("p_brand", F.lit("Brand"), F.lit("B")).alias("swapped"), F.startswith("p_type", F.lit("ECON")).alias("starts"))


@query(fin("", "event_id, key", "num", "SELECT event_id, event_type AS key, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'bad' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS num FROM events"))
def f16_coerce(spark, d):
    x = tables.table(spark, d, "events", "event_id", "event_type")
    return x.select("event_id", F.col("event_type").alias("key"), F.when(F.col("event_id") % 3 == 0, "bad").otherwise(F.col("event_id").cast("string")).try_cast("double").alias("num"))


@query(fin(IC, "year, mark", "p0", "SELECT CAST(year(date) AS INTEGER) AS year, abs(avg(ic)) AS p0, CASE WHEN abs(avg(ic)) < 0.01 THEN '***' WHEN abs(avg(ic)) < 0.05 THEN '**' WHEN abs(avg(ic)) < 0.1 THEN '*' ELSE '' END AS mark FROM ic GROUP BY 1"))
def f17_stars(spark, d):
    ic = evaluate.spearman(predictions(spark, d), "y_pred", "y_true", ("date",))
    return ic.groupBy(F.year("date").alias("year")).agg(F.abs(F.avg("ic")).alias("p0")).withColumn("mark", stars("p0"))


@query(fin("", "vec_id, top", "dot, norm, run", "SELECT vec_id, CAST(list_position(e, list_max(e)) - 1 AS INTEGER) AS top, list_dot_product(e, e[1:64]) AS dot, sqrt(list_dot_product(e, e)) AS norm, list_sum(e[1:10]) AS run FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"))
def f18_array_ops(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    x = tables.table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", e.alias("e"))
    dot = total(F.zip_with("e", "e", lambda a, b: a * b))
    return x.select("vec_id", (F.array_position("e", F.array_max("e")) - 1).cast("int").alias("top"), dot.alias("dot"), F.sqrt(dot).alias("norm"), total(F.slice("e", 1, 10)).alias("run"))


@query(fin("", "event_id, keys", "", "SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events"))
def f19_json_keys(spark, d):
    x = tables.table(spark, d, "events", "event_id", "props")
    return x.select("event_id", F.array_join(F.array_sort(F.json_object_keys("props")), ",").alias("keys"))


@query(fin(RET, "tenor", "ann, implied", "SELECT tenor, stddev_samp(r) * sqrt(252) AS ann, sqrt(greatest(var_samp(r), 0) * 252) * 100 AS implied FROM ret GROUP BY 1"))
def f20_annualise(spark, d):
    return returns(spark, d).groupBy("tenor").agg((F.stddev_samp("r") * 252**0.5).alias("ann"), (F.sqrt(F.greatest(F.var_samp("r"), F.lit(0.0)) * 252) * 100).alias("implied"))


# --- evaluation


@query(fin(PRED, "rule, n", "mean, sharpe", "SELECT rule, count(*) AS n, avg(p) AS mean, avg(p) / stddev_samp(p) * sqrt(252) AS sharpe FROM (SELECT 'sign' AS rule, sign(y_pred) * y_true AS p FROM pred UNION ALL SELECT 'threshold', CASE WHEN abs(y_pred) >= 0.05 THEN sign(y_pred) ELSE 0 END * y_true FROM pred UNION ALL SELECT 'long', y_true FROM pred) GROUP BY rule"))
def m35_rule_comparison(spark, d):
    p = predictions(spark, d)
    rule = lambda name, v: p.select(F.lit(name).alias("rule"), v.alias("p"))
    every = rule("sign", F.signum("y_pred") * F.col("y_true")).unionByName(rule("threshold", evaluate.threshold_rule("y_pred", 0.05) * F.col("y_true"))).unionByName(rule("long", F.col("y_true")))
    return every.groupBy("rule").agg(F.count("*").alias("n"), F.avg("p").alias("mean"), econ.sharpe("p").alias("sharpe"))


@query(fin(IC, "split", "val_ic, train_ic, gap", "SELECT a.y AS split, a.m AS val_ic, b.m AS train_ic, b.m - a.m AS gap FROM (SELECT CAST(year(date) AS INTEGER) AS y, avg(ic) AS m FROM ic GROUP BY 1) a JOIN (SELECT CAST(year(date) AS INTEGER) AS y, avg(ic) AS m FROM ic GROUP BY 1) b ON b.y = a.y - 1"))
def m36_split_gap(spark, d):
    m = evaluate.spearman(predictions(spark, d), "y_pred", "y_true", ("date",)).groupBy(F.year("date").alias("split")).agg(F.avg("ic").alias("val_ic"))
    t = m.select((F.col("split") + 1).alias("split"), F.col("val_ic").alias("train_ic"))
    return m.join(t, "split").withColumn("gap", F.col("train_ic") - F.col("val_ic"))


@query(fin(IC + ", " + DAILY + ", j AS (SELECT ic.date, ic, HDD FROM ic JOIN daily USING (date) WHERE HDD > 0), q AS (SELECT *, row_number() OVER (ORDER BY HDD, date) AS r, count(*) OVER () AS n FROM j)", "bin, n", "mean", "SELECT CAST(greatest(1, ceil(((r - 1) * 5) / (n - 1))) AS INTEGER) AS bin, count(*) AS n, avg(ic) AS mean FROM q GROUP BY 1"))
def m29_ic_by_weather_quintile(spark, d):
    ic = evaluate.spearman(predictions(spark, d), "y_pred", "y_true", ("date",))
    j = ic.select("date", "ic").join(daily(spark, d), "date").where("HDD > 0").withColumn("bin", safe_bin("HDD", 5, [], ["date"]))
    return j.groupBy("bin").agg(F.count("*").alias("n"), F.avg("ic").alias("mean"))


@query(fin(EPS, "date", "dispersion", "SELECT date, stddev_samp(eps) AS dispersion FROM eps GROUP BY date HAVING count(*) >= 3 ORDER BY dispersion DESC, date LIMIT 20"))
def o01_sorted_dispersion(spark, d):
    g = eps(spark, d).groupBy("date").agg(F.stddev_samp("eps").alias("dispersion"), F.count("*").alias("n")).where("n >= 3")
    return g.orderBy(F.desc("dispersion"), "date").limit(20).select("date", "dispersion")


@query(fin("", 'user_id, start, "end", n', "total", "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n, sum(value) AS total FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, value, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, s"))
def w_sessions(spark, d):
    from tenorlake.streaming import bars

    return bars.sessions(tables.table(spark, d, "events", "ts", "user_id", "value"), "6 hours")

