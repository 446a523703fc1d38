"""Queries of the readers, writers and calendars; files are written below the application's scratch folder first."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from tenorlake.functions import dates
from tenorlake.plans.registry import DAILY, PANEL, fin, query
from tenorlake.sources import scratch, tables
from tenorlake.sources.tables import price_panel
from tenorlake.streaming import bars


def _folder(spark, name: str) -> str:
    return f"{scratch.own(spark)}/{name}-{uuid.uuid4().hex}"


def _sheet(spark, d, tenor: int) -> str:
    """A sheet of one contract: tenor % 3 + 2 lines of junk, a header, a line of each week, the first one twice, a bad date and a bad number."""
    p = price_panel(spark, d).where(F.col("tenor") == tenor)
    line = lambda date, close: F.concat_ws(",", date, close.cast("string"), F.lit("x"))
    rows = p.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "price").select(F.concat(F.lit("4"), "date").alias("at"), line(F.col("date"), F.col("price")).alias("value"))
    first = p.agg(F.date_format(F.min("date"), "yyyy-MM-dd").alias("date")).select(F.lit("3").alias("at"), line(F.col("date"), F.lit(1.0)).alias("value"))
    fixed = [(f"1{i}", "exported,2020") for i in range(tenor % 3 + 2)] + [("2", " Exchange Date , Close ,Note"), ("5", "2099-99-99,1.5,bad"), ("6", "2098-01-01,n/a,bad")]
    path = _folder(spark, f"sheet-{tenor}")
    rows.unionByName(first).unionByName(spark.createDataFrame(fixed, "at string, value string")).repartition(1).sortWithinPartitions("at").select("value").write.text(path)
    return path


@query(fin(PANEL, "tenor, header_row", "", "SELECT DISTINCT tenor, CAST(tenor % 3 + 2 AS BIGINT) AS header_row FROM panel WHERE tenor <= 3"))
def s01_header_row(spark, d):
    found = []
    for tenor in (1, 2, 3):
        text = spark.read.text(_sheet(spark, d, tenor)).select(F.monotonically_increasing_id().alias("row"), F.split("value", ",").alias("cells"))
        found.append((tenor, tables.header_row(text)))
    return spark.createDataFrame(found, "tenor int, header_row long")


@query(fin(PANEL, "date, tenor", "price", "SELECT * FROM panel WHERE tenor = 1"))
def s02_contract(spark, d):
    return tables.contract(spark, _sheet(spark, d, 1), 1)


@query(fin(PANEL, "tenor, n", "mean", "SELECT tenor, count(*) AS n, avg(price) AS mean FROM panel GROUP BY tenor UNION ALL SELECT unnest([8, 9]), 0, NULL"))
def s03_contracts(spark, d):
    paths = {t: _sheet(spark, d, t) for t in range(1, 8)} | {t: _folder(spark, f"sheet-{t}") for t in (8, 9)}
    found, missing = tables.contracts(spark, paths)
    absent = spark.createDataFrame([(t,) for t in missing], "tenor int").select("tenor", F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("mean"))
    return found.groupBy("tenor").agg(F.count("*").alias("n"), F.avg("price").alias("mean")).unionByName(absent)


@query(fin(DAILY, "date", "HDD, CDD", "SELECT * FROM daily"))
def s04_read_csv(spark, d):
    path = _folder(spark, "daily")
    tables.write_csv(tables.daily_series(spark, d).orderBy("date"), path)
    return tables.read_csv(spark, path, "date date, HDD double, CDD double")


@query(fin("", "place, model_name, model_class, alpha", "global_ic", "SELECT 1::INTEGER AS place, 'late' AS model_name, 'Ridge' AS model_class, '2.0' AS alpha, 0.25::DOUBLE AS global_ic UNION ALL SELECT 2, 'early', 'Lasso', '0.5', NULL"))
def s06_model_specs(spark, d):
    folder = _folder(spark, "specs")
    for name, kind, alpha, ic, seconds in (("early", "Lasso", "0.5", None, 100), ("late", "Ridge", "2.0", 0.25, 200)):
        fs, path = scratch.files(spark, f"{folder}/{name}.json")
        out = fs.create(path)
        out.write(bytearray(json.dumps({"model_name": name, "model_class": kind, "model_params": {"alpha": alpha}, "global_ic": ic}, indent=1).encode()))
        out.close()
        fs.setTimes(path, seconds * 1000, -1)
    return tables.model_specs(spark, folder).limit(10).select(F.monotonically_increasing_id().cast("int").alias("i"), "*").select((F.col("i") + 1).alias("place"), "model_name", "model_class", F.col("model_params")["alpha"].alias("alpha"), "global_ic")


@query(fin(PANEL, "date, tenor", "price", "SELECT * FROM panel"))
def s07_csv_sink(spark, d):
    path = _folder(spark, "prices")
    tables.write_csv(price_panel(spark, d), path)
    return tables.read_csv(spark, path, "date date, tenor int, price double")


@query(fin(PANEL, "date, tenor", "price", "SELECT * FROM panel"))
def s08_parquet_sink(spark, d):
    return tables.write_parquet(price_panel(spark, d), _folder(spark, "panel"), ("tenor",))


@query(fin(PANEL, "month, roll", "", "SELECT CAST(m AS DATE) AS month, CAST(m - CASE WHEN isodow(m) <= 2 THEN 4 WHEN isodow(m) = 7 THEN 3 ELSE 2 END * INTERVAL 1 DAY AS DATE) AS roll FROM (SELECT unnest(generate_series(date_trunc('month', (SELECT min(date) FROM panel)), date_trunc('month', (SELECT max(date) FROM panel)) + INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS m)"))
def s10_delivery_months(spark, d):
    return dates.month_starts(price_panel(spark, d)).select("month", dates.roll_date("month").alias("roll"))


# --- streams


def _streamed(spark, d, name: str, copies: int, of):
    """The rows that a stream over the events writes: files of all events, so many times, one in each batch."""
    folder = _folder(spark, name)
    events = tables.table(spark, d, "events", "event_id", "user_id", "ts", "value").withColumn("ts", F.col("ts").cast("timestamp"))
    for _ in range(copies):
        events.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    out = of(bars.read(spark, f"{folder}/in", events.schema.simpleString()[7:-1].replace(":", " ")))
    out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@query(fin("", "event_id, user_id", "value", "SELECT event_id, user_id, value FROM events"))
def w_stream_once(spark, d):
    """Every event arrives twice, and is passed on once."""
    return _streamed(spark, d, "once", 2, lambda e: bars.once(e)).select("event_id", "user_id", "value")


@query(fin("", "user_id, ts", "value, trailing_mean", "SELECT user_id, ts, value, avg(value) OVER (PARTITION BY user_id ORDER BY ts, value ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS trailing_mean FROM events"))
def w_stream_trailing_mean(spark, d):
    return _streamed(spark, d, "trailing", 1, lambda e: bars.trailing_mean(e.select("user_id", "ts", "value"))).select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value", F.col("trailing").alias("trailing_mean"))
