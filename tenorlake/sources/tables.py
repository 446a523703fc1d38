"""Readers and writers, and the panels that the driver's tables carry.

A panel is long: (date, tenor, price). It is a partial aggregate of the scan,
so the shuffle carries one row per task, week and tenor, and every window that
follows works on weeks, not on line items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tenorlake.functions.nulls import clean


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def price_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, tenor, price): weeks x line numbers, price per unit."""
    items = table(spark, sf_dir, "lineitem", "l_shipdate", "l_linenumber", "l_extendedprice", "l_quantity")
    week = F.to_date(F.date_trunc("week", "l_shipdate")).alias("date")
    return items.groupBy(week, F.col("l_linenumber").alias("tenor")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


def balanced(panel: DataFrame, date: str = "date", tenor: str = "tenor") -> DataFrame:
    """Rows of the dates on which every tenor is there."""
    n = panel.agg(F.countDistinct(tenor).alias("__n"))
    full = panel.groupBy(date).agg(F.countDistinct(tenor).alias("__m")).crossJoin(F.broadcast(n)).where("__m = __n").select(date)
    return panel.join(full, date, "left_semi")


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, HDD, CDD): days of orders; the two sides of a fixed level of the day's mean total, in thousands."""
    orders = table(spark, sf_dir, "orders", "o_orderdate", "o_totalprice")
    level = orders.groupBy(F.to_date("o_orderdate").alias("date")).agg((F.avg("o_totalprice") / 1000).alias("x"))
    return level.select("date", F.greatest(150 - F.col("x"), F.lit(0.0)).alias("HDD"), F.greatest(F.col("x") - 150, F.lit(0.0)).alias("CDD"))


def weekly_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, Storage): on each day the last Friday's cumulative signed order totals, in millions."""
    orders = table(spark, sf_dir, "orders", "o_orderdate", "o_totalprice", "o_orderstatus")
    sign = F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1)
    week = F.date_add(F.to_date(F.date_trunc("week", "o_orderdate")), 4).alias("friday")
    weekly = orders.groupBy(week).agg((F.sum(sign * F.col("o_totalprice")) / 1e6).alias("flow"))
    stock = weekly.select("friday", F.sum("flow").over(W.orderBy("friday")).alias("Storage"))
    days = orders.select(F.to_date("o_orderdate").alias("date")).distinct()
    friday = F.date_sub("date", F.pmod(F.weekday("date") + 3, F.lit(7)))
    return days.join(stock, friday == F.col("friday")).select("date", "Storage")


def intraday_panel(spark: SparkSession, sf_dir: str, minutes: int = 60, names: int = 8) -> DataFrame:
    """(quote_date, quote_time, option_type, mnes, y): mean event values by slot, type and a bucket of users."""
    events = table(spark, sf_dir, "events", "ts", "user_id", "event_type", "value")
    slot = F.window("ts", f"{minutes} minutes")["start"]
    keys = [F.to_date(slot).alias("quote_date"), F.date_format(slot, "HH:mm").alias("quote_time"), F.col("event_type").alias("option_type"), F.pmod(F.col("user_id"), F.lit(names)).cast("string").alias("mnes")]
    return events.groupBy(*keys).agg(F.avg("value").alias("y"))


# --- files


def header_row(lines: DataFrame, wanted: tuple[str, ...] = ("Exchange Date", "Close"), limit: int = 50) -> int:
    """Number of the first of ``limit`` lines with all wanted cells. ``lines``: (row, cells array)."""
    cells = F.transform("cells", lambda x: F.trim(x))
    has = [F.array_contains(cells, w) for w in wanted]
    ok = has[0]
    for h in has[1:]:
        ok &= h
    found = lines.where((F.col("row") < limit) & ok).agg(F.min("row")).head()[0]
    if found is None:
        raise ValueError(f"no header row with {wanted} in the first {limit} lines")
    return found


def contract(spark: SparkSession, path: str, tenor: int, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """(date, tenor, price) of a delimited sheet with junk above its header: bad dates and numbers go, of equal dates the last line stays."""
    text = spark.read.text(path).select(F.monotonically_increasing_id().alias("row"), F.split("value", ",").alias("cells"))
    at = header_row(text)
    names = [x.strip() for x in text.where(F.col("row") == at).head()["cells"]]
    body = text.where(F.col("row") > at)
    cell = lambda name: F.trim(F.get("cells", F.lit(names.index(name))))
    parsed = body.select("row", F.to_date(F.try_to_timestamp(cell("Exchange Date"), F.lit(date_format))).alias("date"), cell("Close").try_cast("double").alias("price"))
    last = parsed.dropna(subset=["date", "price"]).groupBy("date").agg(F.max_by("price", "row").alias("price"))
    return last.select("date", F.lit(tenor).alias("tenor"), "price")


def contracts(spark: SparkSession, paths: dict[int, str]) -> tuple[DataFrame | None, list[int]]:
    """Union of the contracts whose files exist, and the tenors whose files don't."""
    out, missing = None, []
    fs = spark._jvm.org.apache.hadoop.fs
    for tenor, path in sorted(paths.items()):
        p = fs.Path(path)
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            missing.append(tenor)
            continue
        one = contract(spark, path, tenor)
        out = one if out is None else out.unionByName(one)
    return out, missing


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed, with a header; NaN becomes NULL."""
    df = spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE", nanValue="NaN")
    return df.select(*(clean(f.name).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema))


SPEC = "model_name string, model_class string, model_params map<string,string>, global_ic double, global_icir double"


def model_specs(spark: SparkSession, path: str) -> DataFrame:
    """Model files, newest first."""
    df = spark.read.schema(SPEC).json(path, multiLine=True)
    return df.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified")).orderBy(F.desc("modified"), "path")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_parquet(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write, read back, and insist on the same columns and number of rows."""
    n = df.count()
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    back = df.sparkSession.read.parquet(path)
    if sorted(back.columns) != sorted(df.columns) or back.count() != n:
        raise ValueError(f"{path} doesn't hold what was written")
    return back


def summary(df: DataFrame, date: str, *keys: str) -> DataFrame:
    """Rows, first and last date, number of dates and of each key's values."""
    return df.agg(F.count("*").alias("rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.countDistinct(date).alias("dates"), *(F.countDistinct(k).alias(f"n_{k}") for k in keys))


def long_panel(wide: DataFrame, date: str, prefix: str, value: str = "price") -> DataFrame:
    """Columns ``prefix`` + number become rows (date, tenor, value)."""
    names = [n for n in wide.columns if n.startswith(prefix)]
    out = wide.unpivot([date], names, "__name", value)
    return out.select(F.col(date), F.regexp_extract("__name", r"(\d+)", 1).cast("int").alias("tenor"), value)


def wide_panel(panel: DataFrame, date: str, tenors: list[int], value: str, prefix: str) -> DataFrame:
    out = panel.groupBy(date).pivot("tenor", tenors).agg(F.first(value))
    return out.select(date, *(F.col(str(t)).alias(f"{prefix}{t}") for t in tenors))


def tenor_number(name: Column | str) -> Column:
    return F.regexp_extract(name if isinstance(name, Column) else F.col(name), r"(\d+)", 1).cast("int")
