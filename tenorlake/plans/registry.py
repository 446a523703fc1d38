"""Registry of named queries with their SQL oracles.

A query's doubles are rounded to 6 places, in both forms, and 0.0 is added so
that there is no negative zero.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    return df.select(*((F.round(n, 6) + F.lit(0.0)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes))


def query(sql: str | None = None, name: str | None = None):
    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
        if sql:
            ORACLES[key] = sql
        return fn

    return add


def fin(ctes: str, keys: str, doubles: str, body: str) -> str:
    """SQL: ``keys`` as they are and ``doubles`` rounded, of ``body`` after ``ctes``."""
    cols = [k.strip() for k in keys.split(",") if k.strip()] + [f"round({d.strip()}, 6) + 0.0 AS {d.strip()}" for d in doubles.split(",") if d.strip()]
    return (f"WITH {ctes} " if ctes else "") + f"SELECT {', '.join(cols)} FROM ({body})"


# --- carriers, as tenorlake.sources.tables makes them

PANEL = "panel AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_linenumber AS tenor, avg(l_extendedprice / l_quantity) AS price FROM lineitem GROUP BY 1, 2)"
RET = PANEL + ", ret AS (SELECT * FROM (SELECT date, tenor, ln(price / lag(price) OVER (PARTITION BY tenor ORDER BY date)) AS r FROM panel) WHERE r IS NOT NULL)"
EPS = RET + ", eps AS (SELECT date, tenor, r - avg(r) OVER (PARTITION BY date) AS eps FROM ret)"
DAILY = "daily AS (SELECT date, greatest(150 - x, 0.0) AS HDD, greatest(x - 150, 0.0) AS CDD FROM (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 1000 AS x FROM orders GROUP BY 1))"
STOCK = (
    "wk AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) + 4 AS friday, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END * o_totalprice) / 1e6 AS flow FROM orders GROUP BY 1), "
    "lv AS (SELECT friday, sum(flow) OVER (ORDER BY friday) AS Storage FROM wk), "
    "stock AS (SELECT d.date, lv.Storage FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) d JOIN lv ON lv.friday = d.date - CAST((isodow(d.date) - 1 + 3) % 7 AS INTEGER))"
)
ANN = STOCK + (
    ", a0 AS (SELECT date AS ann_date, Storage AS storage_bcf, Storage - lag(Storage) OVER (ORDER BY date) AS delta_storage_bcf FROM stock), "
    "a1 AS (SELECT *, lag(ann_date) OVER (ORDER BY ann_date) AS ann_prev FROM a0 WHERE delta_storage_bcf <> 0), "
    "ann AS (SELECT *, ann_date - ann_prev AS window_days FROM a1 WHERE ann_prev IS NOT NULL)"
)
INTRA = "intra AS (SELECT CAST(date_trunc('hour', ts) AS DATE) AS quote_date, strftime(date_trunc('hour', ts), '%H:%M') AS quote_time, event_type AS option_type, CAST(user_id % 8 AS VARCHAR) AS mnes, avg(value) AS y FROM events GROUP BY 1, 2, 3, 4)"
PRED = EPS + ", pred AS (SELECT * FROM (SELECT date, tenor, eps AS y_true, -lag(eps) OVER (PARTITION BY tenor ORDER BY date) AS y_pred FROM eps) WHERE y_pred IS NOT NULL)"
IC = PRED + (
    ", rk AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY y_pred) + (count(*) OVER (PARTITION BY date, y_pred) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY y_true) + (count(*) OVER (PARTITION BY date, y_true) - 1) / 2.0 AS b FROM pred), "
    "ic AS (SELECT date, count(*) AS n, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS ic FROM rk GROUP BY date HAVING count(*) >= 4)"
)
