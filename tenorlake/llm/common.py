"""Scratch tables and small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenorlake.sources import scratch


def tables(spark: SparkSession) -> set[str]:
    """Names of this application's scratch tables."""
    fs, path = scratch.files(spark, scratch.own(spark))
    return {f.getPath().getName() for f in fs.listStatus(path)} if fs.exists(path) else set()


def release(spark: SparkSession, *keep: DataFrame, but: set[str] = frozenset()) -> None:
    """Delete this application's scratch tables, but those named and those that ``keep`` read. Other results that were not written yet can't be computed afterwards."""
    fs, path = scratch.files(spark, scratch.own(spark))
    held = {part for df in keep for f in df.inputFiles() for part in f.split("/")[-2:]}
    for name in tables(spark) - but - held:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path, name), True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table below the shared scratch folder and read it back.

    Cuts the lineage, survives lost executors, and gives the planner the real
    size, so that a broadcast is chosen only for a side known to be small.
    """
    spark = df.sparkSession
    path = f"{scratch.own(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> list[str]:
    """Columns of ``df`` but those called like one of ``names`` (case-insensitively)."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def unused(df: DataFrame) -> str:
    """A prefix that no column of ``df`` begins with, for columns of our own beside them."""
    prefix = "__t"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "t"
    return prefix + "_"


def col(name: str):
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")
