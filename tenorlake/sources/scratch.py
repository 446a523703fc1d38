"""The folder for tables and files that an application needs for a while."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset: a new folder of this machine on a local master, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="tenorlake-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        folder = "file://" + made
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def own(spark: SparkSession) -> str:
    """This application's part of it."""
    return f"{root(spark)}/tenorlake/{spark.sparkContext.applicationId}"


def files(spark: SparkSession, path: str):
    """The file system of ``path``, and the path as it takes it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where
