"""Streams of events: bars, sessions, duplicates, trailing features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _watermarked(events: DataFrame, late: str | None) -> DataFrame:
    """None: the stream has its watermark."""
    return events.withWatermark("ts", late) if late else events


def bars(events: DataFrame, width: str = "5 minutes", late: str | None = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, end, event_type, n, total, mean, low, high); rows later than ``late`` are dropped on a stream."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = _watermarked(events, late).groupBy(w.alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total", "mean", "low", "high")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    """(user_id, start, end, n, total)."""
    s = F.session_window("ts", gap)
    return _watermarked(events, late).groupBy(s.alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def once(events: DataFrame, key: str = "event_id", late: str | None = "10 minutes") -> DataFrame:
    return _watermarked(events, late).dropDuplicatesWithinWatermark([key])


def trailing_mean(events: DataFrame, size: int = 20) -> DataFrame:
    """(user_id, ts, value, trailing): mean of the user's last ``size`` values up to each event, kept as state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = np.array(state.get[0] if state.exists else [], float)
        rows = pd.concat(list(batches)).sort_values(["ts", "value"])
        every = np.concatenate([held, rows.value.to_numpy(float)])
        views = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(size - 1, np.nan), every]), size)[len(held) :]
        state.update((every[-size:].tolist(),))
        yield pd.DataFrame({"user_id": key[0], "ts": rows.ts, "value": rows.value, "trailing": np.nanmean(views, axis=1)})

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, ts timestamp, value double, trailing double", "held array<double>", "append", "NoTimeout")
