"""Reading vector columns: batches as float64 matrices, and what counts as a vector."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenorlake.llm.common import col


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    finite = (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def prepared(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): usable vectors of the most frequent length, as floats or doubles as they come; rows without an id take no part."""
    kind = df.schema[vector].dataType.elementType.typeName()
    v = col(vector) if kind in ("float", "double") else col(vector).cast("array<double>")
    rows = df.where(usable(col(vector)) & col(key).isNotNull()).select(col(key).cast("long").alias("id"), v.alias("v"))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").head()
    return rows.where(F.size("v") == (length[0] if length else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows, in double precision."""
    values, ends = np.asarray(column.values), np.asarray(column.offsets)
    n = len(ends) - 1
    return values[ends[0] : ends[-1]].reshape(n, -1).astype(np.float64) if n else np.zeros((0, 1))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that neither squares nor their sum overflow or vanish."""
    rows = rows / np.abs(rows).max(1, keepdims=True, initial=0) if len(rows) else rows
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of unit(a) with rows of unit(b), always added in the same order, so equal vectors have equal cosines."""
    return (a * b).sum(1)


def blocks(batch: pa.RecordBatch, keys: int) -> list[tuple[int, int]]:
    """Ranges of rows with equal values in the first ``keys`` columns."""
    n = batch.num_rows
    if not n:
        return []
    change = np.zeros(n - 1, bool)
    for i in range(keys):
        change |= np.diff(np.asarray(batch.column(i)).astype(np.int64)) != 0
    cuts = np.flatnonzero(change) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True))
