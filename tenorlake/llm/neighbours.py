"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation is three rounds of random signs and a fast Hadamard transform
(vectors are padded with zeros to a power of two). A unit vector hashes to the
signed axis nearest to its rotation. Each of ``TABLES`` tables has two rotations
of its own, so a bucket is a pair of axes, at every size of the input. A query
looks into the ``probes`` buckets of a table with the largest sums of its two
projections; everything found there is ranked exactly, by cosine in double
precision.

All rows are indexed. The number of probes is fitted: for ``PILOT`` rows (the
smallest hashes of the id) the true neighbours among all rows are found by
comparing, in one pass, and as many probes are taken as find ``RECALL`` of
them. A query that finds fewer than ``k`` rows although there are more is
compared with all rows.

A cell holds the buckets with one first axis, in chunks of at most ``CHUNK``
vectors, so a very common vector makes more chunks, not larger tasks. A query
goes once to each chunk of the cells that it probes, with the list of second
axes, and meets only the rows of those buckets.

Defined results: vectors that are null, empty, zero, hold null or non-finite
components or are of another length than most take no part, neither do rows
without id; ties go to the smaller id; rows of one id, repeated or not, count
once, as the nearer; an empty table gives no rows; other columns are ignored,
whatever their names. (There are no texts here; a vector of any length is held whole.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tenorlake.llm.common import materialize
from tenorlake.llm.vectors import blocks, cosines, matrix, prepared, unit

TABLES, ROUNDS, PILOT, CHUNK, RECALL = 6, 3, 128, 2048, 0.975


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast transform of each row; the length is a power of two."""
    n, h = rows.shape[1], 1
    out = rows.copy()
    while h < n:
        out = out.reshape(len(rows), n // (2 * h), 2, h)
        out = np.stack([out[:, :, 0] + out[:, :, 1], out[:, :, 0] - out[:, :, 1]], 2).reshape(len(rows), n)
        h *= 2
    return out / np.sqrt(n)


class Hashes:
    def __init__(self, length: int, tables: int = TABLES, seed: int = 7):
        self.size = 1 << max(1, (length - 1).bit_length())
        self.tables, self.length = tables, length
        self.axes = 2 * self.size
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 2, ROUNDS, self.size))

    def nearness(self, units: np.ndarray, table: int, part: int) -> np.ndarray:
        """Projection on every signed axis: first the positive ones."""
        x = np.zeros((len(units), self.size))
        x[:, : self.length] = units
        for signs in self.signs[table, part]:
            x = hadamard(x * signs)
        return np.concatenate([x, -x], 1)

    def codes(self, units: np.ndarray) -> np.ndarray:
        """The two axes of each row in each table: tables x 2 x rows."""
        return np.array([[self.nearness(units, t, p).argmax(1) for p in (0, 1)] for t in range(self.tables)])

    def probes(self, units: np.ndarray, table: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """First and second axes of the ``most`` buckets of a table with the largest sums of projections: rows x most, in no order.

        With both sides sorted, the pair of the i-th and the j-th axis is exceeded by i j - 1 others, so only pairs with i j <= most are looked at.
        """
        order = [np.argsort(-self.nearness(units, table, p), axis=1, kind="stable") for p in (0, 1)]
        near = [np.take_along_axis(self.nearness(units, table, p), order[p], 1) for p in (0, 1)]
        upto = np.minimum(most // np.arange(1, min(most, self.axes) + 1), self.axes)
        i = np.repeat(np.arange(len(upto)), upto)
        j = np.arange(len(i)) - np.repeat(np.cumsum(upto) - upto, upto)
        total = near[0][:, i] + near[1][:, j]
        best = np.argpartition(-total, most - 1, axis=1)[:, :most] if most < len(i) else np.arange(len(i))[None, :].repeat(len(units), 0)
        rows = np.arange(len(units))[:, None]
        return order[0][rows, i[best]], order[1][rows, j[best]]


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's ``k`` best of different ids, ties to the smaller id."""
    order = np.lexsort((-score, ids, query))
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(query[order]) != 0) | (np.diff(ids[order]) != 0)
    order = order[first]
    order = order[np.lexsort((ids[order], -score[order], query[order]))]
    q = query[order]
    begin = np.flatnonzero(np.concatenate([[True], np.diff(q) != 0])) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
    return order[place < k]


def fit_probes(h: Hashes, rows: DataFrame, pilot: pa.Table, k: int, wanted: float = RECALL) -> int:
    """Fewest probes of each table with which the pilot rows find ``wanted`` of their true neighbours among all ``rows``."""
    asked, own = unit(matrix(pilot.column("v").combine_chunks())), pilot.column("id").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast((h, asked, own))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, asked, own = shared.value
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, h.length)))
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                ids, units = np.asarray(b.column(0).slice(at, 2048)), unit(matrix(b.column(1).slice(at, 2048)))
                near = asked @ units.T
                near[own[:, None] == ids[None, :]] = -2
                top = np.argpartition(-near, min(k, len(ids)) - 1, axis=1)[:, :k]
                q, r = np.repeat(np.arange(len(asked)), top.shape[1]), top.ravel()
                q, r = q[near[q, r] > -2], r[near[q, r] > -2]
                held = tuple(np.concatenate(x) for x in zip(held, (q, ids[r], near[q, r], units[r]), strict=True))
                held = tuple(x[_best(*held[:3], k)] for x in held)
        q, ids, score, units = held
        if len(q):
            codes = h.codes(units).transpose(2, 0, 1).reshape(len(q), -1)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids), pa.array(score), pa.array(codes.tolist(), pa.list_(pa.int32()))], names=["q", "id", "score", "codes"])

    found = rows.select("id", "v").mapInArrow(compare, "q long, id long, score double, codes array<int>")
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))
    true = found.withColumn("__place", place).where(F.col("__place") <= k).select("q", "codes").toArrow()  # at most PILOT * k rows
    if not true.num_rows:
        return 1
    q, codes = true.column("q").to_numpy(), np.array(true.column("codes").to_pylist()).reshape(-1, h.tables, 2)
    rank = np.full(len(q), h.axes**2)
    for t in range(h.tables):
        near = [h.nearness(asked, t, p) for p in (0, 1)]
        for n, (a, b) in enumerate(codes[:, t]):
            total = near[0][q[n]][:, None] + near[1][q[n]][None, :]
            rank[n] = min(rank[n], int((total > total[a, b]).sum()) + 1)
    return int(np.sort(rank)[int(np.ceil(wanted * len(rank))) - 1])


class Chunk:
    """Rows of a cell's chunk, ordered by their second axis."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        ids, units, axis = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(axis, kind="stable")
        self.ids, self.units, self.axis = ids[order], units[order], axis[order]

    def nearest(self, ids: np.ndarray, units: np.ndarray, lists: pa.ListArray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, row, cosine) of each query's best among the rows of the second axes on its list."""
        out = []
        ends, axes = np.asarray(lists.offsets), np.asarray(lists.values)
        for s in range(0, len(ids), 64):
            e = min(s + 64, len(ids))
            b = axes[ends[s] : ends[e]]
            lo, hi = np.searchsorted(self.axis, b), np.searchsorted(self.axis, b, "right")
            n = hi - lo
            who = np.repeat(np.repeat(np.arange(s, e), np.diff(ends[s : e + 1])), n)
            row = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            other = self.ids[row] != ids[who]
            who, row = who[other], row[other]
            score = np.concatenate([np.zeros(0), *(cosines(units[who[at : at + 16_384]], self.units[row[at : at + 16_384]]) for at in range(0, len(who), 16_384))])
            best = _best(who, self.ids[row], score, k)
            out.append((ids[who[best]], self.ids[row[best]], score[best]))
        return out


def _probed(rows: DataFrame, h: Hashes, probes: int, tables: int, k: int) -> DataFrame:
    """(query_id, vec_id, score) from the ``probes`` buckets of each of the first ``tables`` tables. ``rows``: (id, v, asked)."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(h)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = shared.value
        for b in batches:
            units = unit(matrix(b.column("v")))
            for t in range(tables):
                at, n = np.unique(h.nearness(units, t, 0).argmax(1) + t * h.axes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["cell", "n"])

    counted = rows.select("v").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect()  # a row for each axis of each table
    chunks = np.zeros(tables * h.axes, np.int64)
    for cell, m in counted:
        chunks[cell] = -(-m // CHUNK)
    chunks_of = spark.sparkContext.broadcast(chunks)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, chunks = shared.value, chunks_of.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                ids, units = np.asarray(b.column("id")), unit(matrix(b.column("v")))
                mixed = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
                codes, asked = h.codes(units)[:tables], np.flatnonzero(np.asarray(b.column("asked")))

                def put(cell: np.ndarray, chunk: np.ndarray, role: int, row: np.ndarray, ends: np.ndarray, axes: np.ndarray, b: pa.RecordBatch = b) -> pa.RecordBatch:
                    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(axes.astype(np.int32)))
                    at = pa.array(row)
                    return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(chunk), pa.array(np.full(len(row), role, np.int8)), b.column("id").take(at), lists, b.column("v").take(at)], names=["cell", "chunk", "role", "id", "axes", "v"])

                for t in range(tables):
                    cell = codes[t, 0] + t * h.axes
                    yield put(cell, mixed % chunks[cell], 0, np.arange(len(ids)), np.arange(len(ids) + 1), codes[t, 1])
                    for some in (asked[i : i + 64] for i in range(0, len(asked), 64)):
                        first, second = h.probes(units[some], t, min(probes, h.axes**2))
                        who = np.repeat(some, first.shape[1])
                        cell, second = first.ravel() + t * h.axes, second.ravel()
                        order = np.lexsort((cell, who))
                        who, cell, second = who[order], cell[order], second[order]
                        begin = np.flatnonzero(np.concatenate([[True], (np.diff(who) != 0) | (np.diff(cell) != 0)]))
                        lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(who)).astype(np.int32)), pa.array(second.astype(np.int32)))
                        who, cell = who[begin], cell[begin]
                        times = chunks[cell]
                        visit = np.repeat(np.arange(len(who)), times)
                        number = np.arange(len(visit)) - np.repeat(np.cumsum(times) - times, times)
                        taken = lists.take(pa.array(visit))
                        yield put(cell[visit], number, 1, who[visit], np.asarray(taken.offsets) - taken.offsets[0].as_py(), np.asarray(taken.flatten()))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, home = None, [], None
        for b in batches:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for lo, hi in blocks(b, 3):
                part = b.slice(lo, hi - lo)
                key, ids, units = (part.column(0)[0].as_py(), part.column(1)[0].as_py()), np.asarray(part.column(3)), unit(matrix(part.column(5)))
                if part.column(2)[0].as_py() == 0:  # the chunk's own come first; a batch may end among them
                    if key != at:
                        at, own, home = key, [], None
                    own.append((ids, units, np.asarray(part.column(4).flatten())))
                elif key == at:
                    home = home or Chunk(own)
                    out += home.nearest(ids, units, part.column(4), k)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    dealt = rows.select("id", "v", "asked").mapInArrow(deal, f"cell long, chunk long, role byte, id long, axes array<int>, v {rows.schema['v'].dataType.simpleString()}")
    return dealt.repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "role").mapInArrow(rank, "query_id long, vec_id long, score double")


def search(df: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): up to ``k`` nearest rows other than the query's own, for each row where ``queries`` holds (a condition on ``id``)."""
    spark = df.sparkSession
    rows = materialize(prepared(df, key, vector).withColumn("asked", F.coalesce(queries, F.lit(False))), "ann-vectors")
    pilot = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(PILOT).toArrow()
    if not pilot.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    h = Hashes(len(pilot.column("v")[0]))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    once = lambda d: d.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", place).where(F.col("rank") <= k)
    found = materialize(once(_probed(rows, h, fit_probes(h, rows, pilot, k), h.tables, k)), "ann-found")
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("id"))
    few = materialize(rows.where("asked").select("id").distinct().join(full, "id", "left_anti"), "ann-few")
    if not few.isEmpty():  # compared with all rows: the buckets of one table hold each row once
        again = rows.join(few.withColumn("__few", F.lit(True)), "id", "left").withColumn("asked", F.col("asked") & F.col("__few").isNotNull())
        rest = once(_probed(materialize(again.select("id", "v", "asked"), "ann-again"), h, h.axes**2, 1, k))
        found = found.join(few, found["query_id"] == few["id"], "left_anti").unionByName(rest)
    return found.select("query_id", "rank", "vec_id", "score")
