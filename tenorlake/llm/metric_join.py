"""Embedding near-duplicates: an exact range join in the metric space of unit vectors.

Cosine >= c is a chord of at most r = sqrt(2 - 2 c). Pivots, far from each
other, split the vectors into cells of the nearest pivot. If x (of cell i) and
y (of cell j) are within r, then by the triangle inequality
d(x, p_j) - d(x, p_i) <= 2 r, and, sharper, x is within r of the plane halfway
between the two pivots. So x is also sent, as a visitor, to each cell with a
smaller number that is so near, and each cell is joined by itself: its own
vectors with each other and with its visitors. Every pair meets exactly once.

A cell is cut into rings by the distance to its pivot, chunks of at most
``CHUNK`` vectors. By the triangle inequality again, what is within r of x lies
in the rings from d(x, p) - r to d(x, p) + r, so a visitor goes to those only,
and a vector of the cell itself to the rings below its own that reach up to
d - r. A ring that can't be cut further by distance is dealt by hash. A chunk
returns counts per vector and a spanning forest of its links, never all pairs.
Products are screened in single precision; those near the threshold are decided
in double precision.

Equal vectors are one class with a multiplicity, known by a hash of 64 bits.
Defined results: vectors that are null, empty, zero, hold null or non-finite
components or are of another length than most link with nothing and are
components of their own, as are rows without id; repeated rows count each; an
empty table gives no rows; other columns are ignored, whatever their names.
(There are no texts here; a vector of any length is held whole. Ties: a cosine
of exactly the threshold links; of equal nearest pivots the first is the cell.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenorlake.llm.common import col, materialize
from tenorlake.llm.components import components
from tenorlake.llm.vectors import blocks, cosines, matrix, prepared, unit, usable

CHUNK = 1024
PIVOTS = 2048  # at most, one for each 2 * CHUNK vectors; sampled from at most 4 * PIVOTS
BINS = 64  # of the distance to a pivot; rings are made of them
SLACK = 1e-6
SCREEN = 1e-4  # more than single precision can be off for up to a thousand components


def choose_pivots(sample: np.ndarray, wanted: int, radius: float) -> np.ndarray:
    """The first ``wanted`` of the sample that lie farther than 2 r from all chosen before."""
    out = np.zeros((0, sample.shape[1]))
    for x in sample:
        if len(out) < wanted and (np.sqrt(np.maximum(2 - 2 * (out @ x), 0)) > 2 * radius).all():
            out = np.concatenate([out, x[None, :]])
    return out


def cells(units: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own cell of each row, which smaller cells it visits and the distances to their pivots (rows x cells)."""
    dot = units @ pivots.T
    mine = dot.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 1e-30))
    lead = dot[np.arange(len(units)), mine][:, None] - dot  # half of d(x, p_j)^2 - d(x, p_i)^2
    near = lead / apart[mine] <= radius + SLACK
    far = np.sqrt(np.maximum(2 - 2 * dot, 0))
    near &= far - far[np.arange(len(units)), mine][:, None] <= 2 * radius + SLACK
    return mine, near & (np.arange(len(pivots))[None, :] < mine[:, None]), far


def _bin(distance: np.ndarray) -> np.ndarray:
    return np.clip((distance * (BINS / 2)).astype(np.int64), 0, BINS - 1)


class Rings:
    """The chunks of each cell: those of a bin of distances are ``first`` to ``first + width - 1``."""

    def __init__(self, counts: np.ndarray) -> None:
        """``counts``: vectors by cell and bin."""
        self.first, self.width = np.zeros(counts.shape, np.int64), np.ones(counts.shape, np.int64)
        self.total = np.zeros(len(counts), np.int64)
        for c, row in enumerate(counts.tolist()):
            at = held = 0
            for b, n in enumerate(row):
                if held and held + n > CHUNK:
                    at, held = at + 1, 0
                self.first[c, b] = at
                if n > CHUNK:  # held is 0
                    self.width[c, b] = -(-n // CHUNK)
                    at += int(self.width[c, b])
                else:
                    held += n
            self.total[c] = at + (held > 0)

    def own(self, cell: np.ndarray, distance: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        b = _bin(distance)
        return self.first[cell, b] + mixed % self.width[cell, b]

    def reach(self, cell: np.ndarray, distance: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """The first chunk, and one after the last, of the rings within ``radius`` of a distance."""
        low, high = _bin(distance - radius - SLACK), _bin(distance + radius + SLACK)
        return self.first[cell, low], np.minimum(self.first[cell, high] + self.width[cell, high], self.total[cell])


def links(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n): for each class with links (a, null, vectors linked in one chunk), and links (a, b, null) that connect all linked classes.

    ``classes``: (node, v, copies), stored, a row for each distinct vector.
    """
    spark = classes.sparkSession
    radius = float(np.sqrt(2 - 2 * threshold))
    n = classes.count()
    out = "a long, b long, n long"
    if not n:
        return spark.createDataFrame([], out)
    wanted = int(np.clip(n // (2 * CHUNK), 1, PIVOTS))
    sample = classes.select("node", "v").orderBy("node").limit(4 * wanted).toArrow()
    pivots = choose_pivots(unit(matrix(sample.column("v").combine_chunks())), wanted, radius)
    shared = spark.sparkContext.broadcast(pivots)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dot = unit(matrix(b.column("v"))) @ shared.value.T
            mine = dot.argmax(1)
            at, m = np.unique(mine * BINS + _bin(np.sqrt(np.maximum(2 - 2 * dot[np.arange(len(dot)), mine], 0))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(m)], names=["ring", "m"])

    counted = classes.select("v").mapInArrow(count, "ring long, m long").groupBy("ring").agg(F.sum("m")).collect()  # at most a row for each pivot and bin
    counts = np.zeros(len(pivots) * BINS, np.int64)
    for c, m in counted:
        counts[c] = m
    rings_of = spark.sparkContext.broadcast(Rings(counts.reshape(-1, BINS)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings = rings_of.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                node, units = np.asarray(b.column("node")), unit(matrix(b.column("v")))
                mine, visits, far = cells(units, shared.value, radius)
                every = np.arange(len(node))
                mixed = ((node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
                chunk = rings.own(mine, far[every, mine], mixed)
                who, cell = np.nonzero(visits)
                who, cell = np.concatenate([every, who]), np.concatenate([mine, cell])
                low, high = rings.reach(cell, far[who, cell], radius)
                high[: len(node)] = chunk  # in the own cell: earlier chunks only
                times = np.maximum(high - low, 0)
                to, at_cell = np.repeat(who, times), np.repeat(cell, times)
                at_chunk = np.repeat(low, times) + np.arange(len(to)) - np.repeat(np.cumsum(times) - times, times)
                take = np.concatenate([every, to])
                role = np.repeat(np.array([0, 1], np.int8), [len(node), len(to)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([mine, at_cell])), pa.array(np.concatenate([chunk, at_chunk])), pa.array(role), *(b.column(c).take(pa.array(take)) for c in ("node", "copies", "v"))], names=["cell", "chunk", "role", "node", "copies", "v"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        node = copies = units = parent = None

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for b in batches:
            rows: list[tuple] = []

            def add(a, other, n, rows=rows):
                rows.append((np.asarray(a, np.int64), np.asarray(other, np.int64), np.asarray(n, np.int64)))

            for lo, hi in blocks(b, 3):
                part = b.slice(lo, hi - lo)
                key, own = (part.column(0)[0].as_py(), part.column(1)[0].as_py()), part.column(2)[0].as_py() == 0
                g_node, g_copies, g_units = np.asarray(part.column(3)), np.asarray(part.column(4)), unit(matrix(part.column(5)))
                if own and key != at:
                    at, node, copies, units, parent = key, g_node[:0], g_copies[:0], g_units[:0], []
                if key != at:
                    continue
                for s in range(0, len(g_node), 512):
                    q_node, q_copies, q = g_node[s : s + 512], g_copies[s : s + 512], g_units[s : s + 512]
                    if own:  # compared with those before and among themselves, each pair once
                        node, copies, units = np.concatenate([node, q_node]), np.concatenate([copies, q_copies]), np.concatenate([units, q])
                        parent += range(len(parent), len(node))
                    near = q.astype(np.float32) @ units.astype(np.float32).T
                    hit = near >= threshold
                    i, j = np.nonzero(np.abs(near - threshold) <= SCREEN)
                    for k in range(0, len(i), 4096):
                        x, y = i[k : k + 4096], j[k : k + 4096]
                        hit[x, y] = cosines(q[x], units[y]) >= threshold
                    if own:
                        first = len(node) - len(q_node)
                        hit &= np.arange(len(node))[None, :] < (first + np.arange(len(q_node)))[:, None]
                    some = hit.any(1)
                    if not some.any():
                        continue
                    add(q_node[some], np.full(some.sum(), 0), (hit[some] * copies[None, :]).sum(1))
                    back = (hit * q_copies[:, None]).sum(0)
                    add(node[back > 0], np.full((back > 0).sum(), 0), back[back > 0])
                    # a spanning forest: each guest with one of its partners, partners with each other where not yet joined
                    new: list[tuple[int, int]] = []
                    for x in np.flatnonzero(some):
                        partners = np.flatnonzero(hit[x]).tolist()
                        if own:
                            partners.append(first + int(x))
                        else:
                            new.append((int(q_node[x]), int(node[partners[0]])))
                        r = root(partners[0])
                        for y in partners[1:]:
                            if parent[y] != r and (z := root(y)) != r:
                                parent[z] = r
                                new.append((int(node[partners[0]]), int(node[y])))
                    if new:
                        ends = np.array(new, np.int64)
                        add(ends[:, 0], ends[:, 1], np.full(len(new), -1))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], names=["a", "b", "n"])

    kind = classes.schema["v"].dataType.simpleString()
    dealt = classes.select("node", "copies", "v").mapInArrow(deal, f"cell long, chunk long, role byte, node long, copies long, v {kind}")
    met = dealt.repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "role").mapInArrow(join, out)
    return met.select("a", F.when(F.col("n") < 0, F.col("b")).alias("b"), F.when(F.col("n") >= 0, F.col("n")).alias("n"))


def near_duplicates(df: DataFrame, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per row: key, n_links, component_id (smallest key reachable by links), kept (key = component_id)."""
    node = F.xxhash64("v")
    rows = materialize(prepared(df, key, vector).withColumn("node", node), "metric-vectors")
    classes = materialize(rows.groupBy("node", "v").agg(F.count("*").alias("copies"), F.min("id").alias("first")), "metric-classes")
    met = materialize(links(classes, threshold), "metric-links")
    roots = components(met.where("b is not null").select("a", "b")).select(F.col("node").alias("__node"), "root")
    linked = met.where("n is not null").groupBy(F.col("a").alias("__a")).agg(F.sum("n").alias("others"))
    every = classes.select("node", "copies", "first").join(roots, F.col("node") == F.col("__node"), "left").join(linked, F.col("node") == F.col("__a"), "left")
    every = every.select("node", "first", F.coalesce("root", "node").alias("root"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    every = materialize(every, "metric-found")
    least = every.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = every.join(least, "root").select("node", "n_links", "component_id")
    # Vectors of one id may differ, so rows are matched by what they hold.
    own = df.select(col(key).cast("long").alias("__id"), (col(vector) if df.schema[vector].dataType.elementType.typeName() in ("float", "double") else col(vector).cast("array<double>")).alias("v"))
    length = rows.select(F.size("v").alias("n")).limit(1).collect()
    takes = usable(F.col("v")) & F.col("__id").isNotNull() & (F.size("v") == (length[0][0] if length else 0))
    own = own.select("__id", F.when(takes, F.xxhash64("v")).alias("__own"))
    out = own.join(of_class, F.col("__own") == F.col("node"), "left")
    component = F.coalesce("component_id", "__id")
    return out.select(F.col("__id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("__id")).alias("kept"))
