"""SimHash near-duplicates: exact linking of fingerprints in tiles.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a shingle
is ``width`` words joined by single spaces. Fewer words make one shingle; no
word (null, empty or blank text) makes fingerprint 0, linked like any other.

``cluster`` links 64-bit fingerprints that differ in at most ``radius`` bits. A
fingerprint's tile is the population counts of its four 16-bit blocks. The
counts of linked fingerprints differ by at most ``radius`` in sum; all other
tile pairs are skipped.

``deduplicate`` links documents whose sets of shingles (repeats don't count)
have a Jaccard similarity of 0.8 or more, counted exactly. Fingerprints of the
sets, 256 bits wide, find the candidates, in a radius that a pair of just that
similarity exceeds by chance alone (``reach``); at that radius population
counts exclude no tile pair, but the sizes of such sets have a ratio of 0.8 or
more, so the tile is the logarithm of the size. The comparison of fingerprints
returns only the sets that have a candidate, never the pairs. Those sets are
dealt to tiles again, with their shingles, and candidates are counted there
against an index of the tile's shingles.

In both, distinct fingerprints go to their own tile and, as visitors, to the
neighbouring tiles with a smaller number, and are compared there with
exclusive-or and bit counts in numpy. Tiles are cut into chunks and visitors
into slices, so no task holds more than a chunk and a slice. Equal
fingerprints are grouped before, hence large groups of copies cost nothing. A
task returns a spanning forest of its links.

Defined results: rows of one key are rows of their own (``cluster`` gives both
the same component; ``deduplicate`` keeps one); equal texts are always linked;
null keys are never a component's id; very long texts are hashed whole, in
parts of bounded memory; an empty table gives an empty one; other columns stay
in ``deduplicate`` whatever their names, and ``cluster`` returns none.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenorlake.llm.common import col, materialize, unused
from tenorlake.llm.components import components

CHUNK, LEAST = 32_768, 1024  # fingerprints of a tile's chunk, and visitors of a slice: a 16th of all, within these bounds
SHINGLES = 1 << 20  # shingles that a chunk or a slice holds, if they are dealt too
SEED = 42
SIMILARITY = 0.8
WIDE = 4  # words of 64 bits


def _shingles(text: bytes, width: int) -> list[int]:
    """bytes.lower and bytes.split know ASCII only: A-Z, and \\x20 with \\x09-\\x0D."""
    words = text.lower().split()
    if not words:
        return []
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [h(b" ".join(words), SEED)]
    return [h(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(width)), strict=False)]


def _widen(h: np.ndarray, word: int) -> np.ndarray:
    """Word 0 is the hash itself; the others mix it anew."""
    if word:
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(word * 0xD1B54A32D192ED03 % 2**64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return h


def fingerprint(text: bytes | None, width: int = 3, words: int = 1) -> tuple[list[int], int]:
    """Unsigned words of the fingerprint and the number of shingles; a bit is 1 if it is set in over half the hashes."""
    hashes = _shingles(text, width) if text else []
    return _print(hashes, words), len(hashes)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    return np.unique(np.array(_shingles(text, width) if text else [], np.uint64))


def _print(hashes: list[int] | np.ndarray, words: int) -> list[int]:
    if not len(hashes):
        return [0] * words
    counts = np.zeros((words, 64), np.int64)
    for at in range(0, len(hashes), 8192):  # bounded memory for very long texts
        part = np.array(hashes[at : at + 8192], np.uint64)
        for w in range(words):
            bits = np.unpackbits(_widen(part, w).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[w] += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * counts > len(hashes), axis=1, bitorder="little").view(np.uint64)
    return packed[:, 0].tolist()


def fingerprints(df: DataFrame, text: str = "text", width: int = 3, words: int = 1) -> DataFrame:
    """``df`` without ``text``, with ``p0`` to ``p{words-1}`` (signed longs) and ``shingles``."""
    keep = [c for c in df.columns if c != text]
    made = [f"p{i}" for i in range(words)]
    schema = df.select(*(col(c) for c in keep), *(F.lit(0).cast("long").alias(c) for c in [*made, "shingles"])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [fingerprint(t.as_py(), width, words) for t in b.column(text).cast(pa.binary())]
            prints = np.array([x for x, _ in out], np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(np.ascontiguousarray(prints[:, i])) for i in range(words)), pa.array([n for _, n in out], pa.int64())], names=[*keep, *made, "shingles"])

    return df.select(*(col(c) for c in [*keep, text])).mapInArrow(run, schema)


_PLACE = np.array([17**3, 17**2, 17, 1])


def _around(radius: int) -> np.ndarray:
    """All differences of four block counts with at most ``radius`` in sum."""
    span = np.arange(-radius, radius + 1)
    every = np.stack(np.meshgrid(span, span, span, span, indexing="ij"), -1).reshape(-1, 4)
    return every[np.abs(every).sum(1) <= radius]


def set_fingerprints(df: DataFrame, text: str, width: int, words: int) -> DataFrame:
    """``df`` without ``text``, with ``node`` (a hash of the set of shingles), ``p0`` to ``p{words-1}`` and ``shingles``, of sets."""
    keep = [c for c in df.columns if c != text]
    made = ["node", *(f"p{i}" for i in range(words)), "shingles"]
    schema = df.select(*(col(c) for c in keep), *(F.lit(0).cast("long").alias(c) for c in made)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = (shingle_set(t.as_py(), width) for t in b.column(text).cast(pa.binary()))
            out = np.array([[xxhash.xxh64_intdigest(s.tobytes(), SEED), *_print(s, words), len(s)] for s in sets], np.uint64).reshape(-1, words + 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(np.ascontiguousarray(out[:, i])) for i in range(words + 2))], names=[*keep, *made])

    return df.select(*(col(c) for c in [*keep, text])).mapInArrow(run, schema)


def reach(similarity: float, bits: int) -> int:
    """Bits in which fingerprints of two sets of that Jaccard similarity differ: the expected number and 4.5 deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return min(bits, math.floor(bits * p + 4.5 * math.sqrt(bits * p * (1 - p))))


class ByCounts:
    """Tiles by population counts of four 16-bit blocks."""

    size = 17**4

    def __init__(self, radius: int) -> None:
        self.steps = _around(radius)

    def tile(self, prints: np.ndarray, _: np.ndarray) -> np.ndarray:
        return np.bitwise_count(np.ascontiguousarray(prints[:, 0]).view(np.uint16).reshape(-1, 4)).astype(np.int64) @ _PLACE

    def visits(self, mine: np.ndarray) -> np.ndarray:
        """The tiles with a smaller number that a fingerprint of a tile visits, -1 for none."""
        there = (mine[:, None] // _PLACE % 17)[:, None, :] + self.steps[None]
        to = np.where(((there >= 0) & (there <= 16)).all(2), there @ _PLACE, -1)
        return np.where(to < mine[:, None], to, -1)


class BySize:
    """Tiles by the logarithm of the number of shingles, ``steps`` for a ratio of 1 / similarity: sizes in that ratio are at most ``steps`` tiles apart."""

    size = 2048

    def __init__(self, similarity: float, steps: int = 4) -> None:
        self.steps, self.base = steps, -math.log(similarity) / steps

    def tile(self, _: np.ndarray, shingles: np.ndarray) -> np.ndarray:
        return np.floor(np.log(np.maximum(shingles, 1)) / self.base + 1e-9).astype(np.int64) + (shingles > 0)

    def visits(self, mine: np.ndarray) -> np.ndarray:
        to = mine[:, None] - np.arange(1, self.steps + 1)[None, :]
        return np.where((mine > 0)[:, None] & (to > 0), to, -1)


class Home:
    """A chunk's fingerprints, with the labels of what its links have joined, and an index of its shingles if there are some."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]], sets: list[np.ndarray] | None) -> None:
        self.node, prints, self.shingles = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.prints = prints
        self.columns = [np.ascontiguousarray(prints[:, w]) for w in range(prints.shape[1])]
        self.label, self.flagged = np.arange(len(self.node)), np.zeros(len(self.node), bool)
        if sets is not None:
            every = np.concatenate([np.zeros(0, np.uint64), *sets])
            order = np.argsort(every, kind="stable")
            self.known, first = np.unique(every[order], return_index=True)
            self.bounds = np.append(first, len(every))
            self.owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order]

    def near(self, guests: tuple, screen: int, radius: int, ratio: float) -> Iterator[tuple[int, np.ndarray]]:
        """Places of guests that are linked, and of what they are linked to in the chunk.

        Of ``radius`` differing bits some word has at most ``radius // words``; pairs
        in which no word differs in at most ``screen`` bits are set aside unseen.
        """
        g_node, g_prints, g_shingles = guests
        for at in range(0, len(g_node), 16):  # 16 rows of a chunk's differences stay in the processor's cache
            few = g_prints[at : at + 16]
            seen = np.zeros((len(few), len(self.node)), bool)
            for w, column in enumerate(self.columns):
                seen |= np.bitwise_count(few[:, w][:, None] ^ column[None, :]) <= screen
            g, h = np.divmod(np.flatnonzero(seen), max(len(self.node), 1))
            g += at
            if g_prints.shape[1] > 1:
                ok = np.bitwise_count(g_prints[g] ^ self.prints[h]).sum(1, dtype=np.int64) <= radius
                a, b = g_shingles[g], self.shingles[h]
                ok &= np.minimum(a, b) >= ratio * np.maximum(a, b) - 1e-9
                g, h = g[ok], h[ok]
            ok = g_node[g] != self.node[h]
            g, h = g[ok], h[ok]
            cuts = np.flatnonzero(np.diff(g)) + 1
            if len(g):
                yield from zip(g[[0, *cuts]].tolist(), np.split(h, cuts), strict=True)

    def common(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of shingles that a set has in common with each set of the chunk."""
        at = np.searchsorted(self.known, hashes)
        at = at[(at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == hashes)] if len(self.known) else at[:0]
        lo, n = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        rows = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.owner[rows], minlength=len(self.node))

    def join(self, at: np.ndarray) -> np.ndarray:
        """Join what a guest is linked to; one place of each part that wasn't joined before."""
        labels, first = np.unique(self.label[at], return_index=True)
        if len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels[0]
        return at[first]


def links(prints: DataFrame, words: int, tiling: ByCounts | BySize, screen: int, radius: int, ratio: float = 0.0, only_ends: bool = False) -> DataFrame:
    """(a, b): links between different nodes, as spanning forests per task; all linked pairs are connected by the result.

    ``prints``: (node, p0.., shingles), a row for each distinct node, stored. With
    a column ``hashes`` (the set, sorted) links need that Jaccard ``ratio`` too,
    counted exactly. ``only_ends``: (a, null) instead, for every node that has a link, once or more.
    """
    if screen < radius // words:
        raise ValueError(f"a screen of {screen} bits a word would lose pairs within {radius} bits")
    spark = prints.sparkSession
    names = [f"p{i}" for i in range(words)]
    whole = "hashes" in prints.columns
    ends = ["shingles", "hashes"] if whole else ["shingles"]
    rows = prints.select("node", *names, *ends)

    def read(b: pa.RecordBatch, first: int) -> tuple[np.ndarray, ...]:
        cols = [np.asarray(b.column(i)) for i in range(first, first + words + 2)]
        return cols[0], np.stack([c.view(np.uint64) for c in cols[1 : words + 1]], 1), cols[words + 1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros(tiling.size, np.int64), np.zeros(tiling.size, np.int64)
        for b in batches:
            _, p, s = read(b, 0)
            np.add.at(total, t := tiling.tile(p, s), 1)
            np.add.at(weight, t, s)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at]), pa.array(weight[at])], names=["t", "n", "w"])

    counted = rows.mapInArrow(count, "t long, n long, w long").groupBy("t").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).collect()  # at most tiling.size rows
    tiles, number, weight = (np.array(x, np.int64) for x in zip(*counted, strict=True)) if counted else (np.zeros(0, np.int64),) * 3
    grain = min(CHUNK, max(LEAST, int(number.sum()) // 16))
    chunks, slices = np.zeros(tiling.size + 1, np.int64), np.zeros(tiling.size + 1, np.int64)  # the last entries are for no tile
    parts = lambda n, w: np.maximum(-(-n // grain), -(-w // SHINGLES) if whole else 0)
    chunks[tiles] = parts(number, weight)
    comes = tiling.visits(tiles)
    guests = np.zeros((2, tiling.size + 1), np.int64)
    for k, x in enumerate((number, weight)):
        np.add.at(guests[k], comes, x[:, None])
        guests[k][tiles] += np.where(chunks[tiles] > 1, x, 0)
    slices[tiles] = np.maximum(1, parts(*guests[:, tiles]))
    shared = spark.sparkContext.broadcast((chunks, slices))  # two numbers for each tile

    def spread(limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and 0 to limit - 1, for all."""
        row, at = np.nonzero(limit > 0)
        times = limit[row, at]
        return np.repeat(row, times), np.repeat(at, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, slices = shared.value
        for big in batches:
            for b in (big.slice(at, 512 if whole else 4096) for at in range(0, big.num_rows, 512 if whole else 4096)):
                node, p, s = read(b, 0)
                mine = tiling.tile(p, s)
                mixed = node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                chunk = ((mixed >> np.uint64(33)) % chunks[mine].astype(np.uint64)).astype(np.int64)
                # own chunk, in all its slices; as a visitor in smaller chunks of the own tile, and in all chunks of the tiles to visit
                home, _, home_slice = spread(slices[mine][:, None])
                to = np.concatenate([mine[:, None], tiling.visits(mine)], 1)
                row, at, c = spread(np.concatenate([chunk[:, None], chunks[to[:, 1:]]], 1))
                t = to[row, at]
                slice_ = ((mixed[row] & np.uint64(0xFFFFFFFF)) % slices[t].astype(np.uint64)).astype(np.int64)
                role = np.repeat(np.array([0, 1], np.int8), [len(home), len(row)])
                keys = [np.concatenate([mine[home], t]), np.concatenate([chunk[home], c]), np.concatenate([home_slice, slice_]), role]
                every = pa.array(np.concatenate([home, row]))
                yield pa.RecordBatch.from_arrays([*map(pa.array, keys), *(b.column(i).take(every) for i in range(words + 1 + len(ends)))], names=["tile", "chunk", "slice", "role", "node", *names, *ends])

    def found(home: Home, part: tuple, sets: list[np.ndarray] | None) -> Iterator[tuple[int, int | None]]:
        for g, at in home.near(part, screen, radius, ratio):
            node = int(part[0][g])
            if only_ends:
                new = at[~home.flagged[at]]
                home.flagged[new] = True
                yield from ((n, None) for n in (node, *home.node[new].tolist()))
                continue
            if sets is not None:
                both = home.common(sets[g])[at]
                at = at[both >= ratio * (home.shingles[at] + part[2][g] - both) - 1e-9]
            if len(at):
                yield from ((node, b) for b in home.node[home.join(at)].tolist())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, home, waiting = None, None, []
        for b in batches:
            keys = np.stack([np.asarray(b.column(i)).astype(np.int64) for i in range(4)], 1)
            every = read(b, 4)
            held = [np.frombuffer(x, np.uint64) for x in b.column(words + 6).to_pylist()] if whole else None
            cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1
            pairs: list[tuple[int, int | None]] = []
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if lo == hi:
                    continue
                key, part = tuple(keys[lo, :3]), tuple(x[lo:hi] for x in every)
                sets = held[lo:hi] if whole else None
                if key != at:
                    pairs += own(waiting, at, found)
                    at, home, waiting = key, None, []
                if keys[lo, 3] == 0:  # the tile's own come first; a batch may end among them
                    waiting.append((part, sets))
                    continue
                if home is None:
                    home = gathered(waiting)
                    pairs += own(waiting, at, found, home)
                    waiting = []
                if home is not None:
                    pairs += found(home, part, sets)
            yield _links(pairs)
        yield _links(list(own(waiting, at, found)))

    def gathered(waiting: list) -> Home | None:
        return Home([p for p, _ in waiting], [x for _, s in waiting for x in s] if whole else None) if waiting else None

    def own(waiting: list, at: tuple | None, found: Callable, home: Home | None = None) -> Iterator[tuple[int, int | None]]:
        """Links among the chunk's own, looked for in its first slice."""
        if waiting and at[2] == 0:
            home = home or gathered(waiting)
            for part, sets in waiting:
                yield from found(home, part, sets)

    dealt = rows.mapInArrow(deal, ", ".join(["tile long, chunk long, slice long, role byte, node long", *(f"{n} {'binary' if n == 'hashes' else 'long'}" for n in [*names, *ends])]))
    return dealt.repartition("tile", "chunk", "slice").sortWithinPartitions("tile", "chunk", "slice", "role").mapInArrow(compare, "a long, b long")


def _links(pairs: list[tuple[int, int | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _firsts(prints: DataFrame, key: str, words: int, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, first): every distinct node with the smallest ``key`` of its component."""
    names = [f"p{i}" for i in range(words)]
    once = materialize(prints.groupBy("node").agg(F.min(key).alias("first"), *(F.first(n).alias(n) for n in names), F.first("shingles").alias("shingles")), "simhash-distinct")
    roots = materialize(components(linked(once)), "simhash-roots").withColumnRenamed("node", "__node")
    rooted = once.join(roots, F.col("node") == F.col("__node"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return rooted.select("node", "root").join(least, "root").select("node", "first")


def cluster(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 2, width: int = 3) -> DataFrame:
    """One row per document: key, fingerprint (16 hex digits), component_id (smallest key of its component; null keys are no candidates)."""
    made = fingerprints(docs.select(col(key).alias(key), col(text).alias("__text")), "__text", width)
    prints = materialize(made.withColumn("node", F.col("p0")), "simhash-prints")
    first = _firsts(prints, key, 1, lambda once: links(once, 1, ByCounts(radius), radius, radius))
    # hex() of a long is its unsigned form
    return prints.join(first, "node").select(col(key), F.lpad(F.lower(F.hex("p0")), 16, "0").alias("fingerprint"), F.col("first").alias("component_id"))


def _sets(df: DataFrame, text: str, width: int) -> DataFrame:
    """``df`` with ``text`` replaced by ``hashes``: its set of shingles, sorted."""
    keep = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(at, 512) for at in range(0, big.num_rows, 512)):
                sets = [shingle_set(t.as_py(), width).tobytes() for t in b.column(text).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(sets, pa.binary())], names=[*keep, "hashes"])

    schema = df.select(*keep, F.lit(b"").alias("hashes")).schema
    return df.select(*keep, text).mapInArrow(run, schema)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, width: int = 5) -> DataFrame:
    """Columns of ``docs``; of each component of near-duplicates the row with the smallest key stays (null keys last, one row of equal ones)."""
    radius = reach(similarity, 64 * WIDE)
    names = [f"p{i}" for i in range(WIDE)]
    row = unused(docs) + "row"
    rows = materialize(docs.select(*(col(c) for c in docs.columns), F.monotonically_increasing_id().alias(row)), "simhash-rows")
    made = set_fingerprints(rows.select(F.col(row).alias("__row"), col(key).alias("__key"), col(text).alias("__text")), "__text", width, WIDE)
    order = F.struct(F.col("__key").isNull().alias("n"), F.col("__key").alias("k"), F.col("__row").alias("r"))
    prints = materialize(made.select("node", order.alias("__order"), *names, "shingles"), "simhash-prints")

    def linked(once: DataFrame) -> DataFrame:
        ends = links(once, WIDE, BySize(similarity), radius // WIDE, radius, similarity, only_ends=True).select(F.col("a").alias("node")).distinct()
        some = once.join(materialize(ends, "simhash-candidates"), "node", "left_semi").withColumn(row, F.col("first.r")).drop("first")
        # dealt by row at every size of the input, as below
        texts = rows.select(col(row), col(text).alias("__text")).join(materialize(some, "simhash-some").hint("merge"), row).drop(row)
        sets = materialize(_sets(texts, "__text", width), "simhash-sets")
        # a set goes to two tiles only: that costs comparisons of few sets, and saves copies of their shingles
        return links(sets, WIDE, BySize(similarity, 1), radius // WIDE, radius, similarity)

    first = _firsts(prints, "__order", WIDE, linked)
    stays = materialize(first.select(F.col("first.r").alias(row)).distinct(), "simhash-stays")
    # texts are dealt by row, once, at every size of the input; whether ``stays`` could be broadcast would be a matter of luck
    return rows.join(stays.hint("merge"), row, "left_semi").select(*(col(c) for c in docs.columns))
