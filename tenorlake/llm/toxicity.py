"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary labelled documents, are compared on the
log-likelihood of a text's words. The probability of a word in a class is its
Kneser-Ney continuation probability: how many different words it follows there,
less an absolute discount, which counts of counts give for each class. The
discounted mass backs off to continuation counts shared by both classes, so an
expression that is rare, or new, says little. The probabilities of all words
and of an unknown one add up to 1.

A toxic text is mostly ordinary language. So its likelihood is that of a
mixture: a ``share`` of its words from the toxic model, the others from the
ordinary one. All words count, for and against: one that is rarer in toxic
texts lowers the sum. The log-likelihoods of mixture and ordinary model are
subtracted and normalised by length: words and ``pad`` more, which keeps short
texts from extremes. Whether repeats of a word in a text count is the third
choice. The three are those of ``SHARES``, ``PADS`` and both ways with the
least log-loss of a logistic curve on labelled documents that the models have
not seen; the curve, set to the labels' own share of toxic documents, makes
the difference a probability. (With a share of 1, the plain ratio of the two
models, the languages' shares in the classes outweigh the toxic words. Pairs,
with this order as back-off, were measured too; see the README.)

The models are fitted on a sample of at most ``ROWS`` labelled documents of
each class (the smallest hashes of doc_id) and hold at most ``WORDS`` words,
those with the most continuations; all else covers every document.

Words: runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.
Defined results: null and empty texts have difference 0 and so one score; very
long texts count whole; equal texts have equal scores, repeated rows stay, but
a document given several times is learned from once (its smallest text); labels
that are null are ignored; a document labelled twice is toxic if either says
so; of words with equal counts the smaller stays; without labels of both
classes every score is the share of toxic ones; empty tables give empty ones;
other columns stay, but one called like the result is replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenorlake.llm.common import col, materialize, unused, without

ROWS = 6000
FOLDS, HELD_OUT, CALIBRATE = 5, 0, 4
WORDS = 400_000
SHARES, PADS = (0.001, 0.01, 0.1, 1.0), (0, 10, 30, 100)
PAIRS = 1 << 17  # pairs that a task counts before it puts them out
_space = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def fold(key: str):
    return F.pmod(F.crc32(col(key).cast("string")), F.lit(FOLDS))


def tokens(text: bytes | None) -> list[bytes]:
    return text.lower().translate(_space).split() if text else []


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words one after the other, and the number of each text's words."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(t or b"" for t in texts.to_pylist()).lower().translate(_space), np.uint8)
    ends = np.cumsum(lengths)
    solid = data != 32
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = ends[:-1][(ends[:-1] < len(data))]
    first[begins] = solid[begins]  # a text's first word doesn't go on from the text before it
    place = np.append(np.flatnonzero(first), len(data))
    counts = np.searchsorted(place[:-1], ends)  # words that begin before a text's end
    kept = np.cumsum(solid, dtype=np.int32 if len(data) < 1 << 31 else np.int64)  # bytes of words up to and with each place
    total = int(kept[-1]) if len(kept) else 0
    offsets = np.append(kept[place[:-1]] - 1, total).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])])
    return words, np.diff(counts, prepend=0)


@dataclass
class Model:
    words: pa.Array
    word: np.ndarray  # log-probability in toxic less in ordinary documents; the last entry is for unknown words
    share: float = 1.0
    pad: int = 0
    distinct: bool = False
    slope: float = 0.0
    shift: float = 0.0

    def sums(self, texts: pa.Array, shares: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
        """For each text, the sums of differences at these shares and the number of words; first of all words, then of different ones."""
        words, counts = _split(texts)
        at = pc.fill_null(pc.index_in(words, value_set=self.words), len(self.words)).to_numpy(zero_copy_only=False).astype(np.int64)
        text = np.repeat(np.arange(len(counts)), counts)
        once = np.unique(text * len(self.word) + at)
        some = [(text, at), np.divmod(once, len(self.word))]
        parts = [np.log1p(s * np.expm1(self.word)) for s in shares]
        total = [[np.bincount(t, p[w], len(counts)) for p in parts] for t, w in some]
        return np.array(total), np.array([np.bincount(t, minlength=len(counts)) for t, _ in some])

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """The length-normalised difference of log-likelihoods, in the order of ``texts``."""
        total, number = self.sums(texts, (self.share,))
        return total[int(self.distinct), 0] / np.maximum(number[int(self.distinct)] + self.pad, 1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.evidence(texts) + self.shift, -40, 40)))


def _some(column: pa.Array, bytes_: int = 2 << 20) -> Iterator[pa.Array]:
    """Parts of a column of texts with at most so many bytes, or one text."""
    texts = column.cast(pa.large_binary())
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + bytes_, "right")))
        yield texts.slice(at, to - at)
        at = to


def _class_counts(rows: DataFrame) -> DataFrame:
    """Counts of word pairs by class; the word before the first is empty."""

    def put(pairs: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
        for k, c in enumerate(pairs):
            items = list(c.items())
            yield pa.RecordBatch.from_arrays([pa.array([v for (v, _), _ in items], pa.binary()), pa.array([w for (_, w), _ in items], pa.binary()), pa.array([n if k == 0 else 0 for _, n in items], pa.int64()), pa.array([n if k == 1 else 0 for _, n in items], pa.int64())], names=["v", "w", "n0", "n1"])
            c.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for text, toxic in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("toxic").to_pylist(), strict=True):
                ws = tokens(text)
                pairs[toxic].update(zip([b"", *ws], ws, strict=False))
                if len(pairs[0]) + len(pairs[1]) > PAIRS:
                    yield from put(pairs)
        yield from put(pairs)

    return rows.mapInArrow(count, "v binary, w binary, n0 long, n1 long").groupBy("v", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _discount(ones: int, twos: int) -> float:
    """The absolute discount from the numbers of words with one and with two continuations; halves where they say nothing."""
    return min(max(ones / (ones + 2 * twos), 0.05), 0.95) if ones else 0.5


def _kneser_ney(pairs: DataFrame) -> Model:
    """Counted by Spark; at most ``WORDS`` words come to the driver."""
    some = lambda c: F.sum((F.col(c) > 0).cast("long"))
    cont = pairs.groupBy("w").agg(some("n0").alias("k0"), some("n1").alias("k1"), F.count("*").alias("k"))
    cont = materialize(cont, "toxicity-words")
    exactly = [F.sum((F.col(c) == n).cast("long")) for c in ("k0", "k1") for n in (1, 2)]
    k0, k1, k, one0, two0, one1, two1, vocabulary = (x or 0 for x in cont.agg(F.sum("k0"), F.sum("k1"), F.sum("k"), *exactly, F.count("*")).head())
    discounts = _discount(one0, two0), _discount(one1, two1)
    free = [x or 0.0 for x in cont.agg(*(F.sum(F.least(F.col(c), F.lit(d))) for c, d in zip(("k0", "k1"), discounts, strict=True))).head()]
    left = cont.orderBy(F.desc("k"), "w").limit(WORDS).toArrow()
    own = [np.append(left.column(c).to_numpy(), 0).astype(float) for c in ("k0", "k1", "k")]
    shared = (own[2] + 1) / (k + vocabulary + 1)
    # a class without words, or whose words have all been discounted, is the shared one
    prob = [(np.maximum(n - d, 0) + f * shared) / total if total else shared for n, d, f, total in zip(own, discounts, free, (k0, k1), strict=False)]
    return Model(left.column("w").combine_chunks().cast(pa.large_binary()), np.log(prob[1]) - np.log(prob[0]))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope, shift and log-loss, by Newton steps with a weak prior on the slope of standardised x."""
    mean, dev = x.mean(), x.std() or 1.0
    z = np.stack([(x - mean) / dev, np.ones_like(x)], 1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (y - p) - np.array([1e-2, 0]) * b
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-2, 1e-9])
        step = np.linalg.solve(h, g)
        b = b + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ b, -30, 30))), 1e-9, 1 - 1e-9)
    return b[0] / dev, b[1] - b[0] * mean / dev, float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = ROWS) -> Model:
    """Learn from labels outside the held-out fold only."""
    spark = docs.sparkSession
    said = labels.where(col(label).isin(0, 1) & (fold(key) != HELD_OUT)).groupBy(col(key).alias("__key")).agg(F.max(col(label)).cast("int").alias("toxic"))
    said = materialize(said, "toxicity-labels")
    share = dict(said.groupBy("toxic").count().collect())
    empty = Model(pa.array([], pa.large_binary()), np.zeros(1))
    if not share.get(0) or not share.get(1):
        known = (share.get(1, 0) + 0.5) / (sum(share.values()) + 1)
        empty.shift = math.log(known / (1 - known))
        return empty
    picked = [said.where(F.col("toxic") == c).orderBy(F.xxhash64("__key"), "__key").limit(rows) for c in (0, 1)]
    picked = materialize(picked[0].unionByName(picked[1]), "toxicity-sample")  # at most 2 * rows short rows
    own = docs.select(col(key).alias("__key"), col(text).alias("text")).join(F.broadcast(picked), "__key")
    own = materialize(own.groupBy("__key", "toxic").agg(F.min("text").alias("text")).withColumn("fold", fold("__key")), "toxicity-texts")
    model = _kneser_ney(_class_counts(own.where(F.col("fold") != CALIBRATE).select("text", "toxic")))
    shared = spark.sparkContext.broadcast(model)

    names = [f"x{k}_{i}" for k in range(2) for i in range(len(SHARES))] + ["n0", "n1"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for texts in _some(b.column("text")):
                total, number = shared.value.sums(texts, SHARES)
                yield pa.RecordBatch.from_arrays([*map(pa.array, total.reshape(-1, len(texts))), *(pa.array(n.astype(float)) for n in number), b.column("toxic").slice(done, len(texts))], names=[*names, "y"])
                done += len(texts)

    seen = own.where(F.col("fold") == CALIBRATE).select("text", "toxic").mapInArrow(measure, ", ".join(f"{n} double" for n in names) + ", y int").toArrow()  # a row for each of at most 2 * ROWS documents
    y = seen.column("y").to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        model.slope, model.shift = 1.0, math.log(share[1] / share[0])  # too few labels to fit a curve
        return model
    best = math.inf
    for k in range(2):
        for i, part in enumerate(SHARES):
            for pad in PADS:
                slope, shift, loss = _logistic(seen.column(f"x{k}_{i}").to_numpy() / np.maximum(seen.column(f"n{k}").to_numpy() + pad, 1), y)
                if loss < best:
                    best = loss
                    model.share, model.pad, model.distinct, model.slope, model.shift = part, pad, bool(k), slope, shift
    # the sample's share of toxic documents differs from that of all labels
    model.shift += math.log(share[1] / share[0]) - math.log(y.sum() / (len(y) - y.sum()))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with the probability ``out``; a column of that name is replaced."""
    keep = without(docs, out)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = np.concatenate([np.zeros(0), *(shared.value.scores(t) for t in _some(b.column(text)))])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(scores, pa.float64())], names=[*keep, out])

    return docs.select(*(col(c) for c in keep)).mapInArrow(run, schema)


def keep_ordinary(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Columns of ``docs`` for the rows with a score below ``threshold``."""
    out = unused(docs) + "toxicity"
    scored = score(docs, fit(docs, labels, text=text), text, out)
    return scored.where(F.col(out) < threshold).select(*(col(c) for c in docs.columns))
