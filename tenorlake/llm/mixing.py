"""Mixing sources to target weights with hash-threshold histograms (DataFrame operations only).

Targets: sources in code point order (null last) weigh 3, 1, 2, 3, 1, 2, ...
and share ``share`` times all words; a target stops at ``cap`` times its
source's words, and what is over is shared again by weight until no target is
above. That is water-filling: sorted by cap / weight, the level of each prefix
of stopped sources is a closed form over running sums.

Selection: each document is taken ``floor(target / words)`` times, and the
rest of the target comes from the documents with the smallest hashes. The
threshold is found without sorting: words are summed by source and hash
bucket, the bucket in which the budget runs out is split into finer buckets,
and so on over 5 levels of 12 bits. Only documents of that bucket are looked
at again; everything else is a filter.

The hash covers the whole row's key, source and text. At the threshold itself
the documents of that one hash are cut to the words that are still wanted
(``measure``), or are taken whole if that comes nearer (``mix``). The window over
sources has a row for each source.

Defined results: null text has 0 words, very long texts count whole; a null
source is a source of its own; sources without words take 0; repeated rows
count each; equal rows, and rows whose hashes tie, are treated alike; an empty
table gives an empty result; other columns stay in ``mix``, whatever their
names, and ``measure`` returns none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tenorlake.llm.common import col, materialize, unused

WEIGHTS = (3, 1, 2)
BITS, LEVELS = 12, 5
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _keyed(docs: DataFrame, key: str, text: str, source: str) -> list[Column]:
    """Words and a hash of 60 bits; the null flags keep (null, 'a') and ('a', null) apart."""
    parts = [F.coalesce(col(c).cast("string"), F.lit("")) for c in (key, source, text)]
    flags = [col(c).isNull() for c in (key, source, text)]
    return [word_count(text).alias("__words"), F.shiftrightunsigned(F.xxhash64(*parts, *flags), 64 - BITS * LEVELS).alias("__hash")]


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) with target. One row per source; its windows run over sources, not documents."""
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("__rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("__rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))).withColumn("__w", weight)
    ranked = ranked.withColumn("__cap", cap * F.col("source_size")).withColumn("__all", share * F.sum("source_size").over(W.partitionBy()))
    order = W.orderBy(F.col("__cap") / F.col("__w"), "__rank")
    stopped = F.coalesce(F.sum("__cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_w = F.sum("__w").over(order.rowsBetween(0, W.unboundedFollowing))
    level = (F.col("__all") - stopped) / open_w
    filled = ranked.withColumn("__level", level)
    free = F.col("__level") * F.col("__w") <= F.col("__cap")
    first = F.min(F.when(free, F.struct(F.col("__cap") / F.col("__w"), "__rank", "__level"))).over(W.partitionBy())["__level"]
    return filled.withColumn("target", F.least(F.col("__cap"), F.coalesce(first, F.lit(float("inf"))) * F.col("__w"))).select("source", "source_size", "target")


def thresholds(rows: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: target, full rounds, threshold hash, words wanted and words there at the threshold.

    ``rows``: (source, __words, __hash), stored.
    """
    total = targets(rows.groupBy("source").agg(F.sum("__words").alias("source_size")), share, cap, weights)
    size = F.col("source_size")
    rounds = F.coalesce(F.floor(F.col("target") / F.when(size > 0, size)), F.lit(0)).cast("long")
    plan = total.withColumn("rounds", rounds).withColumn("wanted", F.rint(F.col("target") - F.col("rounds") * size).cast("long"))
    full = (F.col("wanted") >= size) & (size > 0)
    plan = plan.withColumn("rounds", F.col("rounds") + full.cast("long")).withColumn("wanted", F.when(full, 0).otherwise(F.col("wanted")))
    plan = materialize(plan, "mix-plan")
    state = plan.select("source", "wanted", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("there"))
    for level in range(LEVELS):
        left = BITS * (LEVELS - level)
        at = state.select(F.col("source").alias("__s"), "wanted", "prefix")
        active = rows.join(at, F.col("source").eqNullSafe(F.col("__s")) & (F.shiftright("__hash", left) == F.col("prefix")))
        hist = active.groupBy("source", "wanted", F.shiftright("__hash", left - BITS).alias("bucket")).agg(F.sum("__words").alias("there"))
        upto = F.sum("there").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
        hist = hist.withColumn("before", upto - F.col("there"))
        edge = hist.where((F.col("before") <= F.col("wanted")) & (F.col("wanted") < F.col("before") + F.col("there")))
        state = materialize(edge.select("source", (F.col("wanted") - F.col("before")).alias("wanted"), F.col("bucket").alias("prefix"), "there"), f"mix-{level}")
    edge = state.select(F.col("source").alias("__s"), F.col("prefix").alias("threshold"), F.col("wanted").alias("left_over"), "there")
    out = plan.join(edge, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s", "wanted")
    return materialize(out, "mix-thresholds")


def _stored(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    return materialize(docs.select(col(key).alias("__key"), col(source).alias("source"), *_keyed(docs, key, text, source)), "mix-rows")


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per document: key, source, size, source_size, target, taken (words, repeats counted)."""
    rows = _stored(docs, key, text, source)
    t = thresholds(rows, share, cap).withColumnRenamed("source", "__s")
    size, hashed, edge = F.col("__words"), F.col("__hash"), F.col("threshold")
    more = F.when(hashed < edge, size).when(hashed == edge, F.floor(size * F.col("left_over") / F.col("there"))).otherwise(0)
    taken = (F.col("rounds") * size + more).cast("long").alias("taken")
    return rows.join(t, F.col("source").eqNullSafe(F.col("__s"))).select(F.col("__key").alias(key), "source", size.alias("size"), "source_size", "target", taken)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mixed documents: columns of ``docs``, each row as often as it is taken, whole."""
    rows = _stored(docs, key, text, source)
    u = unused(docs)
    t = thresholds(rows, share, cap).select(F.col("source").alias(u + "s"), F.col("rounds").alias(u + "rounds"), F.col("threshold").alias(u + "edge"), (2 * F.col("left_over") >= F.col("there")).alias(u + "nearer"))
    more = (F.col(u + "hash") < F.col(u + "edge")) | ((F.col(u + "hash") == F.col(u + "edge")) & F.col(u + "nearer"))
    times = (F.col(u + "rounds") + F.coalesce(more, F.lit(False)).cast("long")).cast("int")
    hashed = docs.select(*(col(c) for c in docs.columns), _keyed(docs, key, text, source)[1].alias(u + "hash"))
    picked = hashed.join(t, col(source).eqNullSafe(F.col(u + "s"))).withColumn(u + "times", times).where(F.col(u + "times") > 0)
    return picked.withColumn(u + "copy", F.explode(F.sequence(F.lit(1), F.col(u + "times")))).select(*(col(c) for c in docs.columns))
