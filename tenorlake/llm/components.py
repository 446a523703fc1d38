"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a min per key (combined before the shuffle) and an equi-join on
that key. Rows of a hot key, a node with more than ``HOT`` links and more than
a 250th of all, are dealt to ``SALTS`` tasks; there are fewer than 500 such
nodes, so their list is broadcast. Every round is written to the shared scratch
folder; nothing but two numbers comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenorlake.llm.common import materialize


HOT, SALTS = 256, 64


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node that has a link, with the smallest node of its component. Self-links and nulls are ignored."""
    hi, lo = F.greatest(a, b).alias("a"), F.least(a, b).alias("b")
    edges = materialize(links.where(F.col(a) != F.col(b)).select(hi, lo).distinct(), "cc-0")
    mark = lambda e: e.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("a", "b"), 20))).head()
    seen, k = mark(edges), 0
    while seen[0]:
        k += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n"))
        many = F.col("n") > max(HOT, seen[0] // 250)
        hot = F.broadcast(least.where(many).select("a", F.lit(True).alias("hot")))  # the counts add up to twice seen[0]
        dealt = both.join(hot, "a", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("b"), F.lit(SALTS))).otherwise(0))
        copied = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(many, SALTS - 1).otherwise(0)))).select("a", "m", F.col("salt").cast("long").alias("salt"))
        large = dealt.join(copied, ["a", "salt"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        edges = materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), f"cc-{k}")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
