"""URL filters: seed rules, and association rules mined from what the seed rules label.

A page whose host and path a seed rule fits takes that rule's verdict (longest
host and path wins; block before allow at equal length). Those pages are the
labels from which FP-growth mines combinations of URL tokens together with a
verdict. Rules below a support or a confidence, and those no better than a
shorter rule within them, are pruned. The other pages are matched by an
inverted index: each rule lies under its rarest token. The best rule (by
confidence, then support, then number of tokens, then block) gives the verdict;
pages that no rule fits are allowed.

A URL has one token for each of a few slots (host, registered name, top-level
domain, first and second host label, first three and last path parts, file
extension, names of the query's fields, scheme), so a URL that is very frequent
has at most 2**12 frequent combinations, whatever its length. Other path parts,
values of fields and fragments are no tokens.

Defined results: a null URL, or one without ``://``, has an empty host and
path, no tokens and no rule, and is allowed; very long URLs count whole for
host, path and seed rules; repeated rows stay, and count each as labels; equal
rules by confidence, support and number of tokens: block goes before allow, then
the tokens that come later by code points; an empty table gives an empty one;
other columns stay, but those called like a result are replaced.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenorlake.llm.common import col, materialize, without

#: (host, path, verdict)
SEEDS = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
SUPPORT, CONFIDENCE = 0.002, 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.coalesce(F.contains(url, F.lit("://")), F.lit(False)), F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.coalesce(F.contains(url, F.lit("://")), F.lit(False)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def seed_rule(host: Column, path: Column, seeds: tuple = SEEDS) -> Column:
    """(rule, verdict) of the longest seed rule that fits, or null."""
    ranked = sorted(seeds, key=lambda s: (-len(s[0]) - len(s[1]), s[2] != "block", s))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in reversed(ranked):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    labels = F.split(host, r"\.")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    n, m = F.size(labels), F.size(parts)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    fields = F.array_join(F.array_sort(F.array_distinct(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)))), "&")
    slot = lambda name, value, there: F.when(there, F.concat(F.lit(name + ":"), value))
    made = [
        slot("host", host, host != ""),
        slot("name", F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1)), n >= 2),
        slot("top", F.element_at(labels, -1), host != ""),
        slot("sub", F.element_at(labels, 1), n >= 3),
        slot("sub2", F.get(labels, F.lit(1)), n >= 4),
        slot("first", F.get(parts, F.lit(0)), m >= 1),
        slot("second", F.get(parts, F.lit(1)), m >= 3),
        slot("third", F.get(parts, F.lit(2)), m >= 4),
        slot("last", F.get(parts, m - 1), m >= 2),
        slot("ext", F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1), F.regexp_like(path, F.lit(r"\.([A-Za-z0-9]{1,8})$"))),
        slot("fields", fields, query != ""),
        slot("scheme", F.translate(F.substring_index(url, "://", 1), _UPPER, _LOWER), host != ""),
    ]
    return F.when(host != "", F.array_compact(F.array(*made))).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules (tokens, verdict, confidence, support) from rows (tokens, verdict)."""
    spark = labelled.sparkSession
    kind = "tokens array<string>, verdict string, confidence double, support double"
    if labelled.isEmpty():
        return spark.createDataFrame([], kind)
    tag = F.concat(F.lit("verdict="), "verdict")
    items = labelled.select(F.array_distinct(F.concat("tokens", F.array(tag))).alias("items"))
    total = labelled.count()
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items).freqItemsets
    is_tag = lambda x: x.startswith("verdict=")
    sets = found.select(F.array_sort(F.filter("items", lambda x: ~is_tag(x))).alias("tokens"), F.filter("items", is_tag).alias("tags"), F.col("freq"))
    sets = materialize(sets, "url-sets")
    both = sets.where(F.size("tags") == 1).select("tokens", F.substring(F.col("tags")[0], 9, 99).alias("verdict"), "freq")
    alone = sets.where(F.size("tags") == 0).select("tokens", F.col("freq").alias("all"))
    rules = both.where(F.size("tokens") > 0).join(alone, "tokens").select("tokens", "verdict", (F.col("freq") / F.col("all")).alias("confidence"), (F.col("freq") / F.lit(float(total))).alias("support"))
    rules = materialize(rules.where(F.col("confidence") >= confidence), "url-rules")
    # A rule goes if one of its parts with one token less is as confident for the same verdict.
    parts = rules.select(F.col("tokens").alias("__whole"), "verdict", "confidence", F.explode("tokens").alias("__left"))
    parts = parts.where(F.size("__whole") > 1).select("__whole", "verdict", F.col("confidence").alias("__own"), F.filter("__whole", lambda x: x != F.col("__left")).alias("tokens"))
    worse = parts.join(rules.select("tokens", "verdict", "confidence"), ["tokens", "verdict"]).where(F.col("confidence") >= F.col("__own")).select(F.col("__whole").alias("tokens"), "verdict").distinct()
    return rules.join(worse, ["tokens", "verdict"], "left_anti").select("tokens", "verdict", "confidence", "support")


def index(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """(token, rules): every rule under its rarest token. ``counts``: (token, n) over the labelled pages."""
    spread = rules.select("*", F.explode("tokens").alias("token")).join(counts, "token")
    rarest = spread.groupBy("tokens", "verdict", "confidence", "support").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    return rarest.groupBy("token").agg(F.collect_list(F.struct("tokens", "verdict", "confidence", "support")).alias("rules"))


def judge(pages: DataFrame, url: str = "url", seeds: tuple = SEEDS, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``pages`` with host, path, rule, verdict and mined (the tokens of the mined rule); columns of those names are replaced."""
    keep = without(pages, "host", "path", "rule", "verdict", "mined")
    page = F.struct(*(col(c) for c in keep)).alias("__page")
    at = pages.select(page, host_of(col(url)).alias("host"), path_of(col(url)).alias("path"), col(url).alias("__url"))
    at = at.withColumn("__seed", seed_rule(F.col("host"), F.col("path"), seeds)).withColumn("__tokens", tokens(F.col("__url"), F.col("host"), F.col("path")))
    labelled = at.where(F.col("__seed").isNotNull()).select(F.col("__tokens").alias("tokens"), F.col("__seed.verdict").alias("verdict"))
    labelled = materialize(labelled, "url-labels")
    rules = materialize(mine(labelled, support, confidence), "url-pruned")
    counts = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    under = materialize(index(rules, counts), "url-index").select(F.col("token").alias("__token"), "rules")
    # Only pages without a seed rule go to the index, each token once.
    free = at.where(F.col("__seed").isNull()).select(F.col("__tokens").alias("tokens")).where(F.size("tokens") > 0).distinct()
    hits = free.select("tokens", F.explode("tokens").alias("__token")).join(under, "__token").select("tokens", F.explode("rules").alias("r"))
    hits = hits.where(F.size(F.array_except(F.col("r.tokens"), F.col("tokens"))) == 0)
    order = F.struct(F.col("r.confidence").alias("c"), F.col("r.support").alias("s"), F.size("r.tokens").alias("n"), F.col("r.verdict").alias("v"), F.col("r.tokens").alias("t"))
    best = materialize(hits.groupBy("tokens").agg(F.max(order).alias("best")).select(F.col("tokens").alias("__found"), "best"), "url-verdicts")
    out = at.join(best, F.col("__seed").isNull() & (F.col("__tokens") == F.col("__found")), "left")
    verdict = F.coalesce("__seed.verdict", "best.v", F.lit("allow"))
    return out.select(*(F.col("__page")[c].alias(c) for c in keep), "host", "path", F.col("__seed.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("__seed").isNull(), F.array_join("best.t", " ")).alias("mined"))


def verdicts(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url")).drop("url")
