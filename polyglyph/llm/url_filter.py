"""URL filters: host and path rules, then a character language-model ratio. DataFrame operations only.

Two variable-order Markov models, of accepted and of rejected URLs, are learned from the URLs that the rules decide.
An order-k probability is smoothed towards the order below, (n(context, c) + B p') / (n(context) + B), from an even
start over the characters seen. A URL's score is the log-likelihood difference per character, each character scored
by the longest context that the models keep: strings of two characters and more that were seen LEAST times. The
threshold is calibrated on rule-decided URLs left out of the counts. The models grow with the input and lose nothing:
one with more than BROADCAST_GRAMS strings is joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import few, materialize, table

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
ORDER = 4
SMOOTHING = 4.0
LEAST = 2
BROADCAST_GRAMS = 500_000
#: Parts in a unit of the calibration histogram.
PARTS = 50


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where url is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def apply_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. rules is a short list, one branch each."""
    rule, verdict = F, F
    for what, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]))):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = rule.when(fits, h + p), verdict.when(fits, what)
    return rule, verdict


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """Rows of urls times the characters of `key`, with g0 ... g_order: the character and the characters before it."""
    pad = "^" * order
    padded = F.concat(F.lit(pad), F.col("key"))
    each = urls.withColumn("_at", F.explode(F.sequence(F.lit(1), F.length("key"))))
    return each.select(*urls.columns, *[F.substring(padded, F.col("_at") + order - k, F.lit(k + 1)).alias(f"g{k}") for k in range(order + 1)])


def train(labelled: DataFrame, order: int = ORDER, smoothing: float = SMOOTHING) -> list[DataFrame]:
    """labelled (key, good boolean) -> for each order a table (g, ratio): log p_accepted - log p_rejected."""
    grams = _grams(labelled.select("key", "good"), order)
    one = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"g{k}").alias("g")) for k in range(order + 1)]))
    counts = grams.select("good", one.alias("x")).groupBy("x.k", "x.g").agg(F.count_if("good").alias("a"), F.count_if(~F.col("good")).alias("r"))
    counts = materialize(counts, "url_grams")
    models, below = [], None
    for k in range(order + 1):
        own = counts.where(F.col("k") == k)
        if k:
            own = own.where(F.col("a") + F.col("r") >= LEAST)
            context = counts.where(F.col("k") == k).groupBy(F.substring("g", 1, k).alias("c")).agg(F.sum("a").alias("na"), F.sum("r").alias("nr"))
            own = own.withColumn("c", F.substring("g", 1, k)).join(context, "c").join(below, F.substring(F.col("g"), 2, k) == F.col("b"))
        else:
            n = counts.where("k = 0").agg(F.count(F.lit(1)).alias("kinds"), F.sum("a").alias("na"), F.sum("r").alias("nr"))
            kinds, na, nr = n.first()
            even = 1.0 / (kinds + 1)
            own = own.withColumn("na", F.lit(na or 0)).withColumn("nr", F.lit(nr or 0)).withColumn("pa", F.lit(even)).withColumn("pr", F.lit(even))
        p = own.select("g", ((F.col("a") + smoothing * F.col("pa")) / (F.col("na") + smoothing)).alias("qa"), ((F.col("r") + smoothing * F.col("pr")) / (F.col("nr") + smoothing)).alias("qr"))
        p = materialize(p, f"url_order{k}")
        below = p.select(F.col("g").alias("b"), F.col("qa").alias("pa"), F.col("qr").alias("pr"))
        models.append(p.select("g", (F.log("qa") - F.log("qr")).alias("ratio")))
    return models


def score(urls: DataFrame, models: list[DataFrame]) -> DataFrame:
    """urls (_row, key) -> (_row, score): the mean ratio of the characters of `key`; an empty key has no row.

    A URL's characters meet again in their own task, before the shuffle, which moves one sum a URL.
    """
    scored = _grams(urls.select("_row", "key").where("key <> ''"), len(models) - 1)
    for k, m in enumerate(models):
        scored = scored.join(few(m, BROADCAST_GRAMS).select(F.col("g").alias(f"g{k}"), F.col("ratio").alias(f"r{k}")), f"g{k}", "left")
    ratio = F.coalesce(*[F.col(f"r{k}") for k in reversed(range(len(models)))], F.lit(0.0))
    # sums of whole numbers do not depend on the order of the rows
    nano = F.round(ratio * 1e9).cast("long")
    return scored.groupBy("_row").agg((F.sum(nano) / F.count(F.lit(1)) / 1e9).alias("score"))


def calibrate(scored: DataFrame) -> float:
    """scored (score, good) -> the threshold with the least sum of the two error rates, from a histogram of scores."""
    part = F.floor(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("score"))) * PARTS)
    bins = scored.groupBy(part.alias("part")).agg(F.count_if("good").alias("a"), F.count_if(~F.col("good")).alias("r"))
    whole, up = W.partitionBy(), W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    below = lambda c: F.coalesce(F.sum(c).over(up), F.lit(0))
    share = lambda n, d: n / F.greatest(d, F.lit(1))
    err = share(below("a"), F.sum("a").over(whole)) + share(F.sum("r").over(whole) - below("r"), F.sum("r").over(whole))
    best = bins.select("part", err.alias("err")).agg(F.min_by("part", F.struct("err", F.abs("part"), "part"))).first()[0]
    return (best or 0) / PARTS


def judge(pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page; score is null where a rule decides.

    A url that is null or has no :// has an empty host and path, no rule and score 0. Where the rules leave no URL
    accepted or none rejected there is nothing to tell apart: all scores are about 0 and the threshold 0 accepts
    from 0 up. Rows alike are judged alike, one by one. Other columns of pages do not matter.
    """
    host, path = host_and_path(F.col("url"))
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn("by_rule", verdict)
    judged = judged.withColumn("key", F.concat("host", "path")).withColumn("_row", F.monotonically_increasing_id())
    judged = materialize(judged, "urls")
    labelled = judged.where("by_rule is not null and key <> ''").withColumn("good", F.col("by_rule") == "allow")
    apart = F.pmod(F.xxhash64("key"), F.lit(5)) == 0
    models = train(labelled.where(~apart), order)
    checked = labelled.where(apart)
    threshold = calibrate(checked.join(score(checked, models), "_row"))
    open_ = judged.where("by_rule is null")
    open_ = open_.join(score(open_, models), "_row", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    by_method = open_.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("score") >= threshold, "allow").otherwise("block").alias("verdict"), "score")
    by_rule = judged.where("by_rule is not null").select("page_id", "host", "path", "rule", F.col("by_rule").alias("verdict"), F.lit(None).cast("double").alias("score"))
    return by_rule.unionByName(by_method)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url; nulls, repeated rows and an empty table as in judge()."""
    return judge(table(spark, sf_dir, "pages"))
