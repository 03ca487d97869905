"""URL filter: host and path rules first, then the ratio of two character models.

Two smoothed variable-order Markov models are counted, one over URLs that a rule allows and one over URLs that a rule
blocks. A URL without a rule is judged by the difference of its log-likelihoods per character, against a threshold
calibrated on rule-judged URLs that neither model has seen. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import staged

#: Longest context, in characters.
ORDER = 4
#: Contexts back off to an even chance among so many characters.
ALPHABET = 256
#: One distinct URL in HELD calibrates the threshold, the others are counted.
HELD = 5
#: Rows of the gram table up to which it is broadcast; above, it is joined.
BROADCAST_GRAMS = 300_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]  # verdict, host, path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, form, 1), _UPPER, _LOWER), F.regexp_extract(url, form, 2)


def by_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule, as host and path together, and its verdict; null without one.

    A rule fits its host and all subdomains, where the path starts with the rule's path. Meant for short rule lists:
    they become one expression.
    """
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """One row per character of each URL, and its end, with the ``order`` characters before it; digits count alike."""
    folded = F.translate(F.lower("url"), "0123456789", "0" * 10)
    padded = F.concat(F.lit("\u0002" * order), folded, F.lit("\u0003"))
    places = urls.withColumn("padded", padded).withColumn("place", F.explode(F.sequence(F.lit(1), F.length("padded") - order)))
    return places.withColumn("gram", F.substring("padded", F.col("place"), F.lit(order + 1))).drop("padded", "place")


def gram_ratios(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``counts`` (gram, allow, block) to (gram, ratio): log of the last character's chance in both models.

    Each order is interpolated with the next lower one, by the number of kinds that followed the context
    (Witten-Bell); a context that a model has not met leaves all to the lower order.
    """
    lower = None
    for k in range(order + 1):
        now = counts.groupBy(F.substring("gram", order + 1 - k, k + 1).alias("gram")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        context = now.groupBy(F.substring("gram", 1, k).alias("context")).agg(
            *(f(c).alias(f"{c}_{n}") for c in ("allow", "block") for n, f in (("all", F.sum), ("kinds", lambda c: F.count_if(F.col(c) > 0))))
        )
        now = now.withColumn("context", F.substring("gram", 1, k)).join(context, "context")
        if lower is None:
            now = now.withColumns({f"{c}_low": F.lit(1.0 / ALPHABET) for c in ("allow", "block")})
        else:
            now = now.withColumn("shorter", F.substring("gram", 2, k)).join(lower, "shorter")
        chance = {
            c: (F.col(c) + F.greatest(F.col(f"{c}_kinds"), F.lit(1)) * F.col(f"{c}_low")) / (F.col(f"{c}_all") + F.greatest(F.col(f"{c}_kinds"), F.lit(1)))
            for c in ("allow", "block")
        }
        now = now.select("gram", *(chance[c].alias(f"{c}_low") for c in ("allow", "block")))
        lower = now.withColumnRenamed("gram", "shorter")
    return now.select("gram", (F.log("allow_low") - F.log("block_low")).alias("ratio"))


def judge_urls(pages: DataFrame, rules: list[Rule], order: int = ORDER) -> DataFrame:
    """Judge the URL of each row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, score.

    One row per input row, repeated rows too. ``score`` is the log-likelihood difference per character less the
    threshold; it is null for a null URL, which without a rule is allowed, as is any URL where one of the models has
    nothing to count. Distinct URLs are counted and scored once, weighted by their copies. Other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    urls = rows.where(F.col("url").isNotNull()).groupBy("url", "host", "path").agg(F.count("*").alias("copies"))
    urls = urls.select("url", "copies", verdict.alias("kind"), (F.conv(F.substring(F.md5("url"), 1, 6), 16, 10).cast("long") % HELD == 0).alias("held"))
    learns = lambda kind: F.sum(F.when((F.col("kind") == kind) & ~F.col("held"), F.col("copies")).otherwise(0))
    counts = _grams(urls, order).groupBy("gram").agg(learns("allow").alias("allow"), learns("block").alias("block"))
    ratios = staged(gram_ratios(staged(counts, "url_grams"), order), "url_ratios")
    grams = _grams(urls, order)
    joined = grams.join(F.broadcast(ratios) if ratios.count() <= BROADCAST_GRAMS else ratios, "gram")
    scores = staged(joined.groupBy("url", "kind", "held", "copies").agg(F.avg("ratio").alias("score")), "url_scores")

    held = scores.where(F.col("held") & F.col("kind").isNotNull()).groupBy("kind").agg(
        F.avg("score").alias("mean"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("spread")
    )
    found = {r["kind"]: (r["mean"], r["spread"] + 1e-6) for r in held.collect()}  # two rows
    known = {r["kind"] for r in scores.select("kind").where(F.col("kind").isNotNull()).distinct().collect()}
    if {"allow", "block"} <= set(found):
        (a, wide_a), (b, wide_b) = found["allow"], found["block"]
        threshold = (a * wide_b + b * wide_a) / (wide_a + wide_b)
    else:
        threshold = 0.0 if {"allow", "block"} <= known else float("-inf")
    scored = rows.join(scores.select("url", "score"), "url", "left").select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), "score"
    )
    method = F.when(F.col("score") < threshold, F.lit("block")).otherwise(F.lit("allow"))
    left = F.col("score") - threshold if threshold != float("-inf") else F.col("score")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), left.alias("score"))
