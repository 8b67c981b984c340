"""URL filters: fixed domain rules first, then association rules mined from labelled URLs."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelseries.session import cut_lineage

from .common import LOWER, UPPER

#: Verdict, host and path of the domain rules.
DOMAIN_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BAD = "=bad"
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.002, 0.8, 1.2
#: Fewer bad URLs than this are chance, however large their share.
MIN_COUNT = 20


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_rule(host: Column, path: Column, rules=DOMAIN_RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, domain, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(prefix))
        name, verdict = F.when(fits, domain + prefix).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host labels, path parts and query parts, each with its place."""
    low = F.translate(url, UPPER, LOWER)
    parts = lambda text, cut, place: F.transform(F.array_remove(F.split(text, cut), ""), lambda x: F.concat(F.lit(place), x))
    scheme = F.array(F.concat(F.lit("s:"), F.substring_index(low, "://", 1)))
    query = F.regexp_extract(low, r"\?([^#]*)", 1)
    found = F.concat(scheme, parts(host(url), r"\.", "h:"), parts(F.translate(path(url), UPPER, LOWER), "[/._-]", "p:"), parts(query, "[&;]", "q:"))
    return F.when(F.instr(url, "://") > 0, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def rule_candidates(sets: DataFrame, key: str, items: str, rules: DataFrame) -> DataFrame:
    """``key, rule_id`` for every rule whose antecedent is part of a row's ``items``.

    The inverted index lists a rule under its rarest token only, so a token that
    most rows have brings no candidates unless a rule has nothing rarer.
    """
    entries = sets.select(key, F.col(items).alias("__items"), F.explode(items).alias("token"))
    index = rules.select("rule_id", "antecedent", F.col("rarest").alias("token"))
    found = entries.join(index, "token").filter(F.size(F.array_except("antecedent", "__items")) == 0)
    return found.select(key, "rule_id")


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """``rule_id, antecedent, rarest, support, confidence`` of rules that lead to a bad label.

    ``labelled`` has ``url`` and boolean ``bad``; ``min_support`` is the share of
    all labelled URLs that have the tokens and are bad, and ``MIN_COUNT`` of them
    are needed in any case. A rule is pruned if another one with part of its tokens
    is at least as sure. Without labels or rules the table is empty.
    """
    baskets = labelled.select(F.when(F.col("bad"), F.concat(tokens(F.col("url")), F.array(F.lit(BAD)))).otherwise(tokens(F.col("url"))).alias("items"))
    baskets = cut_lineage(baskets.filter(F.size("items") > 0))
    least = min(1.0, max(min_support, MIN_COUNT / max(baskets.count(), 1)))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD))).filter(F.col("lift") >= min_lift)
    rules = rules.select(F.array_sort("antecedent").alias("antecedent"), "support", "confidence")
    counts = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rare = rules.select("antecedent", "support", "confidence", F.explode("antecedent").alias("token")).join(counts, "token")
    rare = rare.groupBy("antecedent", "support", "confidence").agg(F.min(F.struct("freq", "token")).alias("rare"))
    rules = cut_lineage(rare.select(F.xxhash64("antecedent").alias("rule_id"), "antecedent", F.col("rare.token").alias("rarest"), "support", "confidence"))
    sets = rules.select(F.struct("rule_id", "confidence", F.size("antecedent").alias("size")).alias("whole"), "antecedent")
    part = rules.select("rule_id", F.col("confidence").alias("sure"), F.size("antecedent").alias("part_size"))
    inside = rule_candidates(sets, "whole", "antecedent", rules).join(part, "rule_id")
    pruned = inside.filter((F.col("part_size") < F.col("whole.size")) & (F.col("sure") >= F.col("whole.confidence"))).select(F.col("whole.rule_id").alias("rule_id"))
    return cut_lineage(rules.join(pruned, "rule_id", "left_anti"))


def labels_of(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``url, bad`` of pages whose id has a label: bad if any of its labels is low quality or toxic."""
    bad = F.coalesce(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)), F.lit(False))
    by_id = labels.groupBy(F.col("doc_id").alias("__id")).agg(bad.alias("bad"))
    return pages.select("page_id", "url").join(by_id, F.col("page_id") == F.col("__id")).filter("url is not null").select("url", "bad")


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined`` for every row of ``pages``.

    A domain rule decides first; else a page is blocked if a mined rule matches its
    URL (``mined`` counts them) and allowed if none does. Each distinct URL is
    matched once. Null URLs and URLs without ``://`` have no host, path or tokens
    and are allowed. Repeated rows stay; other columns are ignored.
    """
    urls = pages.select("url").filter("url is not null").distinct().withColumn("items", tokens(F.col("url")))
    matched = rule_candidates(urls, "url", "items", rules).groupBy("url").agg(F.count(F.lit(1)).alias("mined")).withColumnRenamed("url", "__url")
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    name, verdict = domain_rule(F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": name, "fixed": verdict}).join(matched, F.col("url") == F.col("__url"), "left")
    mined = F.coalesce("mined", F.lit(0)).cast("long")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("fixed", F.when(mined > 0, "block").otherwise("allow")).alias("verdict"), mined.alias("mined"))


def filter_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Mine rules from the labelled pages and judge all pages with them."""
    return judge(pages, mine_rules(labels_of(pages, labels)))
