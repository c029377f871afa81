"""URL filtering by listed rules and mined token combinations, without Python in the tasks.

FP-growth finds combinations of URL tokens that go with unwanted labels; those
above a support and a confidence become rules. A rule stands in an index under
its rarest item, so a URL meets only the rules of its own items, and a rule holds if
the URL has all of them. Listed host and path rules come first.

Tokens that stand in the same labelled URLs are one item: every combination of
them has the same support and confidence, so a URL with any of them meets the
rules of all, and a long fixed path costs no more than one word.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.session import staged

#: (host, path, verdict)
LISTED = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

UNWANTED = "=unwanted"


@dataclass(frozen=True)
class MiningSettings:
    """Shares of the labelled URLs: a combination counts from ``support`` on, and
    blocks if at least ``confidence`` of its URLs are unwanted."""

    support: float = 0.005
    confidence: float = 0.6


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(after_scheme(url), "^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host: str, path: str, rules=LISTED) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    chosen = F.lit(None).cast("struct<rule: string, verdict: string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col(host) == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        chosen = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host labels, path words and query keys, digits as one token."""

    def words(part: Column, mark: str) -> Column:
        found = F.regexp_extract_all(F.lower(F.regexp_replace(part, "[0-9]+", "0")), F.lit(r"([\p{L}\p{N}_-]+)"), F.lit(1))
        return F.transform(found, lambda w: F.concat(F.lit(mark), w))

    rest = F.coalesce(F.regexp_extract(after_scheme(url), "^[^?#]*\\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.split(rest, "&"), lambda p: F.concat(F.lit("q:"), F.split(p, "=")[0]))
    keys = F.filter(keys, lambda k: k != "q:")
    return F.array_distinct(F.concat(words(host_of(url), "h:"), words(path_of(url), "p:"), keys))


def token_items(baskets: DataFrame) -> DataFrame:
    """token, item: tokens of the same baskets share an item, the smallest of them.

    Sets of baskets are told by their size and two sums of hashes, reduced
    before the shuffle, so a token of very many baskets is never gathered.
    """
    held = baskets.select("basket", F.explode("tokens").alias("token"))
    sets = held.groupBy("token").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("basket")).alias("one"), F.bit_xor(F.xxhash64("basket", F.lit(1))).alias("two")
    )
    smallest = sets.groupBy("n", "one", "two").agg(F.min("token").alias("item"))
    return sets.join(smallest, ["n", "one", "two"]).select("token", "item")


def mined_rules(pages: DataFrame, labels: DataFrame, settings: MiningSettings) -> tuple[DataFrame, DataFrame]:
    """Staged: (anchor, antecedent, confidence, support), and the token and item of all
    items in rules. Labels join by page_id = doc_id."""
    marks = labels.groupBy("doc_id").agg(F.max(F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False))).alias("unwanted"))
    labelled = pages.select("page_id", "url").join(marks, F.col("page_id") == F.col("doc_id")).select(
        F.monotonically_increasing_id().alias("basket"), url_tokens(F.col("url")).alias("tokens"), "unwanted"
    )
    baskets = staged(labelled.filter((F.size("tokens") > 0) | F.col("unwanted")), "baskets")
    items = staged(token_items(baskets), "token-items")
    merged = baskets.select("basket", F.explode("tokens").alias("token")).join(items, "token").groupBy("basket").agg(F.collect_set("item").alias("items"))
    mark = F.when(F.col("unwanted"), F.array(F.lit(UNWANTED))).otherwise(F.array().cast("array<string>"))
    rows = baskets.join(merged, "basket", "left").select(F.concat(F.coalesce("items", F.array().cast("array<string>")), mark).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=settings.support, minConfidence=settings.confidence).fit(staged(rows, "baskets"))
    rules = model.associationRules.filter(F.array_contains("consequent", UNWANTED)).select("antecedent", "confidence", "support")
    singles = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("item"), "freq")
    anchors = (
        rules.select("antecedent", F.explode("antecedent").alias("item"))
        .join(singles, "item")
        .groupBy("antecedent")
        .agg(F.min_by("item", F.struct("freq", "item")).alias("anchor"))
    )
    found = staged(rules.join(anchors, "antecedent"), "url-rules")
    return found, items.join(found.select(F.explode("antecedent").alias("item")).distinct(), "item").select("token", "item")


def judged_urls(pages: DataFrame, labels: DataFrame, settings: MiningSettings | None = None, rules=LISTED) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, confidence.

    ``confidence`` is that of the strongest mined rule that the URL meets. A
    null URL, or one without ``://``, has empty host and path, no tokens, and is
    allowed. Pages that repeat are judged one by one and alike. Labels without a
    page, nulls in labels and several labels of a page do no harm: one unwanted
    label marks the page. Without labels nothing is mined. Other columns are
    ignored.
    """
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    mined, items = mined_rules(narrow, labels, settings or MiningSettings())
    tokens = narrow.select("url").distinct().select("url", F.explode(url_tokens(F.col("url"))).alias("token"))
    urls = tokens.join(items, "token").groupBy("url").agg(F.collect_set("item").alias("items"))
    met = (
        urls.select("url", "items", F.explode("items").alias("anchor"))
        .join(mined, "anchor")
        .filter(F.size(F.array_except("antecedent", "items")) == 0)
        .groupBy("url")
        .agg(F.max("confidence").alias("confidence"))
    )
    placed = narrow.join(met, "url", "left").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "confidence"
    )
    found = placed.withColumn("listed", listed_rule("host", "path", rules))
    verdict = F.coalesce("listed.verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return found.select("page_id", "host", "path", F.col("listed.rule").alias("rule"), verdict.alias("verdict"), "confidence")
