"""Mined verdicts against all combinations of each URL's tokens."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from cohortlens.llm import url_rules


def frames(spark, urls, unwanted):
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(urls)], "page_id long, url string, html string, token string")
    labels = spark.createDataFrame([(i, 1 - int(b), 0, "y") for i, b in unwanted.items()], "doc_id long, quality int, toxic int, item string")
    return pages, labels


def brute(tokens, unwanted, settings):
    """Highest confidence of a rule that each URL meets, by trying all combinations."""
    labelled = [(frozenset(tokens[i]), b) for i, b in unwanted if tokens[i] or b]
    least = math.ceil(settings.support * len(labelled))
    best = []
    for own in tokens:
        top = None
        for size in range(1, len(own) + 1):
            for chosen in itertools.combinations(sorted(own), size):
                held = [b for t, b in labelled if t.issuperset(chosen)]
                if held and sum(held) >= max(1, least) and sum(held) >= settings.confidence * len(held):
                    top = max(top or 0, sum(held) / len(held))
        best.append(top)
    return best


def test_mined_verdicts(spark):
    draw = np.random.default_rng(6)
    hosts, words = ["a.test", "b.test", "shop.c.test"], ["buy", "win", "news", "cheap", "blog"]
    urls = [
        f"http://{hosts[draw.integers(3)]}/{'/'.join(draw.choice(words, draw.integers(0, 4), replace=False))}?{'id=1&' * int(draw.integers(2))}"
        for _ in range(300)
    ] + [None, "", "no scheme"]
    unwanted = {i: bool(("buy" in u and "cheap" in u) or draw.random() < 0.1) for i, u in enumerate(urls[:200])} | {300: True, 301: False, 9_999: True}
    pages, labels = frames(spark, urls, unwanted)
    settings = url_rules.MiningSettings(support=0.01, confidence=0.6)
    cut = pages.select("page_id", F.coalesce(url_rules.url_tokens(F.col("url")), F.array().cast("array<string>")).alias("t"))
    tokens = [r["t"] for r in sorted(cut.collect())]
    del unwanted[9_999]
    repeated = pages.unionByName(pages.filter("page_id < 20"))
    want = brute(tokens, [*unwanted.items(), *((i, unwanted[i]) for i in range(20))], settings)
    got = url_rules.judged_urls(repeated, labels, settings, rules=()).collect()
    assert len(got) == repeated.count() and any(want)
    for r in got:
        expected = want[r["page_id"]]
        assert (r["confidence"] is None) == (expected is None) and r["verdict"] == ("block" if expected else "allow")
        assert expected is None or abs(r["confidence"] - expected) < 1e-12


def test_long_fixed_paths_are_one_item(spark):
    path = "/".join(f"fixed{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40))
    urls = [f"http://{'bad' if i % 2 else 'good'}.test/{path}/{i}" for i in range(400)]
    urls += ["http://other.test/fixedaa/x", "http://bad.test/", "http://new.test/unknown"]
    pages, labels = frames(spark, urls, {i: bool(i % 2) for i in range(300)})
    settings = url_rules.MiningSettings()
    mined, _ = url_rules.mined_rules(pages, labels, settings)
    assert mined.count() < 20
    got = {r["page_id"]: r["verdict"] for r in url_rules.judged_urls(pages, labels, settings).collect()}
    assert all(got[i] == ("block" if i % 2 else "allow") for i in range(400))
    assert (got[400], got[401], got[402]) == ("allow", "block", "allow")
