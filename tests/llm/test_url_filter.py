"""URL verdicts against plain code over whole tables; thresholds by held-out label groups."""

import math
import random

import numpy as np

from kinweave.llm import url_filter as U


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min((i for i in map(path.find, "?#") if i >= 0), default=len(path))]


def plain_rule(host, path):
    best = None
    for h, p, v in U.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = h + p, v
    return best or (None, None)


def plain_probability(model, url):
    x = U.lexical([url], model.suffixes, model.prior)[0]
    margin = model.base
    for feature, cut, leaf in zip(model.feature, model.cut, model.leaf):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if x[feature[node]] > cut[node] else 1)
        margin += leaf[node - len(feature)]
    return 1 / (1 + math.exp(-margin))


def test_every_verdict_of_a_whole_table_equals_plain_code(spark):
    d = "/root/testdata/sf0.001"
    pages = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{d}/pages.parquet").collect()]
    labelled = sorted({(u, int(v == "block"), rule) for _, u in pages for rule, v in [plain_rule(*plain_parts(u))] if v})
    model, threshold = U.train(spark.createDataFrame(labelled, "url string, blocked int, origin string"))
    got = {r["page_id"]: r for r in U.op6_url_filter(spark, d).collect()}
    assert len(got) == len(pages)
    for i, u in pages:
        host, path = plain_parts(u)
        rule, verdict = plain_rule(host, path)
        p = plain_probability(model, u)
        by_model = "block" if threshold is not None and p >= threshold else "allow"
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict or by_model)
        assert abs(got[i]["block_probability"] - p) < 1e-9


def test_a_suffix_that_rules_block_is_not_blocked_where_no_rule_says_so(spark):
    got = U.op6_url_filter(spark, "/root/testdata/sf0.01").where("rule is null and (host = 'net' or host like '%.net')").select("verdict").collect()
    assert got and {r["verdict"] for r in got} == {"allow"}


def spam(rnd, bad):
    words = "-".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(3 if bad else 1))
    return f"http://{words}.{rnd.choice(['io', 'uk', 'fr'])}/" + (f"?a={rnd.randint(10**6, 10**9)}" if bad else "about")


def test_what_holds_across_label_groups_is_blocked(spark):
    rnd = random.Random(4)
    rows = [(spam(rnd, k % 2), k % 2, f"labeller{k % 7}") for k in range(700)]
    unseen = [(i, spam(rnd, i % 2)) for i in range(200)]
    labelled = spark.createDataFrame(rows, "url string, blocked int, origin string")
    got = {r["page_id"]: r["verdict"] for r in U.judge(spark.createDataFrame(unseen, "page_id long, url string"), [], labelled).collect()}
    assert sum((got[i] == "block") == bool(i % 2) for i, _ in unseen) >= 196


def test_thresholds():
    p, y = np.array([0.9, 0.9, 0.8, 0.7, 0.1]), np.array([1, 1, 1, 0, 0])
    assert U.threshold_of(p, y, list("aabbb"), 0.9, 2) == 0.8  # of the second origin, too
    assert U.threshold_of(p, y, list("aaaab"), 0.9, 2) is None  # all from one
    assert U.threshold_of(p, y, list("ababa"), 0.9, 4) is None  # too few that are right
    assert U.threshold_of(p, y, list("ababa"), 0.7, 4) == 0.7


def test_long_repeated_and_odd_urls(spark):
    long = "http://x.net/" + "a/" * 100_000 + "?" + "b=1&" * 50_000
    urls = [long, long, None, "", "://", "http://", "HTTP://EXAMPLE.COM/en/#x", "http://ä.com/"]
    pages = spark.createDataFrame([(i, u, "h", "p", 1.0) for i, u in enumerate(urls)], "page_id long, url string, host string, path string, block_probability double")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in U.judge(pages).collect()}
    assert got == {i: (*plain_parts(u), plain_rule(*plain_parts(u))[0]) for i, u in enumerate(urls)}
