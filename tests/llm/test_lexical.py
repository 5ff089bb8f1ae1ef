"""Ranked lexical search against a plain loop, whatever the shards, groups of queries and partitions."""

import math
import random
import re

from kinweave.llm import lexical
from kinweave.llm.common import Scratch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def expected(docs, items, k=10):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, ts) for i, ts in held if ts]
    n, total = len(held), sum(len(ts) for _, ts in held)
    df = {}
    for _, ts in held:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out = set()
    for item, text in set(items):
        scores = []
        for i, ts in held:
            m = 25 + (75 * len(ts) * n) // total
            s = 0
            for q in terms(text):
                if tf := ts.count(q):
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[q] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0))
        for rank, (s, null, i) in enumerate(sorted(scores)[:k], 1):
            out.add((item, rank, None if null else i, -s))
    return out


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item int, score string")
    return d, spark.createDataFrame([(i, t, 2) for i, t in items], "item_id string, text string, doc_id int")


def result(df):
    rows = [tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed, n=120):
    rnd = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "été", "ÉTÉ", "über", "delta7", "7", "東京", "the", "of"] + [f"w{i}" for i in range(25)]
    docs = [(i, " ".join(rnd.choice(words) + rnd.choice(["", ",", "-", "\n", "\x7f"]) for _ in range(rnd.randint(0, 25)))) for i in range(n)]
    docs += [(500 + i, "Alpha beta tie") for i in range(25)]  # more equal scores than results
    docs += [(None, "Alpha beta tie"), (None, "Alpha beta tie"), (7, "repeated id Alpha"), (900, None), (901, ""), (902, " .,;\x00 "), (903, "long " * 5000 + "Alpha")]
    items = [("a", "alpha BETA tie"), ("a2", "Alpha beta tie tie tie"), ("b", "été über 東京"), ("c", "nothing here known"), ("d", None), ("e", "..."), ("f", "the the of w1 w2 7")]
    items += [("a", "alpha BETA tie"), (None, "gamma w3")]  # an equal item, and one without an id
    return docs, items


def test_rankings_equal_a_plain_loop(spark, monkeypatch):
    docs, items = corpus(1)
    want = expected(docs, items)
    for tokens, parts, group, piece in ((40, 5, 1 << 20, 1 << 20), (1 << 21, 1, 10, 7), (200, 30, 60, 64)):
        monkeypatch.setattr(lexical, "PIECE", piece)
        d, q = frames(spark, docs, items)
        monkeypatch.setattr(lexical, "TOKENS", tokens)
        monkeypatch.setattr(lexical.index, "__defaults__", (tokens,))
        assert result(lexical.rank_documents(d.repartition(parts), q, group=group)) == want
    assert result(lexical.rank_documents(*frames(spark, docs, items), k=3)) == expected(docs, items, 3)


def test_query_equals_a_plain_loop_on_a_whole_table(spark):
    d = "/root/testdata/sf0.001"
    read = lambda t, i: [(r[i], r["text"]) for r in spark.read.parquet(f"{d}/{t}.parquet").collect()]
    found = lexical.op12_lexical_search(spark, d)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and dict(found.dtypes)["score"] == "bigint" and dict(found.dtypes)["rank"] == "int"
    assert result(found) == expected(read("documents", "doc_id"), read("benchmark", "item_id"))


def test_empty_tables(spark):
    docs, items = corpus(2, 10)
    d, q = frames(spark, docs, items)
    assert lexical.rank_documents(d.limit(0), q).collect() == [] and lexical.rank_documents(d, q.limit(0)).collect() == []
    assert lexical.rank_documents(d.where("text is null"), q).collect() == []


def test_a_stored_index_is_searched_without_the_texts(spark):
    docs, items = corpus(3)
    d, _ = frames(spark, docs, items)
    with Scratch(spark) as scratch:
        shards = scratch.keep(lexical.index(d, 100))
        n, _ = lexical.corpus_size(d)
        assert shards.count() > 3
        for text in ("alpha beta", "w1 w2 w2"):
            got = {("x", r["rank"], r["doc_id"], r["score"]) for r in lexical.search(shards, n, [text]).collect()}
            assert got == expected(docs, [("x", text)])


def test_ties_at_the_edge_go_to_the_first_rows():
    import numpy as np

    assert lexical.best_of(np.array([0, 5, 7, 5, 5, 9]), 3).tolist() == [2, 5, 1]
    assert lexical.best_of(np.array([0, 0, 3]), 3).tolist() == [2] and lexical.best_of(np.zeros(4, np.int64), 2).tolist() == []
