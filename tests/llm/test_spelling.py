"""Spelling variants against brute force on whole tables and on words made to crowd exact parts."""

import random
import re
from collections import Counter
from zlib import crc32

from kinweave.llm import spelling
from kinweave.llm.common import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(words):
    alphabet = sorted({c for w in words for c in w})
    near = {}
    for w in words:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet}
        edits |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in alphabet}
        near[w] = {x for x in edits if x in words and x != w}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    rows = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, words[w], len(near[w]), None if form[w] is None else words[form[w]]))
    return rows


def result(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_equals_brute_force_on_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    words = counted([(r["doc_id"], r["text"]) for r in docs])
    found = spelling.op13_spelling_variants(spark, "/root/testdata/sf0.001")
    assert found.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    assert result(found) == expected(words)


def test_chains_ties_and_letters_beyond_ascii(spark):
    words = {"stark": 3, "starke": 6, "starker": 12, "straße": 5, "strasse": 4, "éclair": 9, "eclair": 3, "öffne": 3, "offne": 3, "abcde": 3, "abcdf": 6, "abcdg": 6}
    found = result(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert found == expected(words)
    by = {r[0]: r for r in found}
    assert by["stark"][1:3] == ("starke", "starker")  # a chain is followed to its end
    assert by["abcde"][1] == "abcdf"  # of equal counts the smaller word
    assert by["offne"][1] is None  # twice the count is needed


def test_crowded_parts_are_split_and_nothing_is_lost(spark):
    rnd = random.Random(5)
    words = {}
    while len(words) < 700:
        words["prefix" * rnd.randint(0, 1) + "".join(rnd.choice("ab") for _ in range(rnd.randint(3, 9))) + "suffix" * rnd.randint(0, 1)] = rnd.randint(3, 60)
    words = {w: n for w, n in words.items() if len(w) >= 5}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    whole = {(w, x) for w in words for x in words if one_edit(w, x)}
    with Scratch(spark) as scratch:
        for limit, bucket in ((20, 50), (10_000, 100)):
            pairs = {(r["word"], r["near"]) for r in spelling._near_pairs(df, scratch, limit, bucket, levels=3).collect()}
            assert pairs == whole


def test_automaton_is_minimal_and_numbers_words():
    words = sorted(["tap", "taps", "top", "tops", "stop", "stops"])
    a = spelling.Automaton(words)
    assert len(a.edges) == 7  # "ps" and its end are shared by all
    for k, w in enumerate(words):
        node, number = a.walk(a.start, 0, w)
        assert a.final[node] and number == k
    assert {words[k] for k in a.near("tops", 0, 0)} == {"taps", "top", "stops"}
    assert {words[k] for k in a.near("tops", 2, 0)} == {"top"}
    assert {words[k] for k in a.near("tops", 0, 2)} == {"taps", "stops"}


def test_nulls_empty_long_repeated_and_extra_columns(spark):
    assert spelling.variants(spelling.word_counts(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    long = "Wörter " * 200_000 + "x" * 2_000_000 + " lang9lang"
    rows = [(1, None), (2, ""), (None, "hello hello hello helo"), (None, "hello hello hello helo"), (3, "HELLO ÀÉÎ×Ø zehn"), (4, long)]
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n int, word string")
    got = {r["word"]: r["n"] for r in spelling.word_counts(df).collect()}
    assert got == counted(rows)
