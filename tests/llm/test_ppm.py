"""PPM scores against a plain trie, and that probabilities are probabilities."""

import math
import random
from zlib import crc32

import numpy as np
import pytest

from kinweave.llm import ppm


def plain_tokens(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (text or "")).split(" ") if w]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [w.translate(low) for w in words] + [None]


def plain_bytes(text):
    return " ".join(plain_tokens(text)[:-1]).encode() + b"\n"


class Trie:
    def __init__(self, texts, order):
        self.order, self.counts = order, {}
        for t in texts:
            b = b"\n" * order + t
            for i in range(order, len(b)):
                self.learn(b[i - order : i], b[i])

    def learn(self, context, s):
        for k in range(self.order, -1, -1):
            own = self.counts.setdefault(context[len(context) - k :], {})
            own[s] = own.get(s, 0) + 1
            if own[s] > 1:
                return

    def p(self, context, s):
        p, excluded = 1.0, set()
        for k in range(self.order, -1, -1):
            counts = self.counts.get(context[len(context) - k :], {})
            left = {c: n for c, n in counts.items() if c not in excluded}
            total = sum(left.values())
            if s in left:
                return p * (left[s] - 0.5) / total
            if left:
                p *= len(left) / 2 / total
            excluded |= set(counts)
        return p / (252 - len(excluded))

    def log10(self, t):
        b = b"\n" * self.order + t
        return sum(math.log10(self.p(b[i - self.order : i], b[i])) for i in range(self.order, len(b)))


def expected(rows):
    held = lambda i: crc32(("" if i is None else str(i)).encode()) % 7 == 2
    train = [t for i, t in rows if not held(i)]
    trie, c = Trie([plain_bytes(t) for t in train], 5), {}
    for t in train:
        for w in plain_tokens(t):
            c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        ws = plain_tokens(t)
        base = sum(math.log10((c.get(w, 0) + 1) / (n + v + 1)) for w in ws)
        out.append((i, held(i), len(ws), sum(c.get(w, 0) > 0 for w in ws), n, base, trie.log10(plain_bytes(t))))
    return out


def same(found, wanted):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    found, wanted = sorted(map(tuple, found), key=key), sorted(wanted, key=key)
    assert [r[:5] for r in found] == [r[:5] for r in wanted]
    for a, b in zip(found, wanted):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_query_equals_plain_trie_on_a_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    found = ppm.op11_ppm_scores(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    same(found.collect(), expected(rows))


def test_held_out_score_beats_words_without_context_once_there_is_text_to_learn_from(spark):
    out = [r for r in ppm.op11_ppm_scores(spark, "/root/testdata/sf0.1").collect() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_blocks_do_not_change_scores_and_odd_rows_are_defined(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abéΩ𝄞") for _ in range(rnd.randint(1, 5)))
    rows = [(i, " ".join(word() for _ in range(rnd.randint(0, 30)))) for i in range(40)]
    rows += [(None, "null id"), (None, "null id"), (7, None), (8, ""), (9, " \t\n "), (9, "Tabs\tand\x0bmore\x0c white\r\n"), (50, "x" * 3000), (51, "y" * 60 + " " + "y" * 60)]
    df = spark.createDataFrame([(i, t, 0, "g") for i, t in rows], "doc_id long, text string, block int, gram string").repartition(3)
    for size in (200, 1 << 20):
        same(ppm.scores(df, size).collect(), expected(rows))


def test_nothing_to_learn_from_and_empty_tables(spark):
    lone = [(i, "some words") for i in range(60) if ppm.held_out(i)][:2]
    got = ppm.scores(spark.createDataFrame(lone, "doc_id long, text string")).collect()
    assert [r["score"] for r in got] == pytest.approx([-11 * math.log10(252)] * 2)
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 for r in got)
    assert ppm.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_probabilities_of_a_context_add_up_to_one(spark):
    seen = {}
    for t in (b"abracadabra\n", b"abba\n", b"cab a bar\n"):
        for g in ppm.grams(t).tolist():
            seen[g] = seen.get(g, 0) + 1
    alphabet = [c for c in range(256) if c not in (9, 11, 12, 13)]
    contexts = [b"\n\n\nab", b"abrac", b"qqqab", b"zzzzz", b"\n\n\n\n\n"]
    asked = {(int.from_bytes(c, "big") << 8) | s for c in contexts for s in alphabet}
    rows = [(g, seen.get(g, 0)) for g in asked | set(seen)]
    p = {r["gram"]: math.exp(r["logp"]) for r in ppm.log_probabilities(spark.createDataFrame(rows, "gram long, n long")).collect()}
    for c in contexts:
        assert sum(p[(int.from_bytes(c, "big") << 8) | s] for s in alphabet) == pytest.approx(1.0)


def test_long_texts_are_read_in_parts_without_a_seam(monkeypatch):
    b = ppm.canonical("A long enough text to be cut. " * 20)
    whole = ppm.grams(b).tolist()
    monkeypatch.setattr(ppm, "CHUNK", 7)
    assert [g for part in ppm.chunks(b) for g in part.tolist()] == whole


def test_documents_are_worked_on_together_as_they_are_alone(monkeypatch):
    texts = [ppm.canonical(t) for t in ("abc abc", "", "x", "Long " * 9, "é" * 40 + " é", " \t", "z" * 60)]
    assert ppm.joined_grams(texts).tolist() == [g for t in texts for g in ppm.grams(t).tolist()]
    words = [ppm.word_key(w) for t in texts for w in t.split()]
    assert ppm.words_of(b"".join(texts)) == words and any(w.startswith(ppm.END) for w in words)
    for size in (1, 20, 1 << 20):
        monkeypatch.setattr(ppm, "CHUNK", size)
        runs = list(ppm._together(texts))
        assert [t for run in runs for t in run] == texts and all(len(run) == 1 or sum(map(len, run)) <= size for run in runs)


def test_slots_find_every_key_where_many_share_a_slot():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(np.concatenate([rng.integers(-(2**62), 2**62, n), np.arange(n), -np.arange(n)]))
        rng.shuffle(keys)
        slots = ppm.Slots(keys)
        ask = rng.permutation(np.repeat(np.arange(len(keys)), 2))
        assert (slots(keys[ask]) == ask).all()
    same = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)) * np.arange(40, dtype=np.uint64)  # all at home in the first slot
    assert ppm.Slots(same.view(np.int64))(same.view(np.int64)).tolist() == list(range(40))
    with_many = [b"w%d" % i for i in range(500)]
    assert ppm.Lookup(with_many, np.arange(500) * 3)([b"w7", b"w499", b"w7"]).tolist() == [21, 1497, 21]


def test_adaptive_code_learns_and_equals_a_plain_trie(spark):
    text = "the cat sat on the mat and the cat sat on the mat"
    b, bits = plain_bytes(text), 0.0
    for i in range(len(b)):
        # what has been read so far, without an end of its own
        trie = Trie([b[:i]], 5)
        read = b"\n" * 5 + b[:i]
        bits -= math.log2(trie.p(read[-5:], b[i]))
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in ppm.adaptive_bits(df).collect()}
    assert got[1]["bits"] == pytest.approx(bits) and got[1]["n_bytes"] == len(b)
    assert got[2]["bits"] == pytest.approx(math.log2(252))
    assert got[1]["bits"] / len(b) < 6
