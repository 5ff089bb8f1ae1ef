"""Small tests of the training-data operators against brute force, round trips and the libraries they stand for."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from kinweave.llm import bpe, decontaminate, kneser_ney, near_dup, ogg, pii, repeats, setsketch, sharding, token_counts, url_filter  # noqa: E402
from kinweave.llm.shingles import WordHashes, shingle_set  # noqa: E402
from kinweave.llm.suffix_repeats import maximal_repeats  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot string"
LONG = "word " * 30_000


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[k], t, "en", "s", len(t or ""), "clash") for k, (i, t) in enumerate(enumerate(texts))]
    return spark.createDataFrame(rows, SCHEMA)


EDGE = ["", None, "a", "the same text here again", "the same text here again", LONG, "éß漢\U0001f600 x", "  \n\t ", "' < > \x00 \x1c"]


@pytest.fixture(scope="module")
def ranks():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return bpe.parse_ranks(f.read())


# 1


def test_bpe_matches_the_library(ranks):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours, rng = bpe.TextEncoder(ranks, P.PATTERN, cached=50), random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice("aabth einor'sSé=-\n 129ß漢\U0001f600") for _ in range(rng.randint(0, 60)))
        ids = list(map(int, ours.ids(text)))
        assert ids == library.encode_ordinary(text)
        assert ours.decode(list(map(str, ids))) == text.encode()


def test_bpe_appends_and_edits(ranks):
    model, rng = bpe.PrefixBPE(ranks), random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcdeth ") for _ in range(rng.randint(0, 40))).encode() for _ in "ab")
        state = model.extend(a, [])
        assert model.extend(a + b, list(state)) == model.extend(a + b, [])
        i, j = sorted(rng.randint(0, len(a)) for _ in "ij")
        new, after = model.edit(a, state, i, j, b)
        assert new == a[:i] + b + a[j:] and after == model.extend(new, [])


def test_bpe_documents(spark, ranks):
    rows = bpe.encode_documents(docs_of(spark, EDGE), str(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN, with_ids=True)
    got = {r.doc_id: r for r in rows.collect()}
    assert len(got) == len(EDGE) and got[0].n_tokens == got[1].n_tokens == 0 and got[3].ids_sha256 == got[4].ids_sha256
    assert all(got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(EDGE))
    back = {r.doc_id: r.text for r in bpe.decode_ids(rows, str(P.path("byte_bpe_multi_50k.tiktoken"))).collect()}
    assert back == {i: t or "" for i, t in enumerate(EDGE)}


# 2


def brute_log_perplexity(texts, trusted):
    """The same model by plain dictionaries, on UTF-16 units."""
    def grams(t, n=4):
        b = t.encode("utf-16-be")
        c = ["start"] * 3 + [b[i] << 8 | b[i + 1] for i in range(0, len(b), 2)] + ["end"]
        return [tuple(c[i - n + 1 : i + 1]) for i in range(3, len(c))]

    level = {4: collections.Counter(g for t in trusted for g in grams(t))}
    for n in (3, 2, 1):
        level[n] = collections.Counter(g[1:] for g in level[n + 1])
    v, disc, ctx = len(level[1]) + 1, {}, {}
    for n in level:
        t = [sum(c == k for c in level[n].values()) for k in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1]) if t[0] + 2 * t[1] else None
        disc[n] = [min(max(k - (k + 1) * y * t[k] / t[k - 1] if y is not None and t[k - 1] else k / 2, 0.05), k - 0.05) for k in (1, 2, 3)]
        ctx[n] = collections.defaultdict(lambda: [0, 0.0])
        for g, c in level[n].items():
            ctx[n][g[:-1]][0] += c
            ctx[n][g[:-1]][1] += disc[n][min(c, 3) - 1]

    def p(g):
        q = 1 / v
        for n in (1, 2, 3, 4):
            h = g[4 - n :]
            total, held = ctx[n].get(h[:-1], (0, 0))
            if total:
                c = level[n].get(h, 0)
                q = ((c - disc[n][min(c, 3) - 1]) / total if c else 0) + held / total * q
        return q

    return [-sum(math.log(p(g)) for g in grams(t)) / len(grams(t)) for t in texts]


def test_kneser_ney_against_brute_force(spark):
    rng = random.Random(3)
    far = "\U0001f600\U0001f601\U0002f600\U00010000\ue000\ue100\x02\x03"  # characters of two units, private ones, and the numbers of the padding
    texts = ["".join(rng.choice("aab cé" + far) for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["", "zzzz"]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 30)] + [(31, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: math.log(r.perplexity) for r in kneser_ney.classify(docs, labels).collect()}
    want = brute_log_perplexity(texts, texts[:30])
    assert all(abs(got[i] - w) < 1e-9 for i, w in enumerate(want))


def test_kneser_ney_units_tell_texts_apart():
    texts = ["\x02", "\x03", "\U0001f402", "\U0001f403", "\ud83d", "\ue000", "\U00010000", "\U00011900", "\x02\x03"]
    assert len({tuple(kneser_ney.units(t)) for t in texts}) == len(texts)
    assert not {kneser_ney.START, kneser_ney.END} & {int(u) for t in texts for u in kneser_ney.units(t)}


def test_kneser_ney_languages(spark):
    """A null language is one of its own; a language of one trusted document has a model; one without has none."""
    rows = [(0, "aaab", None, "s", 4, "c"), (1, "aaab", "", "s", 4, "c"), (2, "only one", "fr", "s", 8, "c"), (3, "zzzz", "fr", "s", 4, "c"), (4, "aaab", "de", "s", 4, "c")]
    labels = spark.createDataFrame([(0, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in kneser_ney.classify(spark.createDataFrame(rows, SCHEMA), labels).collect()}
    assert got[0].perplexity == got[1].perplexity and got[0].lang == got[1].lang == ""
    assert got[2].kept and got[3].perplexity > got[2].perplexity
    assert got[4].perplexity is None and got[4].kept


def test_kneser_ney_edges(spark):
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    out = kneser_ney.classify(docs_of(spark, EDGE, [None, *range(1, len(EDGE))]), labels).collect()
    assert len(out) == len(EDGE)
    none = kneser_ney.classify(docs_of(spark, EDGE), labels.where("false")).collect()
    assert all(r.kept and r.perplexity is None for r in none)
    assert kneser_ney.classify(docs_of(spark, EDGE).where("false"), labels).collect() == []


# 3


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_feistel_is_a_permutation_with_an_inverse(n):
    f, rows = sharding.Feistel(n, 9), np.arange(n, dtype=np.uint64)
    p = f.place_of(rows)
    assert sorted(p.tolist()) == list(range(n)) and (f.row_of(p) == rows).all()


def test_sharding_law(spark):
    texts = [None, "", "x", *["copy"] * 30, "é"]
    rows = sharding.shard_rows(docs_of(spark, texts, [None, *[5] * 10, *range(100, 100 + len(texts) - 11)]).repartition(3), 8).collect()
    sizes = collections.Counter(r.shard for r in rows)
    assert len(rows) == len(texts) and max(sizes.values()) - min(sizes[s] for s in range(8)) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s])) for s in sizes)
    again = sharding.shard_rows(docs_of(spark, texts, [None, *[5] * 10, *range(100, 100 + len(texts) - 11)]).repartition(2), 8).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert sharding.shard_rows(docs_of(spark, texts).where("false")).collect() == []


# 4


def brute_spans(t):
    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(kinds):
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 12 <= len(digits) <= 19 and luhn or k == 3 and 9 <= len(digits) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_against_the_plain_patterns():
    rng = random.Random(4)
    for _ in range(4000):
        t = "".join(rng.choice("ab@@..+--  ()1234567890٣x") for _ in range(rng.randint(0, 50)))
        assert pii.base_spans(t) == brute_spans(t), t
    assert pii.base_spans("4111 1111-1111 1111 +1 (743) 555-3824")
    pii.base_spans("1" * 200_000 + "a" * 200_000 + "@")  # linear time


def test_context_finds_unseen_identifiers(spark):
    texts = [f"some words and contact me at user{i}@mail.example.org today" for i in range(30)] + [f"more words, contact me at handle_{i:04d}x now" for i in range(4)] + [f"page {i * 7919} of the book number{i}" for i in range(30)] + EDGE
    found = {r.doc_id: r for r in pii.find(docs_of(spark, texts)).collect()}
    learned = {i: [texts[i][s.start : s.end] for s in r.learned] for i, r in found.items() if r.learned}
    assert learned == {30 + i: [f"handle_{i:04d}x"] for i in range(4)}
    clean = {r.doc_id: r for r in pii.redact(docs_of(spark, texts)).collect()}
    assert clean[0].text == "some words and contact me at [EMAIL] today" and clean[30].text == "more words, contact me at [IDENT] now"
    assert clean[40].text == texts[40] and clean[0].n_chars == len(clean[0].text) and clean[0].slot == "clash"
    assert pii.find(docs_of(spark, texts).where("false")).collect() == []


def test_context_spreads_from_learned_identifiers(spark):
    """Names learned in one round make a context confident that has no base seed; a single cue word is a pattern,
    a common word is not."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(4))
    handles = [f"handle_{i:04d}x" for i in range(8)]
    texts = [f"contact me at user{i}@mail.example.org {word()}" for i in range(30)]
    texts += [f"contact me at {h} {word()}" for h in handles]
    texts += [f"his account name {h} {word()}" for h in handles] + [f"his account name only_{i:04d}y {word()}" for i in range(3)]
    texts += [f"mailbox {word()} {word()} box{i}@mail.example.org {word()}" for i in range(20)] + [f"mailbox {word()} {word()} drop_{i:04d}z {word()}" for i in range(3)]
    texts += [f"then {word()} {word()} 10.0.7.{i} {word()}" for i in range(20)] + [f"then {word()} {word()} serial{i:04d} {word()}" for i in range(3)] + [f"then {word()} {word()} then {word()}" for _ in range(100)]
    learned = {texts[r.doc_id][s.start : s.end] for r in pii.find(docs_of(spark, texts)).collect() for s in r.learned}
    assert learned == {*handles, *(f"only_{i:04d}y" for i in range(3)), *(f"drop_{i:04d}z" for i in range(3))}


def brute_learned(texts):
    """The whole scoring by dictionaries: (text, start, end) of each learned span."""
    found, words = [], collections.Counter()
    for i, t in enumerate(texts):
        assigned = pii._assigned(t or "")
        words.update(pii.words_in(t or "", assigned))
        found += [(i, f) for f in pii.found_in(t or "", pii.base_spans(t or ""), assigned)]
    known, plain, edges = set(), collections.defaultdict(lambda: True), collections.Counter()
    for _, f in found:
        if f["seed"]:
            known.add(f["instance"])
        for p in f["patterns"]:
            edges[p, f["instance"]] += 1
            plain[p, f["instance"]] &= f["plain"]
    of, uses = collections.defaultdict(list), collections.Counter()
    for (p, x), n in edges.items():
        of[p].append((x, n))
        uses[p] += n

    def blank(p):
        name = p[2:]
        if p[0] in "21":
            a, b = name.split(" ")
            return max(0, words[a] * words[b] / sum(words.values()) - uses[p])
        return max(0, words[name] - uses[p]) if p[0] in "LCAW" else 0

    def belief(patterns, confidence):
        miss = 1.0
        for kinds in ("21LCAW", "SGE", "X"):
            miss *= 1 - max([confidence.get(p, 0.0) for p in patterns if p[0] in kinds], default=0.0)
        return 1 - miss

    while True:
        confidence = {}
        for p, held in of.items():
            if sum(x in known for x, _ in held) >= pii.SUPPORT:
                good = sum(math.log1p(n) for x, n in held if x in known)
                bad = sum(math.log1p(n) * (1 if plain[p, x] else pii.UNKNOWN) for x, n in held if x not in known)
                confidence[p] = good / (good + bad + (pii.PRIOR + blank(p)) * math.log(2))
        patterns_of = collections.defaultdict(list)
        for p, x in edges:
            patterns_of[x].append(p)
        fresh = {x for x, ps in patterns_of.items() if x not in known and belief(ps, confidence) >= pii.CONFIDENT}
        if not fresh:
            break
        known |= fresh
    return {(i, f["start"], f["end"]) for i, f in found if not f["base"] and belief(f["patterns"], confidence) >= pii.CONFIDENT}


def secret_texts():
    rng = random.Random(31)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    prose = lambda: " ".join(pick("abdeginorst", rng.randint(2, 8)) for _ in range(rng.randint(5, 20)))
    texts = [f'{prose()} token = "{pick("0123456789abcdef", 40)}" {prose()}' for _ in range(12)]
    texts += [f"{prose()} password={pick('0123456789abcdef', 18)} {prose()}" for _ in range(8)]
    texts += [f"{prose()} KEYS{pick('ABCDEFGHIJKLMNOP234567', 16)} {prose()}" for _ in range(8)]
    texts += [f"{prose()} write to {pick('abc', 4)}{i}@mail.example.org or +1 (743) 555-38{i:02d} {prose()}" for i in range(10)]
    texts += [f"{prose()} on 2024-01-{i:02d} it was {i * 7919} {prose()} item{i:04d}" for i in range(30)] + [prose() for _ in range(60)]
    return texts


def test_contextual_extraction_against_brute_force(spark):
    """Seeds lead to the keys' names and forms, these to passwords and other keys; numbers and dates stay."""
    texts = secret_texts() + ["", None, "4" * 70_000, "a" * 200_000 + "=" * 1000, 'token = "', "token = 5", *["same password=00aa11bb22cc33dd44 twice"] * 2]
    got = {(r.doc_id, s.start, s.end) for r in pii.find(docs_of(spark, texts)).collect() for s in r.learned}
    assert got == brute_learned(texts)
    assert {i for i, _, _ in got} == {*range(28), len(texts) - 2, len(texts) - 1}


def test_contextual_extraction_of_a_hot_pattern(spark):
    """One pattern around a third of all rows; rows that share a doc_id or have none are texts of their own."""
    texts = [f"reference id: {i:05d}qx" for i in range(400)] + [f"reference id: u{i}@mail.example.org" for i in range(400)] + [f"page {i:06d} of it" for i in range(400)]
    ids = [None if i % 5 == 0 else i // 2 for i in range(len(texts))]
    rows = pii.find(docs_of(spark, texts, ids)).collect()
    assert len(rows) == len(texts) and sum(bool(r.learned) for r in rows) == len({i for i, _, _ in brute_learned(texts)}) == 400


# 5


def edit_distance_within(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        before, row[0] = row[0], i
        for j, d in enumerate(t, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
    return min(row)


def test_pigeonhole_finds_exactly_the_passages_within_budget():
    rng, found = random.Random(5), 0
    for _ in range(150):
        items = [(k, "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 60)))) for k in range(4)]
        m = decontaminate.Matcher(items, 0.12)
        text = "".join(rng.choice("abcd ") for _ in range(40))
        for _, t in rng.sample(items, 2):
            s = list(t)
            for _ in range(rng.randint(0, 6)):
                s.insert(rng.randint(0, len(s)), rng.choice("xyz"))
            text += "".join(s) + "".join(rng.choice("abcd ") for _ in range(10))
        want = {k: d for k, t in items if (p := decontaminate.plain(t)) and (d := edit_distance_within(p, decontaminate.plain(text))) <= int(0.12 * len(p))}
        got = m.find(text)
        assert {k: d for k, d, _, _ in got} == want
        for k, d, s, e in got:
            assert edit_distance_within(decontaminate.plain(items[k][1]), decontaminate.plain(text)[s:e]) == d
        found += len(want)
    assert found > 50


def test_decontamination_frames(spark):
    bench = spark.createDataFrame([(0, "This exact question, stated at some length, is a test item."), (1, None), (2, " ")], "item_id long, text string")
    texts = ["clean text", "Before. This exact question, stated at sme length, is  a test item. After", *EDGE]
    assert [(r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(docs_of(spark, texts), bench).collect()] == [(1, 0, 1)]
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs_of(spark, texts), bench).collect()) == [0, *range(2, len(texts))]
    assert decontaminate.contaminated(docs_of(spark, texts), bench.where("false")).collect() == []


# 6


def test_url_trees_on_held_out_urls():
    rng = random.Random(6)
    def url(bad):
        words = "".join(rng.choice("abcdefghij") for _ in range(6))
        return f"http://{words}.com/{'x' * rng.randint(0, 5)}" + (f"?a={rng.randint(10**6, 10**9)}&b={rng.random()}" if bad else "/about")

    rows = [(url(k % 2), k % 2) for k in range(600)]
    model = url_filter.fit([u for u, _ in rows[:400]], [b for _, b in rows[:400]])
    right = [(p >= 0.5) == b for p, (_, b) in zip(model.probability([u for u, _ in rows[400:]]), rows[400:])]
    assert sum(right) / len(right) > 0.97
    assert (url_filter.fit([], []).probability(["http://a/b", None, ""]) < 0.5).all()


def test_url_rules(spark):
    urls = ["http://A.Example.com/en/1?x", "http://www.example.com/en/", "https://x.net/fr/a", "ftp://net/es/", None, "no scheme", "http://notexample.com/en/", "http://example.com?q", "http://com/"]
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.judge(pages).collect()}
    assert got == {0: ("a.example.com", "/en/1", "example.com/en/"), 1: ("www.example.com", "/en/", "www.example.com/en/"), 2: ("x.net", "/fr/a", "net/fr/"), 3: ("net", "/es/", "net/es/"), 4: ("", "", None), 5: ("", "", None), 6: ("notexample.com", "/en/", "com/"), 7: ("example.com", "", None), 8: ("com", "/", "com/")}


# 7


def test_token_counts_match_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(P.path("word_bpe_49k.json")))
    texts = [*EDGE, "<|endoftext|> it's <|startoftext|>x", "é ́ " * 9000, "x" * 40_000, "a b c 12 don't"]
    got = {r.doc_id: r for r in token_counts.count_tokens(docs_of(spark, texts), str(P.path("word_bpe_49k.json"))).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}
    assert got[5].over_limit and got[5].n_bytes == len(LONG)
    assert "".join(token_counts.safe_parts(LONG, 100)) == LONG


# 8


def brute_components(texts, ids, width, percent):
    sets = []
    for t in texts:
        w = [x for x in re.split("[\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(texts)))
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i in range(len(texts)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return {ids[i]: (len(sets[i]), least[root(i)]) for i in range(len(texts))}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(8)
    base = [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(150)]
    texts = [*[x for x in EDGE if x != LONG], "One two", "one TWO"]
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = rng.choice("xyzuvw")
        texts.append(" ".join(w))
    texts += [texts[-1]] * 5
    ids = rng.sample(range(1000), len(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs_of(spark, texts, ids), 4).collect()}
    assert got == brute_components(texts, ids, 4, 80)
    kept = {r.doc_id for r in near_dup.drop_near_duplicates(docs_of(spark, texts, ids), 4).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}


def test_near_duplicates_of_nothing(spark):
    assert near_dup.near_duplicates(docs_of(spark, ["a"]).where("false")).collect() == []
    none = near_dup.near_duplicates(docs_of(spark, ["a b", "a b"], [None, 3])).collect()
    assert len(none) == 2


def test_near_duplicates_are_dropped_by_id_and_text(spark):
    copy, clean = "a b c d e f g h", "quite another text that is nobody's copy"
    got = near_dup.drop_near_duplicates(docs_of(spark, [copy, copy, clean], [1, 2, 2]), 4).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, copy), (2, clean)]
    for more in ([], [5, 5]):  # rows without an id are told apart by the same rule whatever else repeats
        got = near_dup.drop_near_duplicates(docs_of(spark, [copy, copy, clean, *["one more text here"] * len(more)], [None, None, 3, *more]), 4).collect()
        assert sorted(r.text for r in got if r.doc_id is None) == [copy]


def test_one_row_of_each_group_stays(spark):
    copy, other, clean = "a b c d e f g h", "A b c d e f g h", "quite another text that is nobody's copy"
    texts = lambda rows, ids: sorted((r.text or "" for r in near_dup.drop_near_duplicates(docs_of(spark, rows, ids), 4).collect()))
    assert len(texts([copy, other, copy], [1, 1, 2])) == 1  # one set, two texts under the smallest id
    assert texts([copy, other, clean], [None, None, None])[1:] == [clean]
    assert texts([copy, clean, copy], [None, 3, 4]) == [copy, clean]  # a copy of a document that has an id
    assert texts(["", "", None, "", "x"], [1, 2, 2, 2, 5]) == ["", "", "", "x"]  # (2, "") once; null is another text
    many = near_dup.near_duplicates(docs_of(spark, [copy] * 900 + ["", None] * 200 + [f"{i} {clean}" for i in range(200)]), 4)
    got = {r.doc_id: r for r in many.collect()}
    assert len(got) == 1500 and all(got[i].component_id == 0 for i in range(900)) and all(got[i].kept and not got[i].n_shingles for i in range(900, 1300))


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(1)
    for shared in (900, 500):
        x = rng.integers(0, 2**63, 1000, np.uint64)
        y = np.concatenate([x[:shared], rng.integers(0, 2**63, 1000 - shared, np.uint64)])
        a, b = setsketch.registers(x), setsketch.registers(y)
        assert (setsketch.merge(a, b) == setsketch.registers(np.union1d(x, y))).all()
        true = shared / (2000 - shared)
        assert abs(setsketch.similarity(a[None], b[None], np.array([1000.0]), np.array([1000.0]))[0] - true) < 0.12
    assert len(shingle_set("a b c d e", 5, WordHashes())) == 1


# 9


def test_maximal_repeats_against_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        texts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 5))]
        least, places = rng.choice([1, 2, 3]), collections.defaultdict(list)
        for i, t in enumerate(texts):
            for a in range(len(t)):
                for b in range(a + least, len(t) + 1):
                    places[t[a:b]].append((i, a))
        want = []
        for s, o in places.items():
            left = {texts[i][a - 1] if a else ("start", i) for i, a in o}
            right = {texts[i][a + len(s)] if a + len(s) < len(texts[i]) else ("end", i) for i, a in o}
            if len(o) > 1 and len(left) > 1 and len(right) > 1:
                want.append((len(s), sorted(o)))
        assert sorted(maximal_repeats(texts, least)) == sorted(want)


@pytest.mark.parametrize("hot", [repeats.HOT, 1, 4])
def test_removed_repeats_against_brute_force(spark, hot):
    rng = random.Random(10)
    base, line = "".join(rng.choice("abcd efgh\n") for _ in range(400)), "".join(rng.choice("abc é") for _ in range(70))
    texts = [base, "", None, "a" * 130, "ab" * 80, "x" + "a" * 90]
    for _ in range(60):
        some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, n)))
        texts.append(rng.choice([base[rng.randint(0, 100) : rng.randint(150, 400)], some(80) + line + some(80), some(30) + (texts[-1] or "")]))
    ids = rng.sample(range(500), len(texts))
    ids[7] = ids[8]
    ids[9] = None
    first = {}
    for t, i in zip(texts, ids):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            if i is not None:
                first[b[p : p + 50]] = min(first.get(b[p : p + 50], i), i)
    want = []
    for t, i in zip(texts, ids):
        b = (t or "").encode()
        m = bytearray(len(b))
        for p in range(len(b) - 49):
            if i is not None and first[b[p : p + 50]] < i:
                m[p : p + 50] = b"\1" * 50
        spans = sum(1 for p in range(len(m)) if m[p] and (p == 0 or not m[p - 1]))
        want.append((i, len(b), sum(m), spans, hashlib.sha256(bytes(c for c, k in zip(b, m) if not k)).hexdigest()))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs_of(spark, texts, ids), hot).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_identities_differ_by_either_half():
    ident = np.array([[5, 5, 1, 5, 5], [1, 2, 9, 1, 2]], np.uint64)
    keys, first, inverse = repeats._unique(ident)
    assert keys.T.tolist() == [[1, 9], [5, 1], [5, 2]] and first.tolist() == [2, 0, 1] and inverse.tolist() == [1, 2, 0, 1, 2]
    assert (keys[:, inverse] == ident).all()


def test_repeats_in_a_very_long_text(spark):
    """Longer than what is worked on at once; its copy in a later document goes whole, its own repeats stay."""
    rng = random.Random(12)
    long = "".join(rng.choice("abcdefghij ") for _ in range(2 * repeats._CHUNK + 77))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeats.remove_repeats(docs_of(spark, [long, "<" + long + long[:60], long[-49:]], [1, 2, 3])).collect()}
    n = len(long)
    assert got == {1: (n, 0, 0), 2: (n + 61, n + 60, 1), 3: (49, 0, 0)}


def test_blocks_follow_the_bytes_and_not_the_scan(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PART", 1000)
    one = docs_of(spark, ["é" * 250] * 40 + [None]).coalesce(1)
    assert repeats.parts(one) == repeats.parts(one.repartition(7)) == 20
    assert repeats.parts(one.where("false")) == 2


def test_segments_are_settled_by_runs_of_groups(monkeypatch):
    rng = np.random.default_rng(13)
    n = 300
    group = rng.integers(0, 40, n)
    segment = rng.integers(97, 99, (40, repeats.SEGMENT)).astype(np.uint8)[group]
    segment[np.arange(n), rng.integers(0, 20, n)] = 99
    lo, hi, doc = rng.integers(0, 9, n), rng.integers(9, repeats.SPAN, n), rng.permutation(n)
    inside = (np.arange(repeats.SPAN) >= lo[:, None]) & (np.arange(repeats.SPAN) <= hi[:, None])
    whole, seen = repeats._settle(segment, lo, hi, doc), []
    monkeypatch.setattr(repeats, "_SETTLE", 25)
    settle = repeats._settle
    monkeypatch.setattr(repeats, "_settle", lambda s, *more: seen.append(len(s)) or settle(s, *more))
    assert (np.where(inside, repeats._settle_groups(segment, lo, hi, doc, group), 0) == np.where(inside, whole, 0)).all()
    assert len(seen) > 5 and max(seen) < 50 and sum(seen) == n


def test_no_repeats_in_nothing(spark):
    assert repeats.remove_repeats(docs_of(spark, ["a"]).where("false")).collect() == []


# 10


def test_ogg_round_trip_and_damage(spark):
    rng = random.Random(11)
    for n in (576, 4608, 4608 * 7 + 576, 576 * 200):
        payload = bytes(rng.randrange(256) for _ in range(n))
        media = ogg.mux(payload)
        streams = ogg.demux(media)
        assert ogg.payload_of(streams) == payload and sum(s.granule for s in streams.values()) == n
        for _ in range(5):
            at = rng.randrange(len(media))
            with pytest.raises(ogg.OggError):
                ogg.demux(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
        with pytest.raises(ogg.OggError):
            ogg.demux(media[:-10])
    plain = 0
    for byte in b"OggS some page":
        plain ^= byte << 24
        for _ in range(8):
            plain = ((plain << 1) ^ (0x04C11DB7 if plain >> 31 else 0)) & 0xFFFFFFFF
    assert ogg.page_checksum(b"OggS some page") == plain
    rows = {r.doc_id: r for r in ogg.store_and_read(docs_of(spark, EDGE), keep_media=True).collect()}
    assert rows[3].media == rows[4].media and rows[0].payload_bytes == 576 and rows[0].n_bytes == 0
    assert all(r.payload_bytes % 576 == 0 and ogg.payload_of(ogg.demux(bytes(r.media)))[: r.n_bytes] == (EDGE[i] or "").encode() for i, r in rows.items())


# Empty tables, and rows whose id is null or stands twice


def test_per_row_operators_of_nothing_and_of_repeated_ids(spark):
    ranks_file, words = str(P.path("byte_bpe_multi_50k.tiktoken")), str(P.path("word_bpe_49k.json"))
    run = [lambda d: bpe.encode_documents(d, ranks_file, P.PATTERN), lambda d: token_counts.count_tokens(d, words), ogg.store_and_read]
    docs = docs_of(spark, ["same", "same", "other", None], [None, 5, 5, None])
    for f in run:
        assert f(docs.where("false")).collect() == []
        assert sorted(str(r.doc_id) for r in f(docs).collect()) == ["5", "5", "None", "None"]


def test_url_filter_of_nothing(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
