"""The pipeline against a brute-force version of all five stages on a small corpus."""

import hashlib
import math
import random

import pytest

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from kinweave.llm import kneser_ney  # noqa: E402
from tests.llm.test_llm import brute_components, brute_log_perplexity, brute_spans, edit_distance_within  # noqa: E402

KINDS = ["EMAIL", "IP", "CARD", "PHONE"]


def corpus():
    rng = random.Random(21)
    words = ["".join(rng.choice(["an", "er", "th", "in", "on", "es", "re"]) for _ in range(rng.randint(1, 3))) for _ in range(200)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    items = [prose(20) for _ in range(3)]
    texts = [prose(rng.randint(30, 90)) for _ in range(90)]
    for i in range(0, 20, 2):
        texts[i] = "!! ".join(texts[i].upper().split()) + "!!"
    for i in range(20, 30):
        w = texts[i - 8 if i % 2 else 40].split()
        w[3] = "changed"
        texts[i] = " ".join(w)
    texts[31] = texts[41]
    for i, item in enumerate(items):
        texts[50 + i] += " " + item.replace("a", "e", 1) + " " + prose(5)
    texts[60] += " Write to some.one@mail.example.org or +1 (743) 555-3824 now."
    texts += ["", None]
    return texts, items


def brute(texts, items, labels):
    ids = list(range(len(texts)))
    trusted = [texts[i] or "" for i in ids if labels.get(i) == 1]
    log = brute_log_perplexity([t or "" for t in texts], trusted)
    good = sorted(log[i] for i in ids if labels.get(i) == 1)
    q1, q3 = (good[max(math.ceil(p * len(good)) - 1, 0)] for p in (0.25, 0.75))
    reach = max(kneser_ney.FENCE * (q3 - q1), kneser_ney.LEAST)
    slack = lambda i: kneser_ney.SHORT / math.sqrt(len(texts[i] or "") + 1)
    one = [i for i in ids if q1 - reach - slack(i) <= log[i] <= q3 + reach + slack(i)]
    parts = brute_components([texts[i] for i in one], one, 5, 80)
    two = [i for i in one if parts[i][1] == i]
    squeeze = lambda t: " ".join((t or "").lower().split())
    three = [i for i in two if not any(edit_distance_within(squeeze(p), squeeze(texts[i])) <= int(0.06 * len(squeeze(p))) for p in items)]
    import tiktoken

    from kinweave.llm.bpe import parse_ranks

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=parse_ranks(f.read()), special_tokens={})
    out = {}
    for i in three:
        t, clean, at = texts[i] or "", "", 0
        for s, k, e in brute_spans(t):
            if s >= at:
                clean += t[at:s] + f"[{KINDS[k]}]"
            at = max(at, e)
        ids_ = enc.encode_ordinary(clean + t[at:])
        out[i] = (len(ids_), hashlib.sha256(",".join(map(str, ids_)).encode()).hexdigest())
    return one, two, three, out


def test_pipeline_against_brute_force(spark, tmp_path):
    texts, items = corpus()
    labels = {i: int(i >= 20 or i % 2) for i in range(len(texts)) if i % 3 or i < 20}
    root = f"file://{tmp_path}"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    one, two, three, want = brute(texts, items, labels)
    assert 0 < len(three) < len(two) < len(one) < len(texts)
    docs, kept = spark.read.parquet(f"{root}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, root).write.parquet(f"{root}/out{k}")
        docs = spark.read.parquet(f"{root}/out{k}")
        kept.append(sorted(r.doc_id for r in docs.collect()))
        assert k == 4 or docs.columns == columns
    assert kept[0] == one and kept[1] == two and kept[2] == kept[3] == kept[4] == three
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in docs.collect()} == want
    whole = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, root).collect()}
    assert whole == want


def test_pipeline_of_nothing(spark, tmp_path):
    root = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    assert corpus_pipeline.run(spark, root).collect() == []
