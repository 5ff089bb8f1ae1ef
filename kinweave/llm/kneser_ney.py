"""Quality classifier: an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Trusted are the documents that ``labels`` give quality 1; all of them are counted. A language has its own
model of order 4 (four 16-bit code units in a long, and no two texts have the same units, so counts are exact; a
character above U+FFFF is two units). The work is laid out by blocks of documents (a hash of the id, as many as the input
has partitions):

1. each block counts its trusted n-grams and names all distinct n-grams that its documents hold;
2. counts are summed by (language, n-gram); discounts, continuation counts and back-off weights of every order are
   aggregations of these; the n-grams asked for are joined with the sharded tables of each order, which gives
   their log-probabilities;
3. the answers go back to the blocks, whose documents get their perplexities.

No table of the model is collected or broadcast by hand, and only distinct n-grams of a block are shuffled.
A document is rejected if its log-perplexity lies outside its language's fences: the quartiles of the trusted
documents, widened by FENCE times their distance and at least by LEAST, and for short documents, whose mean
varies more, by SHORT over the root of their n-grams.

Defined results: a null text is empty (its one n-gram is the end); a null language is the language ``''``; a
language without trusted text has no model, its documents have a null perplexity and are kept. Rows that
repeat are scored alike; a doc_id labelled more than once is trusted if every label is 1. A very long text is counted in
runs of its own and scored whole. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import Scratch, cut, hand_back, holding, packed, read_table, scan_partitions, unpacked

ORDER = 4
FENCE, LEAST, SHORT = 3.0, 0.12, 2.0
START, END = 2, 3
_M48, _M32, _M16 = (1 << 48) - 1, (1 << 32) - 1, (1 << 16) - 1


def units(text: str) -> np.ndarray:
    """UTF-16 code units, but the characters that START and END stand for are units of their own: low halves of no pair."""
    c = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint64)
    return np.where((c == START) | (c == END), c + np.uint64(0xDC00), c)


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-grams of the texts one behind another, each padded at its start and ended; and how many each has."""
    parts, sizes = [], np.empty(len(texts), np.int64)
    pad, end = np.full(ORDER - 1, START, np.uint64), np.array([END], np.uint64)
    for i, t in enumerate(texts):
        c = np.concatenate([pad, units(t), end])
        parts.append((c[:-3] << np.uint64(48)) | (c[1:-2] << np.uint64(32)) | (c[2:-1] << np.uint64(16)) | c[3:])
        sizes[i] = len(parts[-1])
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), sizes


def _by_language(table: pa.Table) -> Iterator[tuple[str, np.ndarray]]:
    lang = np.array(table.column("lang").to_pylist(), dtype=object)
    for name in sorted(set(lang.tolist())):
        yield name, np.flatnonzero(lang == name)


def _trusted_rows(docs: pa.Table, labels: pa.Table) -> np.ndarray:
    ids = np.array(docs.column("doc_id").fill_null(-1).to_numpy(), np.int64)
    return np.isin(ids, labels.column("trusted_id").to_numpy()) & np.array(docs.column("doc_id").is_valid().to_numpy(), bool)


_CHUNK = 1 << 20  # n-grams sorted at once


def _chunks(rows: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of rows of about _CHUNK characters."""
    ends = np.cumsum(lengths[rows])
    at = 0
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CHUNK, "right")))
        yield rows[at:stop]
        at = stop


def _count_block(docs: pa.Table, labels: pa.Table) -> pa.Table:
    holding("kneser_ney")
    if not docs.num_rows:
        return pa.table({"block": pa.array([], pa.int32()), "lang": pa.array([], pa.string()), "gram": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    block, text, trusted, out = docs.column("block")[0].as_py(), unpacked(docs.column("text")), _trusted_rows(docs, labels), []
    lengths = np.array([len(t) for t in text])
    for lang, rows in _by_language(docs):
        found: dict[bool, list] = {False: [], True: []}
        for good in (False, True):
            for part in _chunks(rows[trusted[rows] == good], lengths):
                g, n = np.unique(grams_of([text[int(i)].decode() for i in part])[0], return_counts=True)
                found[good].append((g, n if good else np.zeros_like(n)))
        g = np.concatenate([x[0] for x in found[False] + found[True]])
        n = np.concatenate([x[1] for x in found[False] + found[True]])
        keys, inverse = np.unique(g, return_inverse=True)
        total = np.bincount(inverse, n, len(keys)).astype(np.int64)
        out.append(pa.table({"block": pa.array(np.full(len(keys), block, np.int32)), "lang": pa.array([lang] * len(keys), pa.string()), "gram": pa.array(keys.view(np.int64)), "n": pa.array(total)}))
    hand_back()
    return pa.concat_tables(out)


def _score_block(docs: pa.Table, answers: pa.Table) -> pa.Table:
    holding("kneser_ney")
    n = docs.num_rows
    total, sizes, known = np.zeros(n), np.ones(n, np.int64), np.zeros(n, bool)
    if n:
        text = unpacked(docs.column("text"))
        lengths = np.array([len(t) for t in text])
        tables = {}
        for lang, rows in _by_language(answers):
            g = answers.column("gram").to_numpy()[rows].view(np.uint64)
            order = np.argsort(g)
            tables[lang] = g[order], answers.column("logp").to_numpy()[rows][order]
        for lang, rows in _by_language(docs):
            if lang not in tables:
                continue
            keys, logp = tables[lang]
            for part in _chunks(rows, lengths):
                g, size = grams_of([text[int(i)].decode() for i in part])
                total[part] = np.add.reduceat(logp[np.searchsorted(keys, g)], np.concatenate([[0], np.cumsum(size)[:-1]]))
                sizes[part], known[part] = size, True
    hand_back()
    per = np.where(known & ~np.isnan(total), -total / sizes, np.nan)
    return pa.table({"doc_id": docs.column("doc_id"), "text_hash": docs.column("text_hash"), "lang": docs.column("lang"), "n_grams": pa.array(sizes), "log_perplexity": pa.array(per, mask=np.isnan(per))})


LANGUAGES = 4096  # a table of a row a language is broadcast up to as many, and joined by a shuffle beyond
CONTEXTS = 1 << 17  # the same for contexts of no or one character, each of which a large share of all n-grams has


def _few(df: DataFrame, facts: DataFrame, on: str | list[str], how: str = "inner", most: int = LANGUAGES) -> DataFrame:
    facts = cut(facts, narrow=2)
    return df.join(F.broadcast(facts) if facts.limit(most + 1).count() <= most else facts, on, how)


def _by_lang(df: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    return _few(df, facts, "lang", how)


def _shift(c: Column | str) -> Column:
    return F.shiftrightunsigned(c, 16)


def _by_context(df: DataFrame, facts: DataFrame, order: int, how: str = "inner") -> DataFrame:
    """Joined by (lang, context). A context of the lowest orders stands for so many n-grams that one task would have them."""
    on = ["lang", "context"]
    return _few(df, facts, on, how, CONTEXTS) if order <= 2 else df.join(facts, on, how)


def _order(table: DataFrame, count: str, order: int) -> tuple[DataFrame, DataFrame]:
    """Of an order's n-grams (lang, gram, count): (lang, gram, own) with the discounted share, and the contexts
    (lang, context, backoff). Discounts come from the counts of counts of the language."""
    c = F.col(count)
    k = [F.sum((c == i).cast("long")).alias(f"t{i}") for i in (1, 2, 3, 4)]
    y = F.col("t1") / (F.col("t1") + 2 * F.col("t2"))
    ratio = lambda i: F.when(F.col(f"t{i}") > 0, i - (i + 1) * y * F.col(f"t{i + 1}") / F.col(f"t{i}"))
    plain = {1: 0.5, 2: 1.0, 3: 1.5}  # where a language has too few counts of counts
    d = [F.least(F.greatest(F.coalesce(ratio(i), F.lit(plain[i])), F.lit(0.05)), F.lit(i - 0.05)).alias(f"d{i}") for i in (1, 2, 3)]
    discounts = table.groupBy("lang").agg(*k).select("lang", *d)
    with_d = _by_lang(table, discounts).withColumn("d", F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))).withColumn("context", _shift("gram"))
    context = with_d.groupBy("lang", "context").agg(F.sum(c).alias("total"), F.sum("d").alias("held"))
    own = _by_context(with_d, context, order).select("lang", "gram", ((c - F.col("d")) / F.col("total")).alias("own"))
    return own, context.select("lang", "context", (F.col("held") / F.col("total")).alias("backoff"))


def log_probabilities(counts: DataFrame) -> DataFrame:
    """(lang, gram, logp) of all rows of ``counts`` (lang, gram, c); rows with c = 0 are asked for only."""
    seen = {4: counts.where("c > 0")}
    for n, mask in ((3, _M48), (2, _M32), (1, _M16)):
        seen[n] = cut(seen[n + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.count("*").alias("c")), narrow=16)
    sizes = seen[1].groupBy("lang").agg((F.count("*") + 1).alias("v"))  # one more for what was never seen
    out = counts.select("lang", "gram")
    p = 1 / F.col("v")
    out = _by_lang(out, sizes)
    for n, mask in ((1, _M16), (2, _M32), (3, _M48), (4, None)):
        own, context = _order(seen[n], "c", n)
        key = F.col("gram") if mask is None else F.col("gram").bitwiseAND(F.lit(mask))
        out = out.withColumn("p", p).withColumn("key", key).withColumn("context", _shift("key"))
        out = _by_context(out.join(own.withColumnRenamed("gram", "key"), ["lang", "key"], "left"), context, n, "left")
        p = F.coalesce("own", F.lit(0.0)) + F.coalesce("backoff", F.lit(1.0)) * F.col("p")
        out = out.select("lang", "gram", p.alias("q"))
        p = F.col("q")
    return out.select("lang", "gram", F.ln("q").alias("logp"))


def perplexities(docs: DataFrame, trusted: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text_hash, lang, n_grams and log_perplexity of every row; ``trusted`` has the column doc_id.

    The result reads tables in ``scratch``."""
    blocks = max(1, scan_partitions(docs))
    spread = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int").alias("block")
    utf8 = F.coalesce("text", F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    parted = packed(docs.select(spread(F.coalesce(doc_id, F.xxhash64(utf8))), doc_id.alias("doc_id"), F.xxhash64(utf8).alias("text_hash"), F.coalesce("lang", F.lit("")).alias("lang"), utf8.alias("text")))
    ids = trusted.where("doc_id is not null").select(spread(doc_id), doc_id.alias("trusted_id")).distinct()
    asked = parted.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(lambda a, b: _count_block(a, b), "block int, lang string, gram long, n long")
    asked = scratch.keep(asked)
    counts = asked.groupBy("lang", "gram").agg(F.sum("n").alias("c"))
    answers = asked.select("block", "lang", "gram").join(log_probabilities(scratch.keep(counts, narrow=16)), ["lang", "gram"]).select("block", "lang", "gram", "logp")
    return parted.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda a, b: _score_block(a, b), "doc_id long, text_hash long, lang string, n_grams long, log_perplexity double")


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q")).where("q = 1").select("doc_id")


def classify(docs: DataFrame, labels: DataFrame, fence: float = FENCE, least: float = LEAST) -> DataFrame:
    """doc_id, text_hash, lang, n_grams, perplexity, its low and high bounds, and kept."""
    trusted = trusted_ids(labels)
    with Scratch(docs.sparkSession) as scratch:
        scores = cut(perplexities(docs, trusted, scratch), narrow=16)
    good = scores.join(trusted.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi").where("log_perplexity is not null")
    q = F.percentile_approx("log_perplexity", [0.25, 0.75], 10_000)
    bounds = good.groupBy("lang").agg(q.alias("q")).select("lang", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    reach = F.greatest(fence * (F.col("q3") - F.col("q1")), F.lit(least))
    bounds = bounds.select("lang", (F.col("q1") - reach).alias("lo"), (F.col("q3") + reach).alias("hi"))
    out = _by_lang(scores, bounds, "left").withColumn("perplexity", F.exp("log_perplexity"))
    slack = SHORT / F.sqrt("n_grams")
    out = out.withColumn("low", F.exp(F.col("lo") - slack)).withColumn("high", F.exp(F.col("hi") + slack))
    kept = F.coalesce((F.col("perplexity") >= F.col("low")) & (F.col("perplexity") <= F.col("high")), F.lit(True))
    return out.select("doc_id", "text_hash", "lang", "n_grams", "perplexity", "low", "high", kept.alias("kept"))


def op2_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", "n_grams", F.round("perplexity", 6).alias("perplexity"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "kept")
