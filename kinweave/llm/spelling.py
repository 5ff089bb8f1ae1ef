"""Spelling variants: words one edit apart, found with forward and backward minimal acyclic automata.

An edit touches one half of a word, so the other half of it stands in the near word as it is. Each word therefore asks
twice: with its first half exactly and one error in the rest, and with its second half exactly and one error before it. Words
that may answer meet what asks in a bucket by that exact part (a near word is one shorter, as long or one longer, so
it has two parts of each kind). A bucket builds the minimal acyclic automaton of its words, read forward or backward, whose
nodes count the words behind them: a path's sum is the word's number (a perfect hash), by which counts are looked up. The exact
part is walked, the rest completed with one error.

An exact part that over LIMIT rows share is split: the rest of the word is halved again, one of its halves must be exact,
too, and joins the part; until parts are under LIMIT, which comes at the latest when the rest has two characters. So no bucket
is more than its own words and LIMIT rows large, whatever words the corpus has, and no pairs of a bucket are compared.

1. tasks count words of whole texts, partial counts are summed by word;
2. words and parts go to buckets, which emit the near pairs; a pair found both ways is one;
3. a word's near words (at most some hundreds) are counted and its form picked;
4. roots by pointer doubling over the words that have a form.

Defined results: a null or empty text has no words; a null doc_id is the empty string in what is hashed; documents that
repeat count as often as they stand. A very long text is read in parts that end between words. Empty tables give an empty
result. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import Scratch, cut, hand_back, holding, read_table, texts

LEAST_LENGTH, LEAST_COUNT, EDIT_EVERY = 5, 3, 97
LIMIT, BUCKET = 20_000, 16_000  # rows of one exact part; rows of a bucket of many parts
PIECE, HELD = 1 << 20, 1 << 18  # bytes split at once; words counted before they are handed on
# Latin-1 bytes of a text: letters A-Z lower-cased, a-z and U+00C0 to U+00FF as they are, all else a space.
_LETTER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str) -> Iterator[list[bytes]]:
    """The lower-cased runs of letters as Latin-1 bytes, a code point each, in lists from about PIECE bytes."""
    b = text.encode("latin-1", "replace").translate(_LETTER)
    at = 0
    while at < len(b):
        end = b.find(b" ", at + PIECE) if len(b) - at > PIECE else -1
        end = len(b) if end < 0 else end
        yield b[at:end].split()
        at = end


def edited(doc_id: int | None, run: bytes) -> bytes:
    """The run, without one of its code points where the hash of document and run asks for that."""
    h = crc32(run if run.isascii() else run.decode("latin-1").encode(), crc32(f"{'' if doc_id is None else doc_id}:".encode()))
    if h % EDIT_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the words long and frequent enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("spelling")
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            kept = [w for w in seen if len(w) >= LEAST_LENGTH]
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in kept], pa.string()), pa.array([seen[w] for w in kept], pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                for found in runs(text.as_py()):
                    for run, n in Counter(found).items():
                        if len(run) >= LEAST_LENGTH:
                            seen[edited(doc_id, run)] += n
                    if len(seen) > HELD:
                        yield flush()
        yield flush()
        hand_back()

    parts = texts(docs).select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Automaton:
    """The minimal acyclic automaton of distinct words, given sorted; word numbers are places in that order."""

    def __init__(self, words: Sequence[str]) -> None:
        self.edges: list[dict[str, int]] = []  # of each node: letter to node
        self.before: list[dict[str, int]] = []  # and to the number of words that sort before those behind that edge
        self.final: list[bool] = []
        self.size: list[int] = []
        known: dict[tuple, int] = {}
        open_: list[tuple[dict[str, int], bool]] = [({}, False)]
        last = ""

        def close(depth: int) -> None:
            while len(open_) > depth + 1:
                edges, final = open_.pop()
                key = (final, *edges.items())
                if key not in known:
                    known[key] = self._node(edges, final)
                open_[-1][0][last[len(open_) - 1]] = known[key]

        for w in words:
            common = 0
            while common < len(last) and common < len(w) and last[common] == w[common]:
                common += 1
            close(common)
            for _ in w[common:]:
                open_.append(({}, False))
            open_[-1] = (open_[-1][0], True)
            last = w
        close(0)
        self.start = self._node(*open_[0])

    def _node(self, edges: dict[str, int], final: bool) -> int:
        total, before = int(final), {}
        for c, to in edges.items():
            before[c] = total
            total += self.size[to]
        self.edges.append(edges)
        self.before.append(before)
        self.final.append(final)
        self.size.append(total)
        return len(self.edges) - 1

    def walk(self, node: int, number: int, letters: str) -> tuple[int, int]:
        """The node and number behind ``letters``; node -1 where there is none."""
        edges, before = self.edges, self.before
        for c in letters:
            to = edges[node].get(c, -1)
            if to < 0:
                return -1, 0
            number += before[node][c]
            node = to
        return node, number

    def near(self, word: str, exact: int, tail: int) -> set[int]:
        """Numbers of the words that differ from ``word`` by one edit behind its first ``exact`` letters and before its
        last ``tail`` ones."""
        found: set[int] = set()
        node, number = self.walk(self.start, 0, word[:exact])
        stop = len(word) - tail

        def finish(node: int, number: int, rest: str) -> None:
            node, number = self.walk(node, number, rest)
            if node >= 0 and self.final[node]:
                found.add(number)

        for i in range(exact, stop + 1):
            if node < 0:
                break
            here, rest, shorter = (word[i] if i < stop else ""), word[i:], word[i + 1 :]
            if here:
                finish(node, number, shorter)
            for c, to in self.edges[node].items():
                n = number + self.before[node][c]
                finish(to, n, rest)
                if here and c != here:
                    finish(to, n, shorter)
            if here:
                node, number = self.walk(node, number, here)
        return found


def _bucket(rows: pa.Table) -> pa.Table:
    """The near pairs of a bucket, whose rows are all read in one direction."""
    holding("spelling")
    forward = rows.column("forward")[0].as_py()
    turn = (lambda w: w) if forward else (lambda w: w[::-1])
    count = dict(zip(map(turn, rows.column("word").to_pylist()), rows.column("n").to_pylist(), strict=True))
    words = sorted(count)
    automaton = Automaton(words)
    asking = rows.filter(rows.column("asks"))
    out: tuple[list, list, list, list] = ([], [], [], [])
    for w, n, head, tail in zip(*(asking.column(c).to_pylist() for c in ("word", "n", "head", "tail")), strict=True):
        for k in automaton.near(turn(w), head if forward else tail, tail if forward else head):
            for column, value in zip(out, (w, n, turn(words[k]), count[words[k]]), strict=True):
                column.append(value)
    hand_back()
    return pa.table({"word": pa.array(out[0], pa.string()), "n": pa.array(out[1], pa.int64()), "near": pa.array(out[2], pa.string()), "near_n": pa.array(out[3], pa.int64())})


def _halved(rows: DataFrame) -> DataFrame:
    """Rows (word, n, head, tail, asks) with the rest of the word, between head and tail, halved: one half joins the exact
    part. What may answer does so for a word whose rest is one shorter, as long and one longer."""
    m = "(length(word) - head - tail)"
    asks = f"asks and x = {m}"
    kids = f"""flatten(transform(filter(sequence({m} - 1, {m} + 1), x -> x >= 0), x -> if(x <= 1,
      array(struct(head as head, tail as tail, {asks} as asks)),
      array(struct(head + x div 2 as head, tail as tail, {asks} as asks), struct(head as head, tail + x - x div 2 as tail, {asks} as asks)))))"""
    kids = f"transform({kids}, k -> struct(cast(k.head as int) as head, cast(k.tail as int) as tail, k.asks as asks))"
    once = "array_distinct(filter(kids, k -> k.asks or not exists(kids, j -> j.asks and j.head = k.head and j.tail = k.tail)))"
    out = rows.withColumn("kids", F.expr(kids)).select("word", "n", F.explode(F.expr(once)).alias("k"))
    return out.select("word", "n", "k.head", "k.tail", "k.asks", F.expr("concat(left(word, k.head), '|', right(word, k.tail))").alias("part"))


def near_pairs(words: DataFrame, scratch: Scratch, limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """(word, n, near, near_n) of all ordered pairs of ``words`` (word, n; distinct) that are one edit apart; may repeat rows."""
    if limit < 10_000:
        raise ValueError("parts are surely small only from some 10,000 rows on: two free letters of an alphabet of 90")
    return _near_pairs(words, scratch, limit, bucket)


def _near_pairs(words: DataFrame, scratch: Scratch, limit: int, bucket: int, levels: int = 64) -> DataFrame:
    rows = scratch.keep(_halved(words.select("word", "n", F.lit(0).alias("head"), F.lit(0).alias("tail"), F.lit(True).alias("asks"))), narrow=16)
    settled = []
    for _ in range(levels):
        hot = scratch.keep(rows.groupBy("part").count().where(F.col("count") > limit).select("part"), narrow=2)
        if hot.isEmpty():
            break
        settled.append(rows.join(hot, "part", "left_anti"))
        rows = scratch.keep(_halved(rows.join(hot, "part", "left_semi").drop("part")), narrow=16)
    for s in settled:
        rows = rows.unionByName(s)
    buckets = max(1, -(-rows.count() // bucket))
    forward = F.length(F.substring_index("part", "|", 1)) >= F.length(F.substring_index("part", "|", -1))
    dealt = rows.select("word", "n", "head", "tail", "asks", forward.alias("forward"), F.pmod(F.xxhash64("part"), F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket", "forward").applyInArrow(_bucket, "word string, n long, near string, near_n long")


def with_roots(words: DataFrame) -> DataFrame:
    """``words`` (word, form, ...) with root: where forms lead to from the word. Forms must not run in circles."""
    links = cut(words.where("form is not null").select("word", F.col("form").alias("root")), narrow=16)
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = cut(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), narrow=16)
        links = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    return words.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(words: DataFrame, limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """word, form, root, n, n_near and form_n of all ``words`` (word, n; distinct)."""
    with Scratch(words.sparkSession) as scratch:
        words = scratch.keep(words.select("word", "n"), narrow=16)
        alone = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
        pairs = near_pairs(words, scratch, limit, bucket).unionByName(alone).repartition("word").dropDuplicates(["word", "near"])
        best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("w")))).alias("best")
        found = pairs.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best)
        ok = -F.col("best.k") >= 2 * F.col("n")
        found = cut(found.select("word", "n", "n_near", F.when(ok, F.col("best.w")).alias("form"), F.when(ok, -F.col("best.k")).alias("form_n")), narrow=16)
    return with_roots(found).select("word", "form", "root", "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(read_table(spark, sf_dir, "documents")))
