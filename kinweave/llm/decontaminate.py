"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ from a passage by e = floor(RATE * m) edits. Cut into e + 1 pieces, at
least one piece must stand in the passage unchanged. One Aho-Corasick automaton finds all exact piece hits of a
text in one scan; around each hit, Myers' bit-parallel algorithm computes the smallest edit distance of the
item to any passage of the window, so nothing is missed and nothing is guessed.

Items go to the tasks in groups of at most GROUP characters (a fixed bound; a longer single item is a group of
its own), one pass over the texts a group. Text and items are compared in lower case with runs of white space as
one space; offsets are those of this form.

Defined results: null or blank items are ignored, null texts match nothing; items too short for an edit match
exactly, wherever they stand; repeated rows and repeated items each give their own result. Such short
items are found inside words, too, so a benchmark of short answers meets many documents. A very long text is searched whole.
Empty tables give an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import hand_back, holding, read_table

RATE = 0.06
GROUP = 8 << 20


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


class Pattern:
    """An item for Myers' algorithm: bit i of a character's mask is set where the item has it."""

    def __init__(self, text: str) -> None:
        self.size, self.top = len(text), 1 << (len(text) - 1)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | (1 << i)

    def best(self, text: str) -> tuple[int, int]:
        """The smallest distance to any passage of ``text`` and the first place where such a passage ends."""
        full, top, get = (1 << self.size) - 1, self.top, self.masks.get
        up, down, score, least, at = full, 0, self.size, self.size, 0
        for i, c in enumerate(text):
            eq = get(c, 0)
            x = eq | down
            h = (((eq & up) + up) ^ up) | eq
            ph = down | (full & ~(h | up))
            mh = up & h
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < least:
                    least, at = score, i + 1
            ph, mh = (ph << 1) & full, (mh << 1) & full
            up, down = mh | (full & ~(x | ph)), ph & x
        return least, at

    def prefix(self, text: str, distance: int) -> int:
        """The length of the shortest prefix of ``text`` at this distance of the whole item: as in ``best``, but a passage
        starts where the text does, so that each character before it costs one."""
        full, top, get = (1 << self.size) - 1, self.top, self.masks.get
        up, down, score = full, 0, self.size
        if score == distance:
            return 0
        for i, c in enumerate(text):
            eq = get(c, 0)
            x = eq | down
            h = (((eq & up) + up) ^ up) | eq
            ph = down | (full & ~(h | up))
            mh = up & h
            score += (1 if ph & top else 0) - (1 if mh & top else 0)
            if score == distance:
                return i + 1
            ph, mh = ((ph << 1) | 1) & full, (mh << 1) & full
            up, down = mh | (full & ~(x | ph)), ph & x
        return len(text)


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float = RATE) -> None:
        self.items = [(k, p) for k, t in items if (p := plain(t))]
        self.budget = [int(rate * len(p)) for _, p in self.items]
        self.forward = [Pattern(p) for _, p in self.items]
        self.backward: dict[int, Pattern] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for n, ((_, p), e) in enumerate(zip(self.items, self.budget)):
            ends = [len(p) * (k + 1) // (e + 1) for k in range(e + 1)]
            for start, end in zip([0, *ends], ends):
                found.setdefault(p[start:end], []).append((n, start))
        self.pieces = ahocorasick.Automaton()
        for piece, places in found.items():
            self.pieces.add_word(piece, (len(piece), places))
        if found:
            self.pieces.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of each item that the text holds: its best passage, the first of equals."""
        text, windows, out = plain(text), {}, []
        if not self.items or not text:
            return out
        for end, (size, places) in self.pieces.iter(text):
            for n, offset in places:
                first, e = end + 1 - size - offset, self.budget[n]
                windows.setdefault(n, []).append((max(0, first - e), min(len(text), first + self.forward[n].size + e)))
        for n, spans in windows.items():
            merged: list[list[int]] = []
            for lo, hi in sorted(spans):
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            best = min((self.forward[n].best(text[lo:hi]) + (lo,) for lo, hi in merged), key=lambda x: (x[0], x[2] + x[1]))
            distance, end, lo = best
            if distance <= self.budget[n]:
                if n not in self.backward:
                    self.backward[n] = Pattern(self.items[n][1][::-1])
                reach = text[max(lo, lo + end - self.forward[n].size - distance) : lo + end][::-1]
                back = self.backward[n].prefix(reach, distance)
                out.append((self.items[n][0], distance, lo + end - back, lo + end))
        return sorted(out)


_MATCHERS: dict[str, Matcher] = {}


def _forget() -> None:
    _MATCHERS.clear()


def _matcher(items: list[tuple[int, str]], rate: float) -> Matcher:
    key = hashlib.sha256(repr((items, rate)).encode()).hexdigest()
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items, rate)
    return _MATCHERS[key]


def item_groups(benchmark: DataFrame, most: int = GROUP) -> Iterator[list[tuple[int, str]]]:
    """The items in groups of bounded size, read one partition at a time."""
    group, size = [], 0
    for r in benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").toLocalIterator():
        if group and size + len(r[1]) > most:
            yield group
            group, size = [], 0
        group.append((r[0], r[1]))
        size += len(r[1])
    if group:
        yield group


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance, start, end) for each document and each item it holds."""
    schema = "doc_id long, item_id long, distance int, start int, end int"
    src = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for group in item_groups(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            holding("decontaminate", _forget)
            matcher = _matcher(shared.value, rate)
            for b in batches:
                rows = [(d.as_py(), *hit) for d, t in zip(b.column("doc_id"), b.column("text")) for hit in matcher.find(t.as_py())]
                cols = list(zip(*rows)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "distance", "start", "end"])
            hand_back()

        part = src.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents, all columns, that hold no item; a row is judged by its own text, nothing is shuffled."""
    for group in item_groups(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            holding("decontaminate", _forget)
            matcher = _matcher(shared.value, rate)
            for b in batches:
                yield b.filter(pa.array([not matcher.find(t.as_py()) for t in b.column("text")], pa.bool_()))
            hand_back()

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op5_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
