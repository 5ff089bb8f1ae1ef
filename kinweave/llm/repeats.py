"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that also starts in an earlier document.

The suffix array is sharded without losing a repeat. Every string of LENGTH = 50 bytes holds 26 grams of 25
bytes; the smallest hash among them is chosen wherever the string stands, so equal strings meet at their chosen
gram. Around a chosen gram, all such strings lie in a segment of 75 bytes.

1. Blocks of documents name the hashes of their chosen grams; shards by hash find those that stand in several
   documents, and answer each block. A gram in more than HOT documents is marked hot.
2. Blocks send the distinct segments around repeated grams to the shards, each with the smallest and largest document
   that has it. Around hot grams (a common line in ever new surroundings), each string of 50 bytes goes on its own,
   to the shard of its own hash, so no shard gets an unbounded group.
3. A shard groups segments by gram. A gram with one segment is settled by that segment's smallest document. The
   segments of the others form the shard's enhanced suffix array; a stack scan of its common-prefix intervals with
   the test for different left extensions gives the maximal repeats with all occurrences, and each repeat's
   smallest document goes to all the strings of 50 bytes in it.
4. Blocks get the answers for their segments, and mark what is covered.

Texts are shuffled by block for each of the three steps that read them; the shuffle files of a finished step are
released before the next.

Defined results: a null or empty text has 0 bytes and loses none; a row with a null doc_id neither loses bytes nor
takes any from others; rows with one doc_id are no copies of one another; extra columns are ignored. A
very long text is read whole, in segments. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import cut, hand_back, holding, read_table
from kinweave.llm.suffix_repeats import bucket_order, common_prefixes, maximal_intervals

LENGTH, GRAM = 50, 25
SPAN = LENGTH - GRAM + 1  # strings around a gram; also bytes on either side, and one more
SEGMENT = 2 * LENGTH - GRAM
HOT = 20_000
PART = 6 << 20  # bytes of text that a block has, and a shard gets the grams of
_CHUNK = 1 << 18
_SETTLE = 1 << 15  # segments whose suffixes are sorted at once, or a larger group
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _D
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    w = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))
    x = w[:n] * _A
    x ^= x >> np.uint64(32)
    x = (x + w[8 : 8 + n]) * _B
    x ^= x >> np.uint64(29)
    x = (x + w[16 : 16 + n]) * _C
    x ^= x >> np.uint64(32)
    return _mix(x + data[24 : 24 + n]) | np.uint64(1)  # 0 stands for none below


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


@dataclass
class Chosen:
    """Chosen grams of a run of documents laid one behind another."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray
    hashes: np.ndarray
    owner: np.ndarray


def _choose(texts: list[bytes]) -> Chosen:
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    empty = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return Chosen(data, starts, ends, empty, empty.astype(np.uint64), empty)
    h = _gram_hashes(data)
    low = _sliding(h, SPAN, np.minimum)  # of the string that starts here
    across = (ends[:-1, None] - np.arange(1, LENGTH)[None, :]).ravel()  # no string crosses documents
    low[across[(across >= 0) & (across < len(low))]] = 0
    around = np.concatenate([np.zeros(SPAN - 1, np.uint64), low, np.zeros(SPAN - 1, np.uint64)])
    at = np.flatnonzero(_sliding(around, SPAN, np.maximum) == h)
    return Chosen(data, starts, ends, at, h[at], np.searchsorted(ends, at, "right"))


def _runs(lengths: list[int]) -> Iterator[slice]:
    """Runs of documents of about _CHUNK bytes."""
    at = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > _CHUNK:
            yield slice(at, i)
            at, total = i, 0
        total += n
    if at < len(lengths):
        yield slice(at, len(lengths))


def _block(docs: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    holding("repeats")
    return docs.column("doc_id").to_numpy().astype(np.int64), [x.as_py() for x in docs.column("utf8")]


def _split(shard: np.ndarray, shards: int) -> np.ndarray:
    """Bounds of the shards in entries sorted by shard."""
    return np.searchsorted(shard, np.arange(shards + 1))


def _u64(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


def _empty(schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "long": pa.int64()}
    return pa.table({n: pa.array([], kinds[k]) for n, k in (x.split() for x in schema.split(", "))})


# Step 1: which grams repeat


def _distinct(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, sorted."""
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]


ASK = "block int, shard int, one binary, several binary, times binary"


def _ask(docs: pa.Table, shards: int) -> pa.Table:
    """A block's distinct hashes by shard: those in one of its documents, and those in several with their number."""
    if not docs.num_rows:
        return _empty(ASK)
    ids, texts = _block(docs)
    found = []
    for run in _runs([len(t) for t in texts]):
        c = _choose(texts[run])
        found.append(_distinct(c.hashes, ids[run][c.owner]))
    h, _ = _distinct(*(np.concatenate(x) for x in zip(*found)))
    keys, times = np.unique(h, return_counts=True)
    shard = (keys % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    keys, times, bounds = keys[order], times[order].astype(np.uint32), _split(shard[order], shards)
    rows = []
    for s in range(shards):
        k, t = keys[bounds[s] : bounds[s + 1]], times[bounds[s] : bounds[s + 1]]
        if len(k):
            rows.append((s, k[t == 1].tobytes(), k[t > 1].tobytes(), t[t > 1].tobytes()))
    cols = list(zip(*rows)) or [()] * 4
    block = docs.column("block")[0].as_py()
    return pa.table({"block": pa.array([block] * len(rows), pa.int32()), "shard": pa.array(cols[0], pa.int32()), **{n: pa.array(c, pa.binary()) for n, c in zip(("one", "several", "times"), cols[1:])}})


ANSWER = "block int, kind int, shard int, a binary, b binary, c binary, d binary"


def _answers(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [()] * 7
    return pa.table({"block": pa.array(cols[0], pa.int32()), "kind": pa.array(cols[1], pa.int32()), "shard": pa.array(cols[2], pa.int32()), **{n: pa.array(c, pa.binary()) for n, c in zip("abcd", cols[3:])}})


def _repeated(asked: pa.Table, hot: int) -> pa.Table:
    """Of a shard: for each block, its hashes that stand in several documents (a), and which of them are hot (b)."""
    if not asked.num_rows:
        return _empty(ANSWER)
    one, several = [_u64(x.as_py()) for x in asked.column("one")], [_u64(x.as_py()) for x in asked.column("several")]
    times = [np.frombuffer(x.as_py(), np.uint32) for x in asked.column("times")]
    keys, inverse = np.unique(np.concatenate([*one, *several]), return_inverse=True)
    weight = np.concatenate([np.ones(sum(map(len, one)), np.int64), *times])
    total = np.bincount(inverse, weight, len(keys))
    rows, shard = [], asked.column("shard")[0].as_py()
    for block, x, y in zip(asked.column("block").to_pylist(), one, several):
        k = np.concatenate([x, y])
        n = total[np.searchsorted(keys, k)]
        k, n = k[n > 1], n[n > 1]
        if len(k):
            order = np.argsort(k)
            rows.append((block, 0, shard, k[order].tobytes(), (n[order] > hot).tobytes(), b"", b""))
    return _answers(rows)


# Step 2: segments around repeated grams


@dataclass
class Entries:
    """Segments to settle, one a place; key is what shards and groups them."""

    key: np.ndarray
    segment: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    at: np.ndarray
    owner: np.ndarray

    def identity(self) -> np.ndarray:
        return _identity(self.key, self.segment, self.lo, self.hi)


def _identity(key: np.ndarray, segment: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """128-bit hashes of entries, as two rows; a segment's bytes outside its strings are zero."""
    x = _mix(key ^ (lo.astype(np.uint64) << np.uint64(8)) ^ hi.astype(np.uint64))
    y = x ^ _C
    padded = np.zeros((len(segment), 80), np.uint8)
    padded[:, :SEGMENT] = segment
    for w in padded.view("<u8").T:
        x = _mix((x + w) * _A)
        y = _mix((y ^ w) * _B)
    return np.stack([x, y])


def _unique(ident: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct identities in order, the first place of each, and the number of each place's identity."""
    x, y = ident
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    inverse = np.empty(len(x), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return np.stack([x[new], y[new]]), order[new], inverse


def _entries(c: Chosen, repeated: np.ndarray, hot: np.ndarray) -> Entries:
    place = np.searchsorted(repeated, c.hashes)
    hit = np.zeros(len(c.at), bool)
    if len(repeated):
        place[place == len(repeated)] = 0
        hit = repeated[place] == c.hashes
    at, key, owner, very = c.at[hit], c.hashes[hit], c.owner[hit], (hot[place[hit]] if len(repeated) else np.zeros(0, bool))
    padded = np.concatenate([np.zeros(SPAN - 1, np.uint8), c.data, np.zeros(SEGMENT, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, SEGMENT)
    segment = view[at]
    lo = np.maximum(0, c.starts[owner] - (at - (SPAN - 1)))
    hi = np.minimum(SPAN - 1, c.ends[owner] - LENGTH - (at - (SPAN - 1)))
    fits = lo <= hi
    at, key, owner, very, segment, lo, hi = (x[fits] for x in (at, key, owner, very, segment, lo, hi))
    if very.any():  # each string on its own, under its own hash
        rows = np.flatnonzero(very)
        n = hi[rows] - lo[rows] + 1
        row = np.repeat(rows, n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[row]
        columns = np.arange(SEGMENT)[None, :]
        alone = np.where((columns >= j[:, None]) & (columns < j[:, None] + LENGTH), segment[row], 0).astype(np.uint8)
        shifted = np.zeros((len(row), SEGMENT), np.uint8)
        shifted[:, :LENGTH] = np.take_along_axis(alone, j[:, None] + np.arange(LENGTH)[None, :], 1)
        zero = np.zeros(len(row), np.int64)
        own = _identity(zero.astype(np.uint64), shifted, zero, zero)[0]
        keep = ~very
        at, key, owner = np.concatenate([at[keep], at[row] + j]), np.concatenate([key[keep], own]), np.concatenate([owner[keep], owner[row]])
        segment, lo, hi = np.concatenate([segment[keep], shifted]), np.concatenate([lo[keep], zero]), np.concatenate([hi[keep], zero])
    columns = np.arange(SEGMENT)[None, :]
    segment = np.where((columns >= lo[:, None]) & (columns < hi[:, None] + LENGTH), segment, 0).astype(np.uint8)
    return Entries(key, segment, lo.astype(np.uint8), hi.astype(np.uint8), at, owner)


def _repeated_of(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    own = [(r["a"], r["b"]) for r in answers.filter(pa.compute.equal(answers.column("kind"), 0)).to_pylist()]
    keys = np.concatenate([_u64(a) for a, _ in own]) if own else np.empty(0, np.uint64)
    hot = np.concatenate([np.frombuffer(b, bool) for _, b in own]) if own else np.empty(0, bool)
    order = np.argsort(keys)
    return keys[order], hot[order]


SEND = "block int, shard int, key binary, segment binary, bounds binary, docs binary"


def _send(docs: pa.Table, answers: pa.Table, shards: int) -> pa.Table:
    """A block's distinct segments by shard, in the order of their identities."""
    if not docs.num_rows or not answers.num_rows:
        return _empty(SEND)
    import zstandard

    ids, texts = _block(docs)
    repeated, hot = _repeated_of(answers)
    parts = []
    for run in _runs([len(t) for t in texts]):
        e = _entries(_choose(texts[run]), repeated, hot)
        if len(e.at):
            who = ids[run][e.owner]
            ident, first, inverse = _unique(e.identity())
            least, most = np.full(len(first), np.iinfo(np.int64).max), np.full(len(first), np.iinfo(np.int64).min)
            np.minimum.at(least, inverse, who)
            np.maximum.at(most, inverse, who)
            parts.append((ident, e.key[first], e.segment[first], e.lo[first], e.hi[first], least, most))
    if not parts:
        return _empty(SEND)
    ident = np.concatenate([x[0] for x in parts], 1)
    key, segment, lo, hi, least, most = (np.concatenate(x) for x in list(zip(*parts))[1:])
    del parts
    _, first, inverse = _unique(ident)
    low, high = np.full(len(first), np.iinfo(np.int64).max), np.full(len(first), np.iinfo(np.int64).min)
    np.minimum.at(low, inverse, least)
    np.maximum.at(high, inverse, most)
    key, segment, lo, hi = key[first], segment[first], lo[first], hi[first]
    shard = (key % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    bounds = _split(shard[order], shards)
    pack = zstandard.ZstdCompressor(3).compress
    rows = []
    for s in range(shards):
        o = order[bounds[s] : bounds[s + 1]]
        if len(o):
            rows.append((s, key[o].tobytes(), pack(segment[o].tobytes()), np.stack([lo[o], hi[o]]).tobytes(), pack(np.stack([low[o], high[o]]).tobytes())))
    cols = list(zip(*rows))
    block = docs.column("block")[0].as_py()
    return pa.table({"block": pa.array([block] * len(rows), pa.int32()), "shard": pa.array(cols[0], pa.int32()), **{n: pa.array(c, pa.binary()) for n, c in zip(("key", "segment", "bounds", "docs"), cols[1:])}})


# Step 3: the enhanced suffix array of a shard


def _settle(segment: np.ndarray, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each segment and string in it, the smallest document that has the string, by the maximal repeats."""
    n = len(segment)
    out = np.repeat(doc[:, None], SPAN, 1)
    size = hi.astype(np.int64) + LENGTH - lo
    columns = np.arange(SEGMENT)[None, :]
    data = segment[(columns >= lo[:, None]) & (columns < (lo + size)[:, None])]
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(n), size)
    remaining = ends[owner] - np.arange(len(data))
    starts = np.flatnonzero(remaining >= LENGTH)
    sa = bucket_order(data, remaining, starts, LENGTH)
    lcp = common_prefixes(data, sa, remaining[sa])
    who = owner[sa]
    begin = ends[who] - size[who]
    left = np.where(sa > begin, data[sa - 1].astype(np.int64), -1)
    intervals = np.array(maximal_intervals(lcp, left, LENGTH), np.int64).reshape(-1, 3)
    if not len(intervals):
        return out
    a, b, length = intervals.T
    edges = np.stack([a, b], 1).ravel()
    least = np.minimum.reduceat(np.append(doc[who], np.iinfo(np.int64).max), edges)[::2]
    for at in range(0, len(a), 100_000):
        part = slice(at, at + 100_000)
        count = (b - a)[part]
        row = np.repeat(np.arange(len(count)), count)
        member = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + a[part][row]
        where, j = who[member], lo[who[member]] + sa[member] - begin[member]
        for t in range(SPAN):
            go = length[part][row] - LENGTH >= t
            if not go.any():
                break
            np.minimum.at(out, (where[go], j[go] + t), least[part][row[go]])
    return out


def _settle_groups(segment: np.ndarray, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray, group: np.ndarray) -> np.ndarray:
    """``_settle`` by runs of whole groups, as a suffix takes far more memory than its byte; equal strings are in one group."""
    out = np.empty((len(segment), SPAN), np.int64)
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.diff(group[order], prepend=-1))  # of each group
    bounds = np.append(first[np.flatnonzero(np.diff(first // _SETTLE, prepend=-1))], len(order))
    for a, b in zip(bounds[:-1], bounds[1:]):
        rows = order[a:b]
        out[rows] = _settle(segment[rows], lo[rows], hi[rows], doc[rows])
    return out


def _settle_shard(sent: pa.Table) -> pa.Table:
    """Of a shard: for each block, runs of strings (place of the segment, first, last) with their smallest document."""
    if not sent.num_rows:
        return _empty(ANSWER)
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    key = [_u64(x.as_py()) for x in sent.column("key")]
    sizes = [len(k) for k in key]
    key = np.concatenate(key)
    segment = np.frombuffer(b"".join(unpack(x.as_py()) for x in sent.column("segment")), np.uint8).reshape(-1, SEGMENT)
    lo, hi = np.concatenate([np.frombuffer(x.as_py(), np.uint8).reshape(2, -1) for x in sent.column("bounds")], 1)
    low, high = np.concatenate([np.frombuffer(unpack(x.as_py()), np.int64).reshape(2, -1) for x in sent.column("docs")], 1)
    _, first, inverse = _unique(_identity(key, segment, lo, hi))
    doc = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(doc, inverse, low)
    _, group, times = np.unique(key[first], return_inverse=True, return_counts=True)
    ragged = np.flatnonzero(times[group] > 1)
    place = np.full(len(first), -1, np.int64)
    place[ragged] = np.arange(len(ragged))
    rows = first[ragged]
    table = _settle_groups(segment[rows], lo[rows].astype(np.int64), hi[rows].astype(np.int64), doc[ragged], group[ragged])
    out, at, shard = [], 0, sent.column("shard")[0].as_py()
    for block, n in zip(sent.column("block").to_pylist(), sizes):
        mine = slice(at, at + n)
        at += n
        u, l, h, most = inverse[mine], lo[mine].astype(np.int64), hi[mine].astype(np.int64), high[mine]
        single = place[u] < 0
        i1 = np.flatnonzero(single & (doc[u] < most))
        i2 = np.flatnonzero(~single)
        parts = [(i1, l[i1], h[i1], doc[u[i1]])]
        if len(i2):
            m, j = table[place[u[i2]]], np.arange(SPAN)[None, :]
            inside = (j >= l[i2][:, None]) & (j <= h[i2][:, None])
            m = np.where(inside & (m < most[i2][:, None]), m, np.iinfo(np.int64).max)
            change = np.ones(m.shape, bool)
            change[:, 1:] = m[:, 1:] != m[:, :-1]
            r, c = np.nonzero(change)
            stop = np.append(c[1:], 0)
            stop[stop == 0] = SPAN
            v = m[r, c]
            keep = v < np.iinfo(np.int64).max
            parts.append((i2[r[keep]], c[keep], stop[keep] - 1, v[keep]))
        i, f, l2, d = (np.concatenate(x) for x in zip(*parts))
        if len(i):
            out.append((block, 1, shard, i.astype(np.uint32).tobytes(), f.astype(np.uint8).tobytes(), l2.astype(np.uint8).tobytes(), d.astype(np.int64).tobytes()))
    return _answers(out)


# Step 4: what is covered


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed binary"


def _cover(docs: pa.Table, answers: pa.Table, shards: int, with_spans: bool) -> pa.Table:
    if not docs.num_rows:
        return _empty(RESULT)
    ids, texts = _block(docs)
    known = pa.array(docs.column("known")).to_numpy(zero_copy_only=False) if docs.num_rows else np.empty(0, bool)
    repeated, hot = _repeated_of(answers) if answers.num_rows else (np.empty(0, np.uint64), np.empty(0, bool))
    runs = list(_runs([len(t) for t in texts]))
    settled = {r["shard"]: r for r in answers.to_pylist() if r["kind"] == 1} if answers.num_rows else {}
    table, held = None, []
    if settled:  # the block's segments in the order in which they were sent
        for run in runs:
            e = _entries(_choose(texts[run]), repeated, hot)
            held.append((e.identity(), e.key, e.at, e.owner))
        _, first, inverse = _unique(np.concatenate([x[0] for x in held], 1))
        number = np.split(inverse, np.cumsum([len(x[2]) for x in held])[:-1])
        shard = (np.concatenate([x[1] for x in held])[first] % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        bounds = _split(shard[order], shards)
        which, f, l, d = [], [], [], []
        for s, r in settled.items():
            which.append(order[bounds[s] : bounds[s + 1]][np.frombuffer(r["a"], np.uint32)])
            f.append(np.frombuffer(r["b"], np.uint8))
            l.append(np.frombuffer(r["c"], np.uint8))
            d.append(np.frombuffer(r["d"], np.int64))
        which, f, l, d = (np.concatenate(x) for x in (which, f, l, d))
        o = np.argsort(which, kind="stable")
        table = number, np.searchsorted(which[o], np.arange(len(first) + 1)), f[o].astype(np.int64), l[o].astype(np.int64), d[o]
    rows = []
    for k, run in enumerate(runs):
        marks = None
        if table is not None:
            number, bounds, f, l, d = table
            _, _, at, owner = held[k]
            u = number[k]
            n = bounds[u + 1] - bounds[u]
            row = np.repeat(np.arange(len(u)), n)
            run_at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + bounds[u[row]]
            earlier = (d[run_at] < ids[run][owner[row]]) & known[run][owner[row]]
            row, run_at = row[earlier], run_at[earlier]
            base, data = at[row] - (SPAN - 1), np.frombuffer(b"".join(texts[run]), np.uint8)
            marks = np.zeros(len(data) + 1, np.int64)
            np.add.at(marks, base + f[run_at], 1)
            np.add.at(marks, base + l[run_at] + LENGTH, -1)
            marks = np.cumsum(marks)[:-1] > 0
        at = 0
        for text in texts[run]:
            if marks is None:
                rows.append((len(text), 0, 0, hashlib.sha256(text).hexdigest(), b""))
            else:
                m = marks[at : at + len(text)]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], m, [False]]).astype(np.int8))).astype(np.int64)
                kept = data[at : at + len(text)][~m].tobytes()
                rows.append((len(text), int(m.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), edges.tobytes() if with_spans else b""))
            at += len(text)
    cols = list(zip(*rows))
    doc_id = pa.array(ids, mask=~known)
    return pa.table({"doc_id": doc_id, "n_bytes": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()), "n_spans": pa.array(cols[2], pa.int64()), "kept_sha256": pa.array(cols[3], pa.string()), "removed": pa.array(cols[4], pa.binary())})


def _released(step: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A step of one group that leaves no freed memory with the worker, which takes many groups in turn."""

    def run(group: pa.Table) -> pa.Table:
        out = step(group)
        hand_back()
        return out

    return run


def _cogroup(step: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out = step(docs, answers)
        hand_back()
        return out

    return run


def parts(docs: DataFrame) -> int:
    """How many blocks and shards: by the bytes of the texts, as the scan's partitions may be of any size."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(2, -(-total // PART))


def remove_repeats(docs: DataFrame, hot: int = HOT, with_spans: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and removed (with_spans: 64-bit starts and ends of the runs) of every row."""
    shards = blocks = parts(docs)
    doc_id, utf8 = F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary")
    # a row without an id is last of all: it takes nothing from others, and is never marked
    parted = docs.select(F.pmod(F.xxhash64(F.coalesce(doc_id, F.xxhash64("text"))), F.lit(blocks)).cast("int").alias("block"), F.coalesce(doc_id, F.lit(2**63 - 1)).alias("doc_id"), doc_id.isNotNull().alias("known"), utf8.alias("utf8"))
    by_block = parted.groupBy("block")
    asked = by_block.applyInArrow(_released(lambda t: _ask(t, shards)), ASK)
    repeated = cut(asked.groupBy("shard").applyInArrow(_released(lambda t: _repeated(t, hot)), ANSWER))
    sent = by_block.cogroup(repeated.groupBy("block")).applyInArrow(_cogroup(lambda t, a: _send(t, a, shards)), SEND)
    settled = cut(sent.groupBy("shard").applyInArrow(_released(_settle_shard), ANSWER))
    answers = repeated.union(settled)
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(_cogroup(lambda t, a: _cover(t, a, shards, with_spans)), RESULT)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).drop("removed")


OP9_SQL = """with b as (select doc_id, hex(encode(coalesce(text, ''))) x, strlen(coalesce(text, '')) n from documents),
 win as (select doc_id, i, substr(x, 2 * i - 1, 100) s from b, lateral (select unnest(generate_series(1, n - 49)) i) where n >= 50),
 least_doc as (select s, min(doc_id) f from win group by 1),
 hit as (select doc_id, i from win join least_doc using (s) where f < doc_id),
 cov as (select distinct doc_id, i + j p from hit, (select unnest(generate_series(0, 49)) j)),
 run as (select doc_id, count(*) n_removed, sum(fresh) n_spans from (select doc_id, case when p - lag(p) over (partition by doc_id order by p) = 1 then 0 else 1 end fresh from cov) group by 1),
 part as (select doc_id, string_agg(substr(x, 2 * i - 1, 2), '' order by i) k from b, lateral (select unnest(generate_series(1, n)) i) where n > 0 and doc_id in (select doc_id from cov) and not exists (select 1 from cov where cov.doc_id = b.doc_id and cov.p = i) group by 1)
 select doc_id, n n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0)::bigint n_spans, sha256(unhex(case when n_removed is null then x else coalesce(k, '') end)) kept_sha256 from b left join run using (doc_id) left join part using (doc_id)"""
