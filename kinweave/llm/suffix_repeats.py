"""An enhanced suffix array (order, common prefixes) and the maximal repeats that a stack scan of it gives."""

from __future__ import annotations

import numpy as np


def _words(data: np.ndarray) -> np.ndarray:
    """At each byte, the eight bytes from there as a big-endian number; zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).tobytes()
    return np.ndarray((len(data),), ">u8", padded, strides=(1,)).astype(np.uint64)


def suffix_order(data: np.ndarray, remaining: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes from ``starts`` sorted by at least their first ``depth`` bytes; ``remaining`` says for every byte
    how many are left in its text, and nothing behind counts. Prefix doubling from words of eight bytes; a
    suffix that ends comes before those that go on."""
    n = len(data)
    part = np.minimum(remaining, 8)
    word = _words(data)
    short = part < 8
    word[short] &= ~((np.uint64(1) << (np.uint64(64) - np.uint64(8) * part[short].astype(np.uint64))) - np.uint64(1))
    rank = np.unique(word, return_inverse=True)[1].astype(np.int64)
    if short.any():  # real zeros differ from the end
        rank = np.unique(rank * 9 + part, return_inverse=True)[1].astype(np.int64)
    have = 8
    while have < depth:
        later = np.zeros(n, np.int64)
        if have < n:
            later[:-have] = np.where(remaining[:-have] > have, rank[have:] + 1, 0)
        rank = np.unique(rank * (n + 1) + later, return_inverse=True)[1].astype(np.int64)
        have *= 2
    return np.argsort(rank[starts], kind="stable")


def bucket_order(data: np.ndarray, remaining: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """The suffixes that share their first ``least`` bytes with another, each bucket of such suffixes sorted by the
    bytes behind. Where only repeats of ``least`` bytes or more are wanted, the order of the buckets is free, so
    they are in the order of a hash; if two strings ever share one, the full order is taken instead."""
    words, mult = _words(data), np.uint64(0x9E3779B97F4A7C15)
    h = np.zeros(len(starts), np.uint64)
    for k in range(0, least, 8):
        w = words[starts + k]
        if least - k < 8:
            w = w >> np.uint64(8 * (8 - least + k))
        h = (h ^ w) * mult
        h ^= h >> np.uint64(29)
    ordered = np.sort(h)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    at = np.searchsorted(again, h)
    at[at == len(again)] = 0
    chosen = np.flatnonzero(again[at] == h) if len(again) else np.empty(0, np.int64)
    s, h = starts[chosen], h[chosen]
    if not len(s):
        return s
    keys, most = [], int(remaining[s].max())
    for k in range(least, most, 8):
        left = np.clip(remaining[s] - k, 0, 8).astype(np.uint64)
        w = words[np.minimum(s + k, len(data) - 1)]
        w = np.where(left == 8, w, np.where(left == 0, np.uint64(0), (w >> (np.uint64(64) - np.uint64(8) * np.maximum(left, np.uint64(1)))) << (np.uint64(64) - np.uint64(8) * np.maximum(left, np.uint64(1)))))
        keys.append(w)
    order = np.lexsort((remaining[s], *keys[::-1], h))
    s, h = s[order], h[order]
    same = np.flatnonzero(h[1:] == h[:-1])
    for k in range(0, least, 8):
        x = words[s[same] + k] ^ words[s[same + 1] + k]
        if (x >> np.uint64(8 * max(0, 8 - least + k))).any():
            return starts[suffix_order(data, remaining, starts, int(remaining[starts].max()))]
    return s


def common_prefixes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each suffix in order, the length of the prefix it shares with the one before; 0 for the first."""
    n = len(starts)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    words = _words(data)
    most = np.minimum(lengths[1:], lengths[:-1])
    live, at = np.arange(n - 1), 0
    while live.size:
        a, b = starts[live] + at, starts[live + 1] + at
        differ = words[np.minimum(a, len(data) - 1)] ^ words[np.minimum(b, len(data) - 1)]
        differ[(a >= len(data)) | (b >= len(data))] = np.uint64(1 << 63)
        stop = differ != 0
        if stop.any():
            d = differ[stop]
            same = np.zeros(len(d), np.int64)
            for k in range(1, 8):
                same += (d >> np.uint64(64 - 8 * k)) == 0
            out[live[stop] + 1] = at + same
        at += 8
        out[live[~stop] + 1] = at
        live = live[~stop & (at < most[live])]
    out[1:] = np.minimum(out[1:], most)
    return out


def maximal_intervals(lcp: np.ndarray, left: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(first, behind the last, length) of the common-prefix intervals of length ``least`` or more whose suffixes
    differ in the byte before them (``left``; negative: none, which differs from all): the maximal repeats.

    The scan keeps a stack of open intervals. An interval closes where the common prefix gets shorter;
    then its left bytes join its parent's.
    """
    out: list[tuple[int, int, int]] = []
    stack: list[list] = []  # first, length, the one left byte of all (None: none so far, -1: several)
    values, before, n = lcp.tolist(), left.tolist(), len(lcp)

    def join(x, y):
        return y if x is None else x if y is None or (x == y and x >= 0) else -1

    for i in range(1, n + 1):
        depth = values[i] if i < n else 0
        first, carried = i - 1, None
        own = before[i - 1] if before[i - 1] >= 0 else -1  # left byte of the suffix before the gap
        if stack and stack[-1][1] >= depth and stack[-1][1] >= least:
            stack[-1][2] = join(stack[-1][2], own)
            own = None
        while stack and stack[-1][1] > depth:
            first, length, carried = stack.pop()
            if carried == -1:
                out.append((first, i, length))
            if stack and stack[-1][1] >= depth:
                stack[-1][2] = join(stack[-1][2], carried)
                carried = None
        if depth >= least and (not stack or stack[-1][1] < depth):
            stack.append([first, depth, carried])
        if stack and own is not None:
            stack[-1][2] = join(stack[-1][2], own)
    return out


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, [(text, start), ...]) of each maximal repeat of ``least`` bytes or more, with all occurrences."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    if not len(data):
        return []
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    starts = np.flatnonzero(ends[owner] - np.arange(len(data)) >= least)
    if not len(starts):
        return []
    remaining = ends[owner] - np.arange(len(data))
    sa = bucket_order(data, remaining, starts, least)
    lcp = common_prefixes(data, sa, remaining[sa])
    begin = (ends - sizes)[owner[sa]]
    left = np.where(sa > begin, data[sa - 1].astype(np.int64), -1)
    return [(length, sorted((int(owner[p]), int(p - (ends - sizes)[owner[p]])) for p in sa[a:b])) for a, b, length in maximal_intervals(lcp, left, least)]
