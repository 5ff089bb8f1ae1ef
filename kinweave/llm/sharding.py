"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Law ``rows``: the rows, numbered 0..N-1 in the order of (doc_id, CRC-32, size), are permuted by a keyed
Feistel network on the smallest domain of 2^(2k) numbers that holds N; a number that leaves 0..N-1 walks
on until it is back inside. The permuted place p gives shard ``p mod S`` and slot ``p div S``: shard sizes
are at most one apart, slots are gapless, and both ways are computable from (seed, N) alone:
``place_of(row)`` and ``row_of(shard, slot)``.

Defined results: a null text has size 1 and CRC 0; a null doc_id sorts first; rows equal in all three
columns are interchangeable; an empty table gives an empty result; extra columns are ignored. A
very long text is a row as any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import read_table
from kinweave.operators.ordering import numbered

ROUNDS = 6
_GOLDEN, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB  # splitmix64's fixed constants


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX2)
    return x ^ (x >> np.uint64(31))


class Feistel:
    """A keyed permutation of 0..n-1 and its inverse."""

    def __init__(self, n: int, seed: int) -> None:
        if n < 0 or n > 1 << 62:
            raise ValueError("n must be in 0..2^62")
        self.n = n
        self.half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        keys = np.array([(seed * 0x2545F4914F6CDD1D + (r + 1) * _GOLDEN) % (1 << 64) for r in range(ROUNDS)], np.uint64)
        self.keys = _mix(keys)

    def _once(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        half = np.uint64(self.half)
        left, right = x >> half, x & self.mask
        for k in keys:
            if back:
                left, right = right ^ (_mix(left + k) & self.mask), left
            else:
                left, right = right, left ^ (_mix(right + k) & self.mask)
        return (left << half) | right

    def _walk(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        x = self._once(np.asarray(x, np.uint64), keys, back)
        out = np.flatnonzero(x >= np.uint64(self.n))
        while out.size:
            x[out] = self._once(x[out], keys, back)
            out = out[x[out] >= np.uint64(self.n)]
        return x

    def place_of(self, rows: np.ndarray) -> np.ndarray:
        return self._walk(rows, self.keys, False)

    def row_of(self, places: np.ndarray) -> np.ndarray:
        return self._walk(places, self.keys[::-1], True)


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 20240607) -> DataFrame:
    """doc_id, size, text_crc32, row_no, place, shard and slot of every row."""
    if shards < 1:
        raise ValueError("shards must be positive")
    utf8 = F.col("text").cast("binary")
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(utf8), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(utf8), F.lit(0)).cast("long").alias("text_crc32"),
    )
    rows, total = numbered(narrow, ["doc_id", "text_crc32", "size"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Feistel(total, seed)
        for b in batches:
            p = network.place_of(b.column("row_no").to_numpy(zero_copy_only=False).astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(p), pa.array((p % shards).astype(np.int32)), pa.array(p // shards)],
                names=[*b.schema.names, "place", "shard", "slot"],
            )

    schema = "doc_id long, size long, text_crc32 long, row_no long, place long, shard int, slot long"
    return rows.select("doc_id", "size", "text_crc32", "row_no").mapInArrow(place, schema)


def op3_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_rows(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

