"""Exact vector neighbours of a stated query set against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024  # vectors of a block


def neighbours(vectors: DataFrame, queries: Column, least: float, id_col: str = "vec_id", parity: str = "label") -> DataFrame:
    """(query, target, target_source, similarity): for each vector that ``queries`` states, those of the other source with a
    cosine of ``least`` or more.

    Both sides are packed into blocks, by a hash and as many as their rows ask for, so that repeated or sparse ids don't
    matter. A block of queries meets each block of rows once; rows are sent once for each block of queries, and only what
    passes leaves a task. Null vectors and vectors of length zero have no neighbours; rows that repeat each count.
    """
    v = vectors.where(F.col("embedding").isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("e"), F.pmod(F.col(parity), F.lit(2)).cast("int").alias("source"), F.coalesce(queries, F.lit(False)).alias("asks"))
    q = v.where("asks")
    blocks = lambda df: max(1, -(-df.count() // BLOCK))
    many, few = blocks(v), blocks(q)
    pack = lambda df, n: df.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block")).agg(F.collect_list("id").alias("ids"), F.collect_list("source").alias("sources"), F.flatten(F.collect_list("e")).alias("flat"))
    asked = pack(q, few).toDF("ask", "ids_q", "sources_q", "flat_q")
    rows = pack(v, many).withColumn("ask", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(few - 1).cast("long"))))
    met = rows.join(asked, "ask").select("ids_q", "sources_q", "flat_q", "ids", "sources", "flat")

    def unit(flat: pa.Scalar, n: int) -> np.ndarray:
        m = np.array(flat.as_py(), np.float64).reshape(n, -1)
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, size, out=np.full_like(m, np.nan), where=size > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for r in range(b.num_rows):
                iq, sq, it, st = (np.array(b.column(c)[r].as_py()) for c in ("ids_q", "sources_q", "ids", "sources"))
                s = unit(b.column("flat_q")[r], len(iq)) @ unit(b.column("flat")[r], len(it)).T
                i, j = np.nonzero((s >= least - 1e-6) & (sq[:, None] != st[None, :]))
                for k, c in enumerate((iq[i], it[j], st[j], s[i, j])):
                    out[k].append(c)
            cols = [np.concatenate(c) if c else np.empty(0) for c in out]
            kinds = [np.int64, np.int64, np.int32, np.float64]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(cols, kinds)], names=["query", "target", "target_source", "similarity"])

    return met.mapInArrow(run, "query long, target long, target_source int, similarity double")
