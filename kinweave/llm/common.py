"""Small pieces that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.session import Scratch, cut, ensure_checkpoint_dir, read_table, ship  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns an operator reads (extra ones, whatever their names, go); a null text is empty."""
    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col), *map(F.col, more))


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
_CLEAR: dict[str, Callable[[], object]] = {}


def holding(name: str, clear: Callable[[], object] = dict) -> None:
    """Called in a Python worker where an operator starts: it remembers things from now on (``clear`` forgets them), and
    what other operators remembered in this worker goes. Spark reuses workers, so it would stay. ``clear`` is a function of
    a module: an object of one that a task's function names would be sent along as a copy."""
    others = [k for k in _CLEAR if k != name]
    for k in others:
        _CLEAR.pop(k)()
    if others:
        gc.collect()
        hand_back()
    _CLEAR[name] = clear


def hand_back() -> None:
    """Called in a Python worker where an operator has ended: Spark keeps the worker, so what Arrow and the C library hold
    of freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def scan_partitions(df: DataFrame) -> int:
    """Partitions of the input as planned, in proportion to its bytes; no job runs."""
    return df.rdd.getNumPartitions()


def packed(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the text, a non-null string, as zstd-compressed UTF-8 in its place: for texts that are shuffled."""
    schema = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == text_col else f.dataType) for f in df.schema])
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3).compress
        for b in batches:
            cols = list(b.columns)
            cols[at] = pa.array([pack(x.as_py().encode()) for x in cols[at]], pa.binary())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return df.mapInArrow(run, schema)


def unpacked(column: pa.ChunkedArray) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(x.as_py()) for x in column]
