"""Streams: versioned imports by micro-batch, replayed rows dropped, windows over the event log."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinweave.operators.incremental import import_versions
from kinweave.sources.store import Workspace

STATE = "source string, source_key string, version string, content string, tombstone boolean"
KEY = ["source", "source_key"]
BUCKETS, COMPACT = 64, 16  # parts of the keys; batches between two compactions


class VersionedImport:
    """Folds micro-batches of source rows into version states kept as a log of changes.

    A batch writes only the keys that it changes, by bucket of key; it reads the earlier states of its own buckets only. A
    state is the base with the changes after it, the latest a key (merge on read). Every COMPACT batches the state becomes
    the next base. A pointer, moved last, says which base and which batches count: a batch that comes again after a
    failure finds it moved and changes nothing, or writes its changes again.
    """

    def __init__(self, spark: SparkSession, root: str, columns: list[str], compact: int = COMPACT) -> None:
        self.workspace, self.columns, self.compact_every = Workspace(spark, root), columns, compact

    def _pointer(self) -> dict[str, int]:
        w = self.workspace
        return json.loads(w._read_text("state.json")) if w.exists("state.json") else {"last": -1, "base": -1}

    def last(self) -> int:
        return self._pointer()["last"]

    def _rows(self, paths: list[str], buckets: list[int] | None) -> DataFrame:
        w = self.workspace
        schema = f"{STATE}, at long, bucket int"
        rows = w.spark.createDataFrame([], schema)
        for p in paths:  # the base and at most as many batches as lie between two compactions
            if w.exists(p):
                rows = rows.unionByName(w.spark.read.schema(schema).parquet(f"{w.root}/{p}"))
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def state(self, batch: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Keys with their versions after a batch (the last by default)."""
        p = self._pointer()
        upto = p["last"] if batch is None else batch
        if upto > p["last"] or upto < p["base"] and self.workspace.exists("vacuumed"):
            raise LookupError(f"there is no state of batch {upto}")
        base = p["base"] if p["base"] <= upto else -1
        every = self._rows([f"base/upto={base}"] * (base >= 0) + [f"log/batch={n}" for n in range(base + 1, upto + 1)], buckets)
        rest = [c for c in every.columns if c not in (*KEY, "at", "bucket")]
        return every.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "at").alias("r")).select(*KEY, "r.*")

    def _write(self, rows: DataFrame, name: str) -> None:
        placed = rows.select(*KEY, "version", "content", "tombstone", "at", F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int").alias("bucket"))
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.workspace.root}/{name}")

    def __call__(self, rows: DataFrame, batch: int) -> None:
        p = self._pointer()
        if batch <= p["last"]:
            return
        newest = rows.groupBy(*KEY).agg(F.max_by(F.struct(*self.columns, "tombstone"), "seq").alias("r")).select(*KEY, "r.*")
        buckets = [r[0] for r in newest.select(F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int")).distinct().collect()]  # at most BUCKETS
        before = self.state(buckets=buckets).join(newest.select(*KEY), KEY, "left_semi")
        after = import_versions(before, newest, batch, self.columns).where("changed")
        self._write(after.withColumn("at", F.lit(batch).cast("long")), f"log/batch={batch}")
        self.workspace._write_text("state.json", json.dumps(p | {"last": batch}))
        if batch - p["base"] >= self.compact_every:
            self.compact()

    def compact(self) -> None:
        """The state becomes the base that later batches are read on; earlier changes stay readable."""
        p = self._pointer()
        if p["last"] > p["base"]:
            self._write(self.state().withColumn("at", F.lit(p["last"]).cast("long")), f"base/upto={p['last']}")
            self.workspace._write_text("state.json", json.dumps(p | {"base": p["last"]}))

    def vacuum(self) -> None:
        """Drop what the base has made superfluous: states of before it can't be asked for any more."""
        w, p = self.workspace, self._pointer()
        self.workspace._write_text("vacuumed", str(p["base"]))
        for kind, name in (("log", "batch"), ("base", "upto")):
            for n in range(p["base"] + (kind == "log")):
                if w.exists(f"{kind}/{name}={n}"):
                    w.fs.delete(w._path(f"{w.root}/{kind}/{name}={n}"), True)


def run_import(stream: DataFrame, sink: VersionedImport, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_replays(stream: DataFrame, key: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once; state is dropped behind the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def windowed(stream: DataFrame, keys: list[str], time: str = "ts", width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling window; an extension to the batch operators."""
    out = stream.withWatermark(time, late) if stream.isStreaming else stream
    return out.groupBy(*keys, F.window(time, width).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(*keys, F.col("w.start").alias("window_start"), "n", "total")


def sessions(stream: DataFrame, keys: list[str], time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    out = stream.withWatermark(time, late) if stream.isStreaming else stream
    return out.groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
