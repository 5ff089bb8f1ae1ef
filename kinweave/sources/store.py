"""Tables of a workspace as partitioned Parquet: revisions written whole, then published by a pointer."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.normalize import content_digest, formula_guard
from kinweave.session import read_text, write_text


class Workspace:
    """Paths below a root that any Hadoop file system holds. One writer publishes at a time."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(f"{self.root}/{name}"))

    def _write_text(self, name: str, text: str) -> None:
        write_text(self.spark, f"{self.root}/{name}", text)

    def _read_text(self, name: str) -> str:
        return read_text(self.spark, f"{self.root}/{name}")

    def save(self, name: str, df: DataFrame, key: list[str] | None = None) -> None:
        """A table that must not exist yet, sorted by an opaque key within its files."""
        if self.exists(name):
            raise FileExistsError(name)
        (df.sortWithinPartitions(*key) if key else df).write.mode("errorifexists").parquet(f"{self.root}/{name}")

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def prepare(self, revision: str, tables: dict[str, DataFrame], parent: str | None, policy: str, notes: dict[str, str] | None = None) -> dict:
        """All tables of a revision, then its manifest with their digests and ``notes``: without it the revision does not
        exist."""
        if self.exists(f"revisions/{revision}/manifest.json"):
            raise FileExistsError(revision)
        digests = {}
        for name, df in tables.items():
            path = f"{self.root}/revisions/{revision}/{name}"
            df.write.mode("overwrite").parquet(path)
            digests[name] = table_digest(self.spark.read.parquet(path))
        manifest = {"revision": revision, "parent": parent, "policy": policy, "tables": digests, **(notes or {})}
        self._write_text(f"revisions/{revision}/manifest.json", json.dumps(manifest, sort_keys=True))
        return manifest

    def publish(self, revision: str) -> None:
        """Make a prepared revision current, if its parent still is and its tables still have their digests."""
        manifest = json.loads(self._read_text(f"revisions/{revision}/manifest.json"))
        if manifest["parent"] != self.current():
            raise ValueError("the current revision is not the parent")
        self.verify(revision)
        self._write_text("current.json", json.dumps({"revision": revision}))

    def current(self) -> str | None:
        return json.loads(self._read_text("current.json"))["revision"] if self.exists("current.json") else None

    def verify(self, revision: str) -> None:
        manifest = json.loads(self._read_text(f"revisions/{revision}/manifest.json"))
        for name, digest in manifest["tables"].items():
            if table_digest(self.load(f"revisions/{revision}/{name}")) != digest:
                raise ValueError(f"{name} of {revision} does not match its digest")

    def published(self, revision: str | None = None) -> str:
        """The revision (the current one by default), if it is published; others are invisible."""
        chain, wanted = self.current(), revision or self.current()
        while chain is not None and chain != wanted:
            chain = json.loads(self._read_text(f"revisions/{chain}/manifest.json"))["parent"]
        if chain is None:
            raise LookupError(f"{wanted} is not published")
        return chain

    def table(self, name: str, revision: str | None = None) -> DataFrame:
        """A table of a published revision; others are invisible."""
        return self.load(f"revisions/{self.published(revision)}/{name}")


def table_digest(df: DataFrame) -> str:
    """Independent of order: the count and sums of row hashes in four parts; one row reaches the driver."""
    hashed = df.select(content_digest(sorted(df.columns)).alias("h"))
    part = lambda k: F.coalesce(F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")), F.lit(0))
    r = hashed.agg(F.count("*"), *map(part, range(4))).first()
    return hashlib.sha256("|".join(map(str, r)).encode()).hexdigest()


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with every text cell guarded against formulas."""
    text = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    df.select(*[formula_guard(c).alias(c) if c in text else F.col(c) for c in df.columns]).write.mode("errorifexists").option("header", True).csv(path)


def export_learning(workspace: Workspace, name: str, pairs: DataFrame, notes: dict[str, str] | None = None) -> dict:
    """A learning data set (with a split column) as a table a split, then its manifest of rows, positives and digests: without
    the manifest there is no export. Every pair must have one of the four splits."""
    from kinweave.operators.splits import LEARNING

    splits = [s for _, s in LEARNING]
    if pairs.where(F.col("split").isNull() | ~F.col("split").isin(splits)).limit(1).count():
        raise ValueError(f"splits must be {splits}")
    manifest: dict = {"splits": {}, **(notes or {})}
    for s in splits:
        workspace.save(f"{name}/{s}", pairs.where(F.col("split") == s), ["left", "right"])
        written = workspace.load(f"{name}/{s}")
        r = written.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.col("label").cast("long")), F.lit(0)).alias("positives")).first()
        manifest["splits"][s] = {"rows": r["rows"], "positives": r["positives"], "digest": table_digest(written)}
    workspace._write_text(f"{name}/manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest


def load_learning(workspace: Workspace, name: str) -> dict[str, DataFrame]:
    """The splits of an exported data set; one that doesn't match its digest is an error."""
    manifest = json.loads(workspace._read_text(f"{name}/manifest.json"))
    out = {s: workspace.load(f"{name}/{s}") for s in manifest["splits"]}
    for s, df in out.items():
        if table_digest(df) != manifest["splits"][s]["digest"]:
            raise ValueError(f"{name}/{s} does not match its digest")
    return out


def active_records(versions: DataFrame, records: DataFrame) -> DataFrame:
    """Records (record_id, current_version) with their current version, tombstones left out."""
    live = records.join(versions.withColumnRenamed("record_version_id", "current_version"), ["record_id", "current_version"]).where(~F.coalesce("tombstone", F.lit(False)))
    return live.withColumnRenamed("current_version", "record_version_id")


def backup(workspace: Workspace, target: str) -> dict:
    """Every published revision copied to another root, its manifests with it; the pointer goes last."""
    other, names, at = Workspace(workspace.spark, target), [], workspace.current()
    if other.exists("current.json"):
        raise FileExistsError(target)
    while at is not None:
        names.append(at)
        at = json.loads(workspace._read_text(f"revisions/{at}/manifest.json"))["parent"]
    for revision in reversed(names):
        manifest = json.loads(workspace._read_text(f"revisions/{revision}/manifest.json"))
        workspace.verify(revision)
        for table in manifest["tables"]:
            workspace.load(f"revisions/{revision}/{table}").write.mode("errorifexists").parquet(f"{other.root}/revisions/{revision}/{table}")
        other._write_text(f"revisions/{revision}/manifest.json", json.dumps(manifest, sort_keys=True))
    summary = {"revisions": names[::-1]}
    other._write_text("backup.json", json.dumps(summary))
    if names:
        other._write_text("current.json", json.dumps({"revision": names[0]}))
    return summary


def verify_backup(spark: SparkSession, path: str) -> None:
    """Every revision has its tables with their digests and a parent in the backup."""
    w = Workspace(spark, path)
    names = json.loads(w._read_text("backup.json"))["revisions"]
    for k, revision in enumerate(names):
        w.verify(revision)
        parent = json.loads(w._read_text(f"revisions/{revision}/manifest.json"))["parent"]
        if parent != (names[k - 1] if k else None):
            raise ValueError(f"{revision} does not follow its parent")


def restore(spark: SparkSession, path: str, target: str) -> Workspace:
    """A new workspace from a verified backup."""
    verify_backup(spark, path)
    backup(Workspace(spark, path), target)
    return Workspace(spark, target)
