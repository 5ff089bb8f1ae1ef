"""Session helpers shared by the library: session creation for tests, and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kinweave")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``. Where it is unset, a folder of our own on a local master; on a
    cluster executors would write to their own disks, so that fails."""
    sc = spark.sparkContext
    here = sc.getCheckpointDir()
    if here:
        return here
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        wanted = tempfile.mkdtemp(prefix="kinweave-checkpoints-")
    sc.setCheckpointDir(wanted)
    return wanted


def few_files(df: DataFrame, a_core: int) -> DataFrame:
    """At most so many partitions a core, for tables of narrow rows: a file for each of many near-empty partitions costs
    more than its rows. 2 suits small tables; 16 leaves tasks of a bounded size where the stage before is heavy."""
    return df.coalesce(a_core * df.sparkSession.sparkContext.defaultParallelism)


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Plans made in this block drop their shuffle files as soon as their action has ended; what they write stays."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def cut(df: DataFrame, narrow: int = 0) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: lost executors do not lose it. ``narrow``: see ``few_files``."""
    ensure_checkpoint_dir(df.sparkSession)
    with _own_shuffles(df.sparkSession):
        return (few_files(df, narrow) if narrow else df.select("*")).checkpoint(eager=True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside and moved over what is there in one step, on any Hadoop file system: a reader sees the old text or the
    new one."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    whole, part = hadoop.Path(path), hadoop.Path(f"{path}.partial")
    fs = whole.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    over = spark._jvm.java.lang.reflect.Array.newInstance(hadoop.Options.Rename.OVERWRITE.getClass(), 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(whole.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(part), fs.makeQualified(whole), over)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


class Scratch:
    """A folder of its own beside the checkpoints for compressed intermediate tables; gone when the block ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.n = spark, f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, narrow: int = 0) -> DataFrame:
        """``df`` written and read again. ``narrow``: see ``few_files``."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        with _own_shuffles(self.spark):
            (few_files(df, narrow) if narrow else df.select("*")).write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so that they need no installation of it; and bound what a Python
    worker holds of its input: texts are long, so Arrow batches are limited by their bytes (a lower limit stays)."""
    sc = spark.sparkContext
    held = sc._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH, "64m"))
    if held <= 0 or held > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="kinweave-ship-")) / "kinweave_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data by name; Spark's reader only, so that any store works."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
