"""Row numbers, running sums and quantiles without a single sorted partition or a task that holds a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.session import cut

_IN_PARTITION = (1 << 33) - 1  # low bits of monotonically_increasing_id


def numbered(rows: DataFrame, order: list[str | Column], name: str = "row_no") -> tuple[DataFrame, int]:
    """``rows`` with gapless global numbers from 0 in ``order``, and their count.

    One range shuffle of the given (narrow) columns; rows equal in ``order`` are spread over partitions
    by their place in the scan, so a hot key fills no single task. Only one count a partition reaches
    the driver.
    """
    spread = rows.withColumn("__scan", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange(*order, "__scan").sortWithinPartitions(*order, "__scan")
    kept = cut(ranged.drop("__scan").withColumn("__at", F.monotonically_increasing_id()), narrow=2)
    part = F.shiftright("__at", 33)
    counts = kept.groupBy(part.alias("part")).agg((F.max(F.col("__at").bitwiseAND(_IN_PARTITION)) + 1).alias("n")).collect()
    offsets, total = [], 0
    for r in sorted(counts, key=lambda r: r["part"]):
        offsets += [(r["part"], total)]
        total += r["n"]
    starts = kept.sparkSession.createDataFrame(offsets or [(0, 0)], "part long, start long")
    out = kept.join(F.broadcast(starts), part == F.col("part"))  # one row a partition of the shuffle
    return out.withColumn(name, F.col("start") + F.col("__at").bitwiseAND(_IN_PARTITION)).drop("part", "start", "__at"), total


def running_sums(rows: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with running sums: for each name, the sum of its expression over the rows of equal keys up to this one, in
    ``order``; of rows equal in it, which comes first is not said. A null counts as 0.

    A prefix scan in two passes: rows are range partitioned by keys and order, so a key lies in neighbouring partitions,
    however hot it is; what each partition adds up for a key is one small row, from which the sums before a partition
    follow; then each partition sums its own rows. No task holds more of a key than its range.
    """
    at = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    named = [f"__k{i}" for i in range(len(keys))]
    spread = rows.withColumn("__scan", F.monotonically_increasing_id())
    sort = [*keys, *order, "__scan"]
    ranged = spread.repartitionByRange(*sort).sortWithinPartitions(*sort).drop("__scan")
    kept = cut(ranged.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)), narrow=16)
    own = kept.groupBy("__part", *at).agg(*[F.coalesce(F.sum(e), F.lit(0)).alias(f"__own_{n}") for n, e in sums.items()])
    earlier = W.partitionBy(*named).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # as many rows as the key has partitions
    before = own.select(F.col("__part").alias("__p"), *named, *[F.coalesce(F.sum(f"__own_{n}").over(earlier), F.lit(0)).alias(f"__before_{n}") for n in sums])
    same = F.col("__part") == F.col("__p")
    for k, n in zip(keys, named, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    here = W.partitionBy("__part", *keys).orderBy("__at").rowsBetween(W.unboundedPreceding, 0)
    joined = kept.join(before, same)
    return joined.select(*rows.columns, *[(F.col(f"__before_{n}") + F.coalesce(F.sum(e).over(here), F.lit(0))).alias(n) for n, e in sums.items()])


def ordinals(rows: DataFrame, keys: list[str], order: list[str | Column], name: str = "ordinal") -> DataFrame:
    """``rows`` numbered from 0 within equal keys, in ``order``."""
    return running_sums(rows, keys, order, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) - 1)


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], nearest: dict[str, float] | None = None) -> DataFrame:
    """(keys, name...): quantiles of the non-null values of each key, interpolated (``shares``) or the nearest rank at or above
    (``nearest``). Selection by rank: rows are numbered by a prefix scan and only those at the wanted ranks are kept, so no
    task holds a key's values."""
    nearest = nearest or {}
    placed = ordinals(rows.where(F.col(value).isNotNull()).select(*keys, value), keys, [value], "__ordinal")
    sizes = rows.where(F.col(value).isNotNull()).groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("__n"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    o, n = F.col("__ordinal"), F.col("__n")
    place = {k: (n - 1) * F.lit(float(q)) for k, q in shares.items()}
    rank = {k: F.greatest(F.ceil(n * F.lit(float(q))) - 1, F.lit(0)) for k, q in nearest.items()}
    wanted = F.lit(False)
    for p in place.values():
        wanted = wanted | (o == F.floor(p)) | (o == F.ceil(p))
    for r in rank.values():
        wanted = wanted | (o == r)
    pick = lambda at: F.max(F.when(o == at, F.col(value)))
    low = {k: pick(F.floor(p)) for k, p in place.items()}
    up, down = ({k: F.max(x) for k, x in side.items()} for side in ({k: p - F.floor(p) for k, p in place.items()}, {k: F.ceil(p) - p for k, p in place.items()}))
    values = [F.when(up[k] == 0, low[k]).otherwise(down[k] * low[k] + up[k] * pick(F.ceil(p))).alias(k) for k, p in place.items()] + [pick(r).alias(k) for k, r in rank.items()]
    return placed.join(sizes, same).where(wanted).groupBy(*keys).agg(*values)
