"""All registered queries of the library with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: normalized, blocked, linked by exact names and closed into clusters, by size."""
    from pyspark.sql import functions as F

    from kinweave.plans import queries as q

    clusters = q.QUERIES["g3_components"](spark, sf_dir)
    return clusters.groupBy("cluster_id").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "cluster_id")


def queries() -> dict[str, Query]:
    from kinweave.plans import datasets  # noqa: F401  (registers its own)
    from kinweave.plans import queries as q

    return dict(q.QUERIES)


def oracle_sql() -> dict[str, str]:
    from kinweave.plans import datasets  # noqa: F401
    from kinweave.plans import queries as q

    return dict(q.SQL)
