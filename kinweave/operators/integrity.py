"""Integrity queries: keys, references, ancestry, datasets. Each gives the violations; none means sound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.session import cut


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def missing_references(df: DataFrame, column: str, target: DataFrame, target_column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(column).distinct().join(target.select(F.col(target_column).alias(column)), column, "left_anti")


def ancestry_cycles(revisions: DataFrame) -> DataFrame:
    """(revision_id) of revisions (revision_id, parent_id) that never reach a root: pointers to ancestors are doubled until
    they have gone as many steps as there are revisions; what still has one is in a circle or below one."""
    own = revisions.select("revision_id", "parent_id")
    ids = own.select(F.col("revision_id").alias("parent_id")).distinct()
    at = cut(own.join(ids, "parent_id", "left_semi").select("revision_id", "parent_id"))  # a parent that is missing is a root
    steps, most = 1, at.count()
    while steps <= most:
        on = at.select(F.col("revision_id").alias("parent_id"), F.col("parent_id").alias("further"))
        at = cut(at.join(on, "parent_id").select("revision_id", F.col("further").alias("parent_id")))
        steps *= 2
    return at.select("revision_id").distinct()


def check_records(records: DataFrame, allowed: tuple[str, ...]) -> None:
    """Exactly the allowed columns, unique non-empty record ids, non-empty sources."""
    if sorted(records.columns) != sorted(allowed):
        raise ValueError(f"columns must be {sorted(allowed)}")
    if records.where("record_id is null or record_id = '' or source is null or source = ''").limit(1).count():
        raise ValueError("a record lacks its id or source")
    if duplicate_keys(records, ["record_id"]).limit(1).count():
        raise ValueError("a record id repeats")


def check_edges(edges: DataFrame, records: DataFrame) -> None:
    """Known endpoints, finite scores in 0..1, no pair with different scores."""
    if edges.where("score is null or isnan(score) or score < 0 or score > 1 or left >= right").limit(1).count():
        raise ValueError("a score is out of 0..1, or a pair out of order")
    ends = edges.select(F.explode(F.array("left", "right")).alias("record_id")).distinct()
    if ends.join(records.select("record_id"), "record_id", "left_anti").limit(1).count():
        raise ValueError("an endpoint is unknown")
    if edges.groupBy("left", "right").agg(F.count_distinct("score").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("a pair has different scores")


def truth_violations(features: DataFrame, truth: DataFrame) -> DataFrame:
    """(rule, key) of a complete-truth dataset: entities in several splits, repeated ids, uncovered records."""
    split = truth.groupBy("true_entity_id").agg(F.count_distinct("split").alias("n")).where("n > 1").select(F.lit("entity_in_splits").alias("rule"), F.col("true_entity_id").alias("key"))
    again = duplicate_keys(truth, ["record_id"]).select(F.lit("repeated_id"), "record_id")
    a, b = features.select("record_id"), truth.select("record_id")
    return split.union(again).union(a.subtract(b).select(F.lit("no_truth"), "record_id")).union(b.subtract(a).select(F.lit("no_features"), "record_id"))


def label_violations(pairs: DataFrame) -> DataFrame:
    """(rule, left, right) of a partial-label dataset: pairs repeated in either order, endpoints in several groups."""
    a, b = F.least("left", "right"), F.greatest("left", "right")
    again = pairs.groupBy(a.alias("left"), b.alias("right")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated_pair").alias("rule"), "left", "right")
    ends = pairs.select(F.explode(F.array("left", "right")).alias("end"), "group_id").groupBy("end").agg(F.count_distinct("group_id").alias("n")).where("n > 1")
    return again.union(ends.select(F.lit("endpoint_in_groups"), "end", F.lit(None).cast("string")))
