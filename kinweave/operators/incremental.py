"""Incremental maintenance: record differences, versioned imports, score refresh, affected closures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.normalize import content_digest
from kinweave.operators import blocking, graph
from kinweave.session import cut


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): added, removed or changed rows, by the hash of the other columns."""
    columns = [c for c in old.columns if c != key]
    a = old.select(key, content_digest(columns).alias("old_hash"))
    b = new.select(key, content_digest(columns).alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").otherwise("changed")
    return a.join(b, key, "full").where("not (old_hash <=> new_hash)").select(key, change.alias("change"))


def import_versions(current: DataFrame, rows: DataFrame, snapshot: int, columns: list[str]) -> DataFrame:
    """The next state of (source, source_key, version, content, tombstone) after importing ``rows`` (source, source_key,
    columns, tombstone): unchanged content keeps its version, changed content gets a new one of this snapshot, also
    where it returns to an older content; records not in the import stay."""
    key = ["source", "source_key"]
    fresh = rows.select(*key, content_digest([*columns, "tombstone"]).alias("content"), F.coalesce("tombstone", F.lit(False)).alias("gone"))
    both = current.join(fresh, key, "full") if "content" not in current.columns else current.withColumnRenamed("content", "old_content").join(fresh, key, "full")
    same = F.col("content").isNull() | F.col("content").eqNullSafe(F.col("old_content"))
    version = F.when(same, F.col("version")).otherwise(F.concat_ws(":", *key, F.lit(str(snapshot))))
    return both.select(*key, version.alias("version"), F.coalesce("content", "old_content").alias("content"), F.when(same, F.col("tombstone")).otherwise(F.col("gone")).alias("tombstone"), (~same).alias("changed"))


def expired_decisions(decisions: DataFrame, changed: DataFrame) -> DataFrame:
    """Decisions (decision_id, left, right) that touch a changed record (record_id)."""
    touched = changed.select("record_id").distinct()
    left = decisions.join(touched.withColumnRenamed("record_id", "left"), "left", "left_semi")
    right = decisions.join(touched.withColumnRenamed("record_id", "right"), "right", "left_semi")
    return left.select("decision_id").union(right.select("decision_id")).distinct()


def refresh_scores(old: DataFrame, new: DataFrame, edges: DataFrame, score: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Edges for the new records: only pairs that touch a changed record are generated and scored again.

    ``edges`` (left, right, score); ``score(records, pairs)`` gives the same columns.
    """
    changed = diff(old, new, "record_id").select("record_id")
    keys = new.join(changed, "record_id", "left_semi").select(F.explode(blocking.bucket_keys()).alias("b")).select("b.rule", "b.key").distinct()
    near = new.select("*", F.explode(blocking.bucket_keys()).alias("b")).join(keys, (F.col("b.rule") == keys["rule"]) & (F.col("b.key") == keys["key"]), "left_semi").drop("b").distinct()
    pairs = blocking.candidates(near)
    hit = lambda df: df.join(changed.select(F.col("record_id").alias("left"), F.lit(1).alias("hl")), "left", "left").join(changed.select(F.col("record_id").alias("right"), F.lit(1).alias("hr")), "right", "left")
    fresh = hit(pairs).where("hl = 1 or hr = 1").select("left", "right", "rules")
    kept = hit(edges).where("hl is null and hr is null").select("left", "right", "score")
    return kept.unionByName(score(new, fresh).select("left", "right", "score"))


def affected(edges: DataFrame, constraints: DataFrame, previous: DataFrame, seeds: DataFrame) -> DataFrame:
    """(record_id) of every component, over edges, constraints and previous clusters, that holds a seed."""
    links = edges.select("left", "right").union(constraints.select("left", "right")).union(previous.select(F.col("record_id").alias("left"), F.col("cluster_id").alias("right")))
    label = graph.components(links)
    hot = label.join(seeds.select(F.col("record_id").alias("node")), "node", "left_semi").select("label").distinct()
    return label.join(hot, "label", "left_semi").select(F.col("node").alias("record_id")).union(seeds.select("record_id")).distinct()


def recompute(records: DataFrame, edges: DataFrame, must: DataFrame, cannot: DataFrame, suppressed: DataFrame, previous: DataFrame, seeds: DataFrame, threshold: float, review: float) -> DataFrame:
    """Partitions after a change: the closure of the seeds is resolved anew, everything else keeps its cluster."""
    area = affected(edges, must.select("left", "right").union(cannot.select("left", "right")).union(suppressed.select("left", "right")), previous, seeds)
    return _resolved_in(area, records, edges, must, cannot, suppressed, previous, threshold, review)


def _resolved_in(area: DataFrame, records: DataFrame, edges: DataFrame, must: DataFrame, cannot: DataFrame, suppressed: DataFrame, previous: DataFrame, threshold: float, review: float) -> DataFrame:
    """``area`` (record_id) is resolved, the others keep their clusters."""
    inside = lambda df: df.join(area.withColumnRenamed("record_id", "left"), "left", "left_semi").join(area.withColumnRenamed("record_id", "right"), "right", "left_semi")
    part, _ = graph.resolve(records.join(area, "record_id", "left_semi"), inside(edges), inside(must), inside(cannot), inside(suppressed), threshold, review)
    return part.union(previous.join(records, "record_id", "left_semi").join(area, "record_id", "left_anti").select("record_id", "cluster_id"))


def equal_sets(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold the same rows as often."""
    return not (a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count())


def equal_within(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-12) -> bool:
    """Whether both have the same keys, each once, with numbers no more than ``tolerance`` apart; nulls equal nulls only."""
    if any(x.groupBy(*keys).count().where("count > 1").limit(1).count() for x in (a, b)):
        return False
    side = lambda df, s: df.select(*[F.col(k).alias(k + s) for k in keys], *[F.col(v).alias(v + s) for v in values], F.lit(True).alias("here" + s))
    same, far = F.lit(True), F.col("here_a").isNull() | F.col("here_b").isNull()
    for k in keys:
        same = same & F.col(k + "_a").eqNullSafe(F.col(k + "_b"))
    for v in values:
        x, y = F.col(v + "_a"), F.col(v + "_b")
        far = far | ~(x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False)))
    return not side(a, "_a").join(side(b, "_b"), same, "full").where(far).limit(1).count()


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side holds more often than the other."""
    return a.exceptAll(b).union(b.exceptAll(a))


@dataclass(frozen=True)
class Snapshot:
    """All that a resolution rests on; pair tables have left and right, edges score and auto_merge too."""

    records: DataFrame
    edges: DataFrame
    must: DataFrame
    cannot: DataFrame
    suppressed: DataFrame
    threshold: float
    review: float
    policy: str

    def pairs(self) -> dict[str, DataFrame]:
        links = {k: getattr(self, k).select("left", "right") for k in ("must", "cannot", "suppressed")}
        return {"edges": self.edges.select("left", "right", "score", "auto_merge")} | links

    def solve(self) -> DataFrame:
        return graph.resolve(self.records, self.edges, self.must, self.cannot, self.suppressed, self.threshold, self.review)[0]


def maintain(old: Snapshot, new: Snapshot, previous: DataFrame, changed: DataFrame, budget: int = 10_000) -> tuple[DataFrame, str, str]:
    """(partitions, mode, reason) for ``new``; ``previous`` (record_id, cluster_id) are those of ``old``, ``changed``
    (record_id) the records with another content. Whatever a difference reaches over either side's pairs or a previous
    cluster is resolved anew. Another threshold or policy, or a reach of more than ``budget`` records, makes it a full run."""
    if (old.threshold, old.review, old.policy) != (new.threshold, new.review, new.policy):
        return new.solve(), "full", "policy_or_model_changed"
    seeds = changed.select("record_id").union(symmetric_difference(old.records.select("record_id"), new.records.select("record_id")))
    links, before = None, old.pairs()
    for kind, now in new.pairs().items():
        both = before[kind].select("left", "right").union(now.select("left", "right"))
        links = both if links is None else links.union(both)
        ends = symmetric_difference(before[kind], now).select(F.explode(F.array("left", "right")).alias("record_id"))
        seeds = seeds.union(ends)
    seeds = cut(seeds.distinct())
    area = cut(affected(links.distinct(), links.where("false"), previous, seeds))
    if new.records.join(area, "record_id", "left_semi").limit(budget + 1).count() > budget:
        return new.solve(), "full", "closure_exceeds_budget_same_policy"
    now = new.pairs()
    out = _resolved_in(area, new.records, now["edges"], now["must"], now["cannot"], now["suppressed"], previous, new.threshold, new.review)
    return out, "incremental", "old_new_candidate_closure"
