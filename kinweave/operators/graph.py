"""Graphs as DataFrames of links: connected components and constrained greedy resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators import greedy
from kinweave.session import cut


def _fingerprint(edges: DataFrame) -> tuple:
    """Of a set of edges: their number and two sums of hashes, equal for equal sets."""
    h = lambda seed: F.sum(F.xxhash64("u", "v", F.lit(seed)).cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), h(0), h(1)).first())


def components(links: DataFrame, a: str = "left", b: str = "right") -> DataFrame:
    """(node, label) of each node of ``links``, the label being the smallest node of its component.

    Alternating large-star and small-star rounds until all links are stars; rounds grow with the logarithm of the
    nodes, each is checkpointed, and only whether something changed reaches the driver.
    """
    kind = links.schema[a].dataType
    named = links.select(F.col(a).alias("a"), F.col(b).cast(kind).alias("b"))
    loops = named.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("label"))
    edges = cut(named.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), narrow=2)
    state = _fingerprint(edges)
    while True:  # labels only ever fall
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = lambda x: F.struct(F.col(x).alias("u"), F.col("m").alias("v"))
        edges = cut(large.join(low, "u").select(F.explode(F.array(pair("u"), pair("v"))).alias("e")).select("e.u", "e.v").where("u <> v").distinct(), narrow=2)
        before, state = state, _fingerprint(edges)
        if state == before:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    alone = loops.distinct().join(stars, "node", "left_anti").join(roots, "node", "left_anti")
    return stars.union(roots).union(alone)


def clusters(records: DataFrame, links: DataFrame, id_col: str = "record_id") -> DataFrame:
    """(record_id, cluster_id) of every record; a record without links is its own cluster."""
    label = components(links)
    return records.select(id_col).join(label.withColumnRenamed("node", id_col), id_col, "left").select(id_col, F.coalesce("label", id_col).alias("cluster_id"))


# The published reasons of decisions and the status of each.
STATUS = {
    "explicit_must_link": "accepted",
    "explicit_cannot_link": "conflict",
    "transitive_must_link": "accepted",
    "revoked_basis_requires_review": "suppressed",
    "cluster_cannot_link": "conflict",
    "candidate_requires_review": "review",
    "score_at_or_above_threshold": "accepted",
    "score_in_review_band": "review",
    "insufficient_score_not_a_cannot_link": "below_threshold",
}
MERGES, READS, CLASH = "score_at_or_above_threshold", "candidate_requires_review", "cluster_cannot_link"


def own_reason(threshold: float, review: float) -> Column:
    """What a pair's own facts say: the one table of rules. Only MERGES and READS depend on clusters: where these hold a
    cannot-link, they become CLASH."""
    rules = [
        ("explicit_must_link", F.col("is_must")),
        ("explicit_cannot_link", F.col("is_cannot")),
        ("transitive_must_link", F.col("closed")),
        ("revoked_basis_requires_review", F.col("is_suppressed")),
        (READS, ~F.col("auto_merge")),
        (MERGES, F.col("score") >= threshold),
        ("score_in_review_band", F.col("score") >= review),
    ]
    out = F.lit("insufficient_score_not_a_cannot_link")
    for name, test in reversed(rules):
        out = F.when(test, name).otherwise(out)
    return out


def status_of(reason: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), reason)


def resolve(records: DataFrame, edges: DataFrame, must: DataFrame, cannot: DataFrame, suppressed: DataFrame, threshold: float = 0.9, review: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Greedy clustering by score under must-links and cannot-links: (partitions, decisions).

    ``records`` (record_id), ``edges`` (left, right, score, auto_merge), constraints (left, right), all with left < right.
    Edges of different components commute. Components without an inner cannot-link (nearly all) are settled by
    expressions and connected components, the others in rounds (``greedy``); no component is in one task.
    """
    if not 0 <= review <= threshold <= 1:
        raise ValueError("thresholds must be ordered within 0..1")
    pair = ["left", "right"]
    must, cannot, suppressed = (x.select(pair).distinct() for x in (must, cannot, suppressed))
    tag = lambda df, name: df.withColumn(name, F.lit(True))
    mandatory = components(must)
    as_side = lambda df, s, name: df.select(F.col("node").alias(s), F.col("label").alias(name))
    marked = edges.select("left", "right", "score", F.coalesce("auto_merge", F.lit(True)).alias("auto_merge"))
    marked = marked.join(tag(must, "is_must"), pair, "left").join(tag(cannot, "is_cannot"), pair, "left").join(tag(suppressed, "is_suppressed"), pair, "left")
    marked = marked.join(as_side(mandatory, "left", "ml"), "left", "left").join(as_side(mandatory, "right", "mr"), "right", "left")
    marked = marked.select("left", "right", "score", "auto_merge", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("is_must", "is_cannot", "is_suppressed")], F.coalesce(F.col("ml") == F.col("mr"), F.lit(False)).alias("closed"))
    marked = cut(marked.select("left", "right", "score", own_reason(threshold, review).alias("reason")))
    state = components(must.union(marked.where(F.col("reason").isin(MERGES, READS)).select(pair)))
    inner = cannot.join(as_side(state, "left", "sl"), "left").join(as_side(state, "right", "sr"), "right").where("sl = sr").select("left", "right", F.col("sl").alias("state"))
    busy = cut(inner.select("state").distinct())
    of_state = marked.join(as_side(state, "left", "sl"), "left", "left").join(as_side(state, "right", "sr"), "right", "left")
    of_state = of_state.withColumn("state", F.when(F.col("sl") == F.col("sr"), F.col("sl")))
    slow = of_state.join(busy, "state", "left_semi")
    fast = of_state.join(busy, "state", "left_anti")
    # components without an inner cannot-link
    none = F.array().cast("array<struct<left:string,right:string>>")
    own = F.array(F.struct("left", "right"))
    status = status_of(F.col("reason"))
    quick = fast.select("left", "right", "score", status.alias("status"), "reason", F.when(F.col("reason") == "explicit_cannot_link", own).otherwise(none).alias("conflicts"))
    must_rows = must.select("left", "right", F.lit(None).cast("double").alias("score"), F.lit("accepted").alias("status"), F.lit("explicit_must_link").alias("reason"), none.alias("conflicts"))
    # the others, in rounds
    wanted = cut(slow.select("left", "right", "score", "reason"))
    nodes = state.join(busy, state["label"] == busy["state"], "left_semi").select("node")
    nodes = cut(nodes.join(mandatory, "node", "left").select("node", F.coalesce("label", "node").alias("label")))
    inner = cut(inner.select(pair), narrow=2)
    within = inner.join(as_side(nodes, "left", "ml"), "left").join(as_side(nodes, "right", "mr"), "right").where("ml = mr").first()
    if within is not None:
        raise ValueError(f"cannot-link inside the must-link closure: {within.left}, {within.right}")
    past = cut(greedy.pasts(nodes, wanted.where(F.col("reason") == MERGES), inner))
    found = greedy.conflicts(past, wanted.where(F.col("reason").isin(MERGES, READS)), inner).withColumnRenamed("conflicts", "found")
    reason = F.when(F.col("found").isNotNull() & F.col("reason").isin(MERGES, READS), CLASH).otherwise(F.col("reason"))
    settled = wanted.join(found, ["left", "right", "score"], "left").withColumn("reason", reason)
    settled = settled.select("left", "right", "score", status.alias("status"), "reason", F.when(F.col("reason") == "explicit_cannot_link", own).otherwise(F.coalesce("found", none)).alias("conflicts"))
    decisions = quick.union(must_rows).union(settled)
    merges = must.union(fast.where(F.col("reason") == MERGES).select(pair)).union(past.select(F.col("node").alias("left"), F.col("label").alias("right")))
    return clusters(records, merges), decisions
