"""Review: uncertain pairs ranked in endpoint-diverse rounds, label snapshots, effects of decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.session import cut


def review_queue(edges: DataFrame, limit: int = 100, seed: int = 7, strategy: str = "uncertain") -> DataFrame:
    """(left, right, score, rank): pairs by nearness of their score to a half, ties by a seeded hash; a round takes each
    pair whose endpoints no better pair of the round has taken, the rest wait for the next round.

    What the first round takes of the best pairs depends on these alone, so the queue is read off the best 4, 16 or 64 times
    ``limit`` pairs as soon as these give ``limit`` of the first round, or are all there are: a top-k, however large the graph.
    Where few endpoints have nearly all pairs, rounds are matched over the whole graph (``_rounds``).
    """
    if not 0 < limit <= 10_000:
        raise ValueError("limit must be in 1..10000")
    waiting = _prioritized(edges, seed, strategy)
    for times in PREFIXES:
        head = waiting.orderBy("order").limit(times * limit).select("left", "right", "score").collect()
        whole = len(head) < times * limit
        taken = _greedy(head, limit, whole)
        if len(taken) >= limit or whole:
            types = waiting.select("left", "right", "score").schema
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in types)
            return edges.sparkSession.createDataFrame([(r["left"], r["right"], r["score"], k) for k, r in enumerate(taken[:limit], 1)], f"{schema}, rank int")
    return _rounds(cut(waiting), edges, limit)


PREFIXES = (4, 16, 64)


def _greedy(pairs: list, limit: int, whole: bool) -> list:
    """Pairs, given by priority, as rounds take them: the first round alone, or all rounds if ``pairs`` are the whole graph."""
    out: list = []
    while pairs and len(out) < limit:
        used: set = set()
        rest = []
        for r in pairs:
            if r["left"] in used or r["right"] in used:
                rest.append(r)
            else:
                used |= {r["left"], r["right"]}
                out.append(r)
        if not whole:
            break
        pairs = rest
    return out


def _prioritized(edges: DataFrame, seed: int, strategy: str) -> DataFrame:
    noise = F.sha2(F.concat_ws("|", F.lit(str(seed)), "left", "right"), 256)
    near = F.abs(F.col("score") - 0.5) if strategy == "uncertain" else F.lit(0.0)
    return edges.select("left", "right", "score", F.struct(near.alias("near"), noise.alias("noise")).alias("order"))


def _rounds(waiting: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """The queue by rounds over the whole graph. A round is a maximal matching in order of priority. It is found without a
    loop over pairs: all pairs that come first at both of their endpoints are taken at once, their neighbours wait, and
    so on."""
    taken, n, turn = None, 0, 0
    while n < limit and waiting.limit(1).count():
        open_, chosen = waiting, None
        while True:  # each pass takes the best open pair at least
            ends = open_.select(F.explode(F.array("left", "right")).alias("end"), "order").groupBy("end").agg(F.min("order").alias("first"))
            side = lambda s: ends.select(F.col("end").alias(s), F.col("first").alias("first_" + s))
            won = cut(open_.join(side("left"), "left").join(side("right"), "right").where("order = first_left and order = first_right").select("left", "right", "score", "order"))
            if not won.limit(1).count():
                break
            chosen = won if chosen is None else chosen.union(won)
            used = won.select(F.explode(F.array("left", "right")).alias("end")).distinct()
            open_ = cut(open_.join(used.withColumnRenamed("end", "left"), "left", "left_anti").join(used.withColumnRenamed("end", "right"), "right", "left_anti").select("left", "right", "score", "order"))
        chosen = cut(chosen.withColumn("turn", F.lit(turn)))
        taken = chosen if taken is None else taken.union(chosen)
        n, turn = n + chosen.count(), turn + 1
        waiting = cut(waiting.join(chosen.select("left", "right"), ["left", "right"], "left_anti"))
    if taken is None:
        return edges.select("left", "right", "score", F.lit(0).alias("rank")).where("false")
    best = taken.orderBy("turn", "order").limit(limit)
    return best.withColumn("rank", F.row_number().over(W.orderBy("turn", "order"))).select("left", "right", "score", "rank")  # at most ``limit`` rows


def open_pairs(edges: DataFrame, labelled: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Scored pairs that are neither labelled nor suppressed."""
    return edges.join(labelled.select("left", "right"), ["left", "right"], "left_anti").join(suppressed.select("left", "right"), ["left", "right"], "left_anti")


def label_snapshot(decisions: DataFrame, events: DataFrame, live: DataFrame, cutoff: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(labels, excluded): the effective label of each pair with its provenance, and counts of decisions left out by
    reason. A pair whose valid decisions disagree fails."""
    from kinweave.operators.identity import latest_events

    state = latest_events(events, "decision_id", "seq", cutoff, ["action"])
    side = lambda s: live.select(F.col("record_id").alias(s), F.col("version").alias(f"live_{s}"))
    full = decisions.join(state, "decision_id", "left").join(side("left"), "left", "left").join(side("right"), "right", "left")
    reason = F.when(F.col("action").isNull(), "no_event").when(F.col("action") == "REVOKE", "revoked").when(F.col("action") == "EXPIRE", "expired").when(F.col("verdict") == "abstain", "abstained").when(F.col("live_left").isNull() | F.col("live_right").isNull(), "endpoint_gone").when((F.col("live_left") != F.col("left_version")) | (F.col("live_right") != F.col("right_version")), "endpoint_changed")
    judged = cut(full.withColumn("reason", reason))
    good = judged.where("reason is null").withColumn("label", (F.col("verdict") == "accept").cast("int"))
    labels = good.groupBy(F.least("left", "right").alias("left_id"), F.greatest("left", "right").alias("right_id")).agg(F.count_distinct("label").alias("n"), F.max("label").alias("label"), F.array_sort(F.collect_list(F.struct("decision_id", "seq"))).alias("provenance"))
    if labels.where("n > 1").limit(1).count():
        raise ValueError("decisions on a pair disagree")
    return labels.drop("n"), judged.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def revoke_preview(records: DataFrame, edges: DataFrame, decisions: DataFrame, events: DataFrame, live: DataFrame, policy: str, decision_id: str, threshold: float = 0.9, review: float = 0.5) -> DataFrame:
    """Cluster counts before and after a decision is treated as revoked."""
    from kinweave.operators import graph
    from kinweave.operators.identity import constraints

    last = events.agg(F.max("seq").alias("s")).first()["s"] or 0
    revoked = events.unionByName(events.sparkSession.createDataFrame([(decision_id, last + 1, "REVOKE", policy)], "decision_id string, seq long, action string, policy string"))
    out = None
    for name, e in (("before", events), ("after", revoked)):
        c = cut(constraints(decisions, e, live, policy))
        kind = lambda k, c=c: c.where(F.col("kind") == k).select("left", "right")
        parts, _ = graph.resolve(records, edges, kind("must"), kind("cannot"), kind("suppressed"), threshold, review)
        row = parts.agg(F.count_distinct("cluster_id").alias("clusters"), F.count("*").alias("records")).withColumn("state", F.lit(name))
        out = row if out is None else out.union(row)
    return out
