"""Resolution under constraints against a plain restatement of its rules."""

import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import graph, identity, incremental

PAIR = "left string, right string"
EDGE = "left string, right string, score double, auto_merge boolean"


def oracle(nodes, edges, must, cannot, suppressed, threshold, review):
    """Sets of members instead of parents; the rules in order."""
    group = {n: frozenset([n]) for n in nodes}

    def union(x, y):
        g = group[x] | group[y]
        for n in g:
            group[n] = g

    out = []
    for x, y in sorted(must):
        union(x, y)
        out.append((x, y, None, "accepted", "explicit_must_link"))
    if any(group[x] is group[y] or group[x] == group[y] for x, y in cannot):
        return None
    closed = dict(group)
    for x, y, s, auto in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        clash = group[x] != group[y] and any((a in group[x] and b in group[y]) or (a in group[y] and b in group[x]) for a, b in cannot)
        if (x, y) in must:
            d = ("accepted", "explicit_must_link")
        elif (x, y) in cannot:
            d = ("conflict", "explicit_cannot_link")
        elif closed[x] == closed[y]:
            d = ("accepted", "transitive_must_link")
        elif (x, y) in suppressed:
            d = ("suppressed", "revoked_basis_requires_review")
        elif not auto:
            d = ("conflict", "cluster_cannot_link") if clash else ("review", "candidate_requires_review")
        elif s >= threshold:
            d = ("conflict", "cluster_cannot_link") if clash else ("accepted", "score_at_or_above_threshold")
            if not clash:
                union(x, y)
        elif s >= review:
            d = ("review", "score_in_review_band")
        else:
            d = ("below_threshold", "insufficient_score_not_a_cannot_link")
        out.append((x, y, s, *d))
    return {frozenset(g) for g in group.values()}, sorted(out, key=str)


def graphs(seed, n):
    """n small graphs side by side, disjoint in their nodes."""
    rng, nodes, edges, must, cannot, suppressed = random.Random(seed), [], [], set(), set(), set()
    for k in range(n):
        own = [f"g{k:03d}{c}" for c in "abcdefgh"[: rng.randint(2, 7)]]
        pairs = [(a, b) for i, a in enumerate(own) for b in own[i + 1 :]]
        e = [(a, b, rng.choice([0.0, 0.1, 0.5, 0.6, 0.8, 0.9, 0.95, 1.0]), rng.random() < 0.8) for a, b in pairs if rng.random() < 0.6]
        m, c, s = ({p for p in pairs if rng.random() < q} for q in (0.08, 0.15, 0.08))
        if oracle(own, e, m, c, s, 0.9, 0.5) is None:
            continue
        nodes, edges, must, cannot, suppressed = nodes + own, edges + e, must | m, cannot | c, suppressed | s
    return nodes, edges, must, cannot, suppressed


def frames(spark, nodes, edges, must, cannot, suppressed):
    pair = lambda p: spark.createDataFrame(sorted(p), PAIR)
    return spark.createDataFrame([(n,) for n in nodes], "record_id string"), spark.createDataFrame(edges, EDGE), pair(must), pair(cannot), pair(suppressed)


def partition(parts):
    groups = {}
    for r in parts.collect():
        groups.setdefault(r.cluster_id, set()).add(r.record_id)
    assert all(k == min(v) for k, v in groups.items())
    return {frozenset(v) for v in groups.values()}


@pytest.mark.parametrize("seed", [1, 2])
def test_resolve_matches_the_oracle(spark, seed):
    g = graphs(seed, 80)
    parts, decisions = graph.resolve(*frames(spark, *g))
    want, rows = oracle(*g, 0.9, 0.5)
    assert partition(parts) == want
    assert sorted([tuple(r)[:5] for r in decisions.collect()], key=str) == rows
    assert {r.reason for r in decisions.collect()} >= {"score_at_or_above_threshold", "cluster_cannot_link", "candidate_requires_review", "explicit_must_link"}


def passed(nodes, edges, must, cannot):
    """The cannot-links that each merging or waiting edge meets, by sets of members."""
    group, out = {n: {n} for n in nodes}, {}

    def union(x, y):
        whole = group[x] | group[y]
        for n in whole:
            group[n] = whole

    for x, y in must:
        union(x, y)
    closed = {n: frozenset(g) for n, g in group.items()}
    for x, y, s, auto in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if (x, y) in must or (x, y) in cannot or closed[x] == closed[y] or auto and s < 0.9:
            continue
        met = sorted(p for p in cannot if group[x] != group[y] and ({p[0], p[1]} & group[x] and {p[0], p[1]} & group[y]))
        if met:
            out[x, y] = met
        elif auto:
            union(x, y)
    return out


@pytest.mark.parametrize(("n", "apart", "ties"), [(60, 40, 5), (120, 12, 1000), (40, 150, 1000)])
def test_one_large_component_in_rounds(spark, n, apart, ties):
    """One component with many inner cannot-links, chains and hubs: partition, reasons and conflicts as in one pass."""
    rng = random.Random(n)
    nodes = [f"n{k:03d}" for k in range(n)]
    pick = lambda: tuple(sorted(rng.sample(nodes, 2)))
    pairs = {pick() for _ in range(4 * n)} | {("n000", x) for x in nodes[1 : n // 2]} | set(zip(nodes, nodes[1:], strict=False))
    edges = [(x, y, 0.9 + rng.randint(0, ties) / ties / 10 if x != "n000" else 1.0 - int(y[1:]) / 1e4, rng.random() < 0.85) for x, y in sorted(pairs)]
    must = {pick() for _ in range(n // 15)}
    cannot, suppressed = {pick() for _ in range(apart)}, {pick() for _ in range(5)} - must
    while oracle(nodes, edges, must, cannot, suppressed, 0.9, 0.5) is None:
        cannot.pop()
    cannot -= must
    g = (nodes, edges, must, cannot, suppressed)
    parts, decisions = graph.resolve(*frames(spark, *g))
    want, rows = oracle(*g, 0.9, 0.5)
    assert partition(parts) == want and len(want) > 1
    got = decisions.collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == rows
    met = {(r.left, r.right): [tuple(c) for c in r.conflicts] for r in got if r.reason == "cluster_cannot_link"}
    assert met == passed(nodes, [e for e in edges if e[:2] not in suppressed], must, cannot) and met


def test_transitive_conflict_names_the_pair(spark):
    """Two clusters of three grow; the edge that would join them names both cannot-links between them."""
    edges = [("k1", "k2", 0.97, True), ("k2", "k3", 0.96, True), ("m1", "m2", 0.95, True), ("m2", "m3", 0.94, True), ("k3", "m1", 0.92, True), ("k1", "m3", 0.3, True)]
    g = (["k1", "k2", "k3", "m1", "m2", "m3"], edges, set(), {("k1", "m2"), ("k2", "m3")}, set())
    parts, decisions = graph.resolve(*frames(spark, *g))
    assert partition(parts) == {frozenset(["k1", "k2", "k3"]), frozenset(["m1", "m2", "m3"])}
    row = decisions.where("left = 'k3' and right = 'm1'").first()
    assert row.status == "conflict" and [tuple(c) for c in row.conflicts] == [("k1", "m2"), ("k2", "m3")]


def test_contradiction_fails(spark):
    g = (["a", "b", "c"], [("a", "b", 0.9, True)], {("a", "b"), ("b", "c")}, {("a", "c")}, set())
    with pytest.raises(Exception, match="cannot-link inside"):
        graph.resolve(*frames(spark, *g))[0].collect()


def test_empty_graph(spark):
    parts, decisions = graph.resolve(*frames(spark, ["a"], [], set(), set(), set()))
    assert partition(parts) == {frozenset("a")} and decisions.collect() == []


def test_incremental_equals_full(spark):
    nodes, edges, must, cannot, suppressed = graphs(5, 30)
    records, e, m, c, s = frames(spark, nodes, edges, must, cannot, suppressed)
    before, _ = graph.resolve(records, e, m, c, s)
    changed = [(x, y, 1.0 if x.startswith("g003") else v, a) for x, y, v, a in edges if not x.startswith("g007")]
    seeds = spark.createDataFrame([(n,) for n in nodes if n[:4] in ("g003", "g007")], "record_id string")
    e2 = spark.createDataFrame(changed, EDGE)
    full, _ = graph.resolve(records, e2, m, c, s)
    part = incremental.recompute(records, e2, m, c, s, before, seeds, 0.9, 0.5)
    assert partition(part) == partition(full)


def test_identities_and_lineage(spark):
    old = spark.createDataFrame([("a", "E1"), ("b", "E1"), ("c", "E2"), ("d", "E3"), ("e", "E3"), ("x", "E4")], "record_id string, entity_id string")
    parts = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "e")], "record_id string, cluster_id string")
    now = identity.assign(parts, old)
    ids = {r.record_id: r.entity_id for r in now.collect()}
    assert ids["a"] == ids["b"] == "E1" and ids["c"] == ids["d"] != "E2" and ids["e"] != "E3"
    kinds = {(r.from_entity, r.kind) for r in identity.lineage(old, now).collect()}
    assert kinds == {("E1", "CONTINUE"), ("E2", "MERGE"), ("E3", "SPLIT"), ("E3", "MERGE")}


def test_constraints_follow_versions_and_policies(spark):
    d = spark.createDataFrame([("1", "a", "b", "v1", "v1", "accept"), ("2", "a", "c", "v1", "v1", "reject"), ("3", "b", "c", "v1", "v0", "accept"), ("4", "c", "b", "v1", "v1", "abstain"), ("5", "a", "d", "v1", "v1", "accept")], "decision_id string, left string, right string, left_version string, right_version string, verdict string")
    e = spark.createDataFrame([("1", 1, "CREATE", "p"), ("2", 2, "CREATE", "p"), ("3", 3, "CREATE", "p"), ("4", 4, "CREATE", "p"), ("5", 5, "CREATE", "p"), ("5", 6, "REVOKE", "q"), ("1", 7, "EXPIRE", "p")], "decision_id string, seq long, action string, policy string")
    live = spark.createDataFrame([(x, "v1") for x in "abcd"], "record_id string, version string")
    got = lambda cutoff: {tuple(r) for r in identity.constraints(d, e, live, "p", cutoff).collect()}
    assert got(None) == {("a", "c", "cannot"), ("b", "c", "suppressed")}
    assert got(5) == {("a", "b", "must"), ("a", "c", "cannot"), ("b", "c", "suppressed"), ("a", "d", "must")}


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(300)]
    star = [("hub", f"z{i:03d}") for i in range(200)]
    label = graph.components(spark.createDataFrame(chain + star + [("self", "self")], PAIR))
    groups = {r.label: r.n for r in label.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert groups == {"n0000": 301, "hub": 201, "self": 1}


def test_lineage_and_ancestry_of_any_length(spark):
    from kinweave.operators import integrity

    n = 1500
    chain = [(f"e{i:04d}", f"e{i + 1:04d}") for i in range(n)] + [("e0700", "side"), ("x", "y"), ("y", "x"), ("y", "e1499")]
    wanted = spark.createDataFrame([("e0000",), ("e0701",), ("x",), ("gone",), ("side",)], "entity_id string")
    current = spark.createDataFrame([(f"e{n:04d}",), ("side",), ("e0900",)], "entity_id string")
    got = {tuple(r) for r in identity.resolve_retired(spark.createDataFrame(chain, "from_entity string, to_entity string"), wanted, current).collect()}
    assert got == {("e0000", "e1500"), ("e0000", "side"), ("e0000", "e0900"), ("e0701", "e1500"), ("e0701", "e0900"), ("x", "e1500"), ("side", "side")}
    rows = [(f"r{i:04d}", f"r{i - 1:04d}" if i else None) for i in range(1200)] + [("a", "b"), ("b", "c"), ("c", "a"), ("below", "a"), ("alone", "missing")]
    left = integrity.ancestry_cycles(spark.createDataFrame(rows, "revision_id string, parent_id string"))
    assert {r.revision_id for r in left.collect()} == {"a", "b", "c", "below"}


def test_protected_split_keeps_each_pair_in_its_own_split(spark):
    from kinweave.operators import splits

    pairs = [("a", "b", 1, "test"), ("c", "d", 1, "validation"), ("e", "f", 1, "train"), ("a", "e", 0, "train"), ("c", "g", 0, "train"), ("g", "h", 0, "train"),
             ("f", "i", 0, "train"), ("k", "l", 1, "train"), ("l", "m", 1, "test"), ("m", "k", 0, "validation"), ("k", "z", 0, "test"), ("d", "b", 0, "test"), ("h", "g", 0, "validation")]
    got = splits.protected_split(spark.createDataFrame(pairs, "left string, right string, label int, original_split string"))
    rows = {(r.left, r.right): r for r in got.kept.collect()}
    # c and d stand in a test pair, so the validation pair of both goes; (g, h) counts once, in validation
    assert {(k, r.split) for k, r in rows.items()} == {(("a", "b"), "test"), (("b", "d"), "test"), (("g", "h"), "validation"), (("e", "f"), "train"), (("f", "i"), "train")}
    assert {(r.left, r.right) for r in got.purged.collect()} == {("c", "d"), ("a", "e"), ("c", "g")}
    assert {(r.left, r.right) for r in got.quarantined.collect()} == {("k", "l"), ("l", "m"), ("k", "m"), ("k", "z")}
    assert [tuple(r) for r in got.collapsed.collect()] == [("g", "h", 2)]
    assert rows["a", "b"].group_id == rows["b", "d"].group_id != rows["e", "f"].group_id == rows["f", "i"].group_id
    assert {tuple(r) for r in splits.purge_counts(got).collect()} >= {("purged", "train", 2), ("purged", "validation", 1), ("quarantined", "train", 1)}
