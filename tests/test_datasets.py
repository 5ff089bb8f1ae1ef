"""Data sets, verification and maintenance: small cases, and maintenance against a full run."""

import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import datasets, metrics
from kinweave.operators.incremental import Snapshot, maintain

PAIRS = "left long, right long, left_product long, right_product long, label int, hard boolean"


def test_offer_violations(spark):
    rows = [(1, 2, 7, 7, 1, False), (2, 1, 7, 7, 1, False), (3, 3, 8, 8, 1, False), (4, 5, 8, 9, 1, False), (5, 6, 10, 11, 0, True), (7, 8, 12, 12, 1, True)]
    got = {tuple(r) for r in datasets.offer_violations(spark.createDataFrame(rows, PAIRS)).collect()}
    assert got == {("self_pair", "3|3"), ("repeated_pair", "1|2"), ("offer_of_products", "5"), ("label_contradicts_products", "4|5"), ("hard_positive", "7|8")}
    assert datasets.offer_violations(spark.createDataFrame([], PAIRS)).collect() == []


def test_offer_groups_hold_pairs_and_products_together(spark):
    rows = [(1, 2, 7, 7, 1, False), (3, 4, 7, 8, 0, True), (5, 6, 9, 10, 0, False)]
    grouped = datasets.offer_groups(spark.createDataFrame(rows, PAIRS))
    assert {(r.left, r.group_id) for r in grouped.collect()} == {(1, "o:1"), (3, "o:1"), (5, "o:5")}
    s = datasets.offer_statistics(grouped).first()
    assert (s.records, s.products, s.pairs, s.positive, s.hard_negative, s.random_negative, s.dependency_groups, s.largest_group_pairs) == (6, 4, 3, 1, 1, 1, 2, 2)
    none = datasets.offer_statistics(datasets.offer_groups(spark.createDataFrame([], PAIRS))).first()
    assert none.pairs == none.records == none.largest_group_pairs == 0


def test_holdout_refuses(spark):
    people = spark.createDataFrame([(1,), (2,)], "e long")
    assert [tuple(r) for r in datasets.fresh_holdout(people, people.where("e = 1"), "e").collect()] == [(2, "test")]
    with pytest.raises(ValueError, match="gone"):
        datasets.fresh_holdout(people, spark.createDataFrame([(3,)], "e long"), "e")
    with pytest.raises(ValueError, match="fresh"):
        datasets.fresh_holdout(people, people, "e")


def test_alias_queries_skip_the_current_name(spark):
    r = spark.createDataFrame([("1", "a", "New Ltd", "x", "p", "c", "GB"), ("1", "b", "NEW", None, None, None, None), ("2", "a", "Only", "x", "p", "c", "GB")], "number string, source string, name string, address string, postcode string, city string, country string")
    names = spark.createDataFrame([("1", "new  ltd."), ("1", "Old B"), ("1", "Old A"), ("2", "Was")], "number string, name string")
    got = sorted(tuple(x) for x in datasets.alias_queries(r, names, "a", "b").collect())
    assert got == [("1", "current_address", "Old A", "x", "p", "c", "GB"), ("1", "name_only", "Old A", None, None, None, None), ("1", "partial_address", "Old A", None, "p", None, None)]


def test_private_ids_stay(spark):
    rows = lambda *x: spark.createDataFrame(x, "source string, source_key string, content string")
    empty = spark.createDataFrame([], "source string, source_key string, content string, record_id string, version_id string")
    first = datasets.private_ids(empty, rows(("s", "1", "a"), ("s", "1", "a")), "secret")
    old = first.collect()
    after = {(r.source_key, r.content): r for r in datasets.private_ids(first, rows(("s", "1", "a"), ("s", "1", "b"), ("s", "2", "a")), "secret").collect()}
    assert len(old) == 1 and len(after) == 3 and after["1", "a"] == old[0]
    assert after["1", "b"].record_id == old[0].record_id and after["1", "b"].version_id != old[0].version_id and after["2", "a"].record_id != old[0].record_id
    assert old[0].record_id != datasets.private_ids(empty, rows(("s", "1", "a")), "other").first().record_id


def test_learning_violations(spark):
    schema = "left string, right string, label int, group_id string, split string"
    rows = [("a", "b", 1, "a", "?"), ("b", "c", 1, "a", "?"), ("a", "c", 0, "x", "?")]
    got = {tuple(r) for r in datasets.learning_violations(spark.createDataFrame(rows, schema)).collect()}
    assert {("group", "a", "c"), ("negative_in_closure", "a", "c"), ("split", "a", "b")} <= got and ("group", "a", "b") not in got


@pytest.mark.parametrize("seed", [1, 2])
def test_weighted_budget_against_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = [("t", str(i), "z", rng.choice([0.1, 0.5, 0.9]), rng.randint(0, 1), rng.randint(0, 5)) for i in range(40)]
    used = found = 0
    for _, left, _, score, label, weight in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        take = min(weight, max(30 - used, 0))
        used, found = used + take, found + take * label
    df = spark.createDataFrame(rows, "track string, left string, right string, score double, label int, weight long")
    assert tuple(metrics.weighted_budget(df, ["track"], 30).first()) == ("t", used, found)


def _snapshot(spark, records, edges, must=(), cannot=(), threshold=0.9, policy="p"):
    pair = "left string, right string"
    df = lambda rows: spark.createDataFrame(list(rows), pair)
    return Snapshot(spark.createDataFrame([(r,) for r in records], "record_id string"), spark.createDataFrame([(*e, True) for e in edges], pair + ", score double, auto_merge boolean"), df(must), df(cannot), df([]), threshold, 0.5, policy)


def _clusters(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.cluster_id, set()).add(r.record_id)
    return {frozenset(v) for v in out.values()}


def test_maintenance_equals_a_full_run(spark):
    names = "abcdefgh"
    edges = [("a", "b", 0.95), ("b", "c", 0.92), ("d", "e", 0.99), ("f", "g", 0.6), ("g", "h", 0.97)]
    old = _snapshot(spark, names, edges, must=[("f", "g")])
    previous = old.solve()
    nothing = spark.createDataFrame([], "record_id string")
    for new in (
        _snapshot(spark, names.replace("b", ""), [e for e in edges if "b" not in e], must=[("f", "g")]),
        _snapshot(spark, names + "i", [*edges, ("e", "i", 0.91)], must=[("f", "g")]),
        _snapshot(spark, names, edges, must=[("f", "g")], cannot=[("a", "c")]),
        _snapshot(spark, names, edges),
    ):
        got, mode, reason = maintain(old, new, previous, nothing)
        assert (mode, reason) == ("incremental", "old_new_candidate_closure") and _clusters(got) == _clusters(new.solve())
    same, mode, _ = maintain(old, old, previous, nothing, budget=0)
    assert mode == "incremental" and _clusters(same) == _clusters(previous)


def test_maintenance_falls_back(spark):
    edges = [("a", "b", 0.95), ("b", "c", 0.92)]
    old = _snapshot(spark, "abc", edges)
    previous, changed = old.solve(), spark.createDataFrame([("a",)], "record_id string")
    got, mode, reason = maintain(old, old, previous, changed, budget=2)
    assert (mode, reason) == ("full", "closure_exceeds_budget_same_policy") and _clusters(got) == _clusters(previous)
    got, mode, reason = maintain(old, _snapshot(spark, "abc", edges, threshold=0.94), previous, changed.where(F.lit(False)))
    assert (mode, reason) == ("full", "policy_or_model_changed") and _clusters(got) == {frozenset("ab"), frozenset("c")}


def test_the_secret_of_private_ids_is_in_no_plan(spark):
    import hashlib
    import hmac

    from kinweave.functions import normalize as N

    df = spark.createDataFrame([("a", 1), (None, 2)], "s string, k long").select("s", "k", N.keyed_id(spark, "top-secret-word", "s", "k", prefix="r-").alias("id"))
    assert "top-secret-word" not in df._jdf.queryExecution().toString()
    message = {1: '{"p0":"a","p1":1}', 2: '{"p0":null,"p1":2}'}
    assert {r["k"]: r["id"] for r in df.collect()} == {k: "r-" + hmac.new(b"top-secret-word", m.encode(), hashlib.sha256).hexdigest() for k, m in message.items()}


def test_learning_export_has_four_splits_and_a_manifest(spark, tmp_path):
    from kinweave.sources.store import Workspace, export_learning, load_learning

    w = Workspace(spark, str(tmp_path / "w"))
    rows = [(f"l{i}", f"r{i}", i % 2, ("train", "validation", "calibration", "test")[i % 4]) for i in range(20)]
    pairs = spark.createDataFrame(rows, "left string, right string, label int, split string")
    manifest = export_learning(w, "learning/one", pairs, {"policy": "p"})
    assert {s: (m["rows"], m["positives"]) for s, m in manifest["splits"].items()} == {"train": (5, 0), "validation": (5, 5), "calibration": (5, 0), "test": (5, 5)}
    assert sum(df.count() for df in load_learning(w, "learning/one").values()) == 20
    pairs.where("split = 'train'").limit(1).write.mode("overwrite").parquet(f"{w.root}/learning/one/train")
    with pytest.raises(ValueError, match="digest"):
        load_learning(w, "learning/one")
    with pytest.raises(ValueError, match="splits"):
        export_learning(w, "learning/two", pairs.withColumn("split", F.lit("other")))


def test_equality_within_a_tolerance(spark):
    from kinweave.operators.incremental import equal_within

    t = lambda *rows: spark.createDataFrame(rows, "k string, v double")
    a = t(("x", 1.0), ("y", None), (None, 2.0))
    assert equal_within(a, t((None, 2.0 + 5e-13), ("x", 1.0), ("y", None)), ["k"], ["v"])
    assert not equal_within(a, t((None, 2.0 + 5e-12), ("x", 1.0), ("y", None)), ["k"], ["v"])
    assert not equal_within(a, t(("x", 1.0), ("y", 0.0), (None, 2.0)), ["k"], ["v"])
    assert not equal_within(a, t(("x", 1.0), ("y", None)), ["k"], ["v"]) and not equal_within(t(("x", 1.0), ("x", 1.0)), t(("x", 1.0), ("x", 1.0)), ["k"], ["v"])


def test_country_view_is_for_retrieval_alone(spark):
    from kinweave.functions import normalize as N
    from kinweave.operators import blocking

    fields = "record_id string, source string, name string, address string, city string, postcode string, country string"
    r = spark.createDataFrame([("1", "a", "ACME", None, None, None, "Great Britain"), ("2", "b", "ACME", None, None, None, "GB"), ("3", "b", "ACME", None, None, None, "Nowhere")], fields)
    aliases = N.country_aliases(spark.createDataFrame([("GB", "great britain"), ("GB", "gb")], "code string, alias string"))
    view = N.country_view(r, aliases)
    assert [tuple(p)[:2] for p in blocking.candidates(view).collect()] == [("1", "2")] and blocking.candidates(r).count() == 0
    assert view.columns == r.columns and {x["country"] for x in view.collect()} == {"iso:GB", "unrecognized:NOWHERE"}


def test_pinned_pair_tables(spark, tmp_path):
    import hashlib

    from kinweave.sources import archives

    texts = {"tableA": "id,n\n1,x\n", "tableB": "id,n\n2,y\n"} | {n: "ltable_id,rtable_id,label\n1,2,1\n" for n in ("train", "valid", "test")}
    for n, t in texts.items():
        (tmp_path / f"{n}.csv").write_text(t)
    pinned = {f"{n}.csv": hashlib.sha256(t.encode()).hexdigest() for n, t in texts.items()}
    assert archives.pair_tables(spark, str(tmp_path), "id string, n string", pinned)[2].count() == 3
    (tmp_path / "test.csv").write_text("ltable_id,rtable_id,label\n1,2,0\n")
    with pytest.raises(ValueError, match="test.csv"):
        archives.pair_tables(spark, str(tmp_path), "id string, n string", pinned)
