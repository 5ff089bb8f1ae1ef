"""Query projections: searches equal those over the artifact, damage is refused, older revisions are projected once."""

import pytest
from pyspark.sql import functions as F

from kinweave.sources.projection import Projection
from kinweave.sources.store import Workspace

RECORDS = [
    ("v1", "Straße 100%_ ALPHA", ["Former Acme", "Beta Γ"]), ("v2", "STRASSE 100xxX ALPHA", ["Unrelated"]), ("v3", "OTHER ENTITY", ["Standalone", None]),
    ("v4", "ACME ALIAS", ["Distinct Old Name"]), ("v5", None, None),
]
MEMBERS = [("r1", "v1", "e1"), ("r4", "v4", "e1"), ("r2", "v2", "e2"), ("r3", "v3", "e3"), ("r5", "v5", "e4")]


def tables(spark):
    return {
        "records": spark.createDataFrame(RECORDS, "record_version_id string, name string, aliases array<string>"),
        "memberships": spark.createDataFrame(MEMBERS, "record_id string, record_version_id string, entity_id string"),
        "canonical": spark.createDataFrame([(f"e{i}", (f"name {i}", f"r{i}")) for i in (1, 2, 3, 4)], "entity_id string, canonical struct<value:string,record_id:string>"),
    }


def plain(query):
    names = {v: [n or "", *[a for a in (al or []) if a is not None]] for v, n, al in RECORDS}
    return sorted({e for _, v, e in MEMBERS if not query or any(query.casefold() in x.casefold() for x in names[v])})


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    p = Projection(Workspace(spark, str(tmp_path_factory.mktemp("projected"))))
    p.prepare("a", tables(spark), None, "p")
    p.publish("a")
    return p


@pytest.mark.parametrize("query", ["", "STRASSE", "100%_", "former acme", "βeta", "beta γ", "Distinct Old Name", "absent"])
def test_pages_equal_a_scan_of_the_artifact(published, query):
    want = plain(query)
    got = []
    for offset in range(0, len(want) + 1, 2):
        total, page = published.page(query, offset=offset, limit=2)
        assert total == len(want)
        got += [r["entity_id"] for r in page.collect()]
    assert got == want


def test_detail_has_the_frozen_versions_and_search_values_are_numbered(published):
    assert [(r["record_id"], r["record_version_id"], r["name"]) for r in published.detail("e1").collect()] == [("r1", "v1", "Straße 100%_ ALPHA"), ("r4", "v4", "ACME ALIAS")]
    got = [(r["ordinal"], r["value_folded"]) for r in published.table("search", "a").where("entity_id = 'e1'").orderBy("ordinal").collect()]
    assert got == list(enumerate(sorted(["strasse 100%_ alpha", "former acme", "beta γ", "acme alias", "distinct old name"])))


@pytest.mark.parametrize("damage", ["state", "canonical", "search", "missing_member", "member_version"])
def test_a_damaged_projection_is_not_published(spark, tmp_path, damage):
    w = Workspace(spark, str(tmp_path / "w"))
    p = Projection(w)
    p.prepare("a", tables(spark), None, "p")
    p.publish("a")
    p.prepare("b", tables(spark), "a", "p")

    def put(name, change):
        kept = p.table(name, "b").collect()
        rows = change(spark.createDataFrame(kept, p.table(name, "b").schema)).withColumn("revision", F.lit("b"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("revision").parquet(f"{p.root}/{name}")

    if damage == "state":
        w.fs.delete(w._path(f"{w.root}/projection/state/b.json"), False)
    elif damage == "canonical":
        put("entities", lambda t: t.withColumn("canonical", F.struct(F.lit("CORRUPT").alias("value"), F.col("canonical.record_id"))))
    elif damage == "search":
        put("search", lambda t: t.withColumn("value_folded", F.lit("corrupt")))
    elif damage == "missing_member":
        put("members", lambda t: t.where("record_id <> 'r1'"))
    else:
        put("members", lambda t: t.withColumn("record_version_id", F.lit("v2")))
    with pytest.raises(ValueError, match="projection"):
        p.publish("b")
    assert w.current() == "a" and p.status("a", verify=True)["ready"]
    with pytest.raises(LookupError):
        p.page(revision="b")
    p.write("b")  # rebuilt from the artifact
    p.publish("b")
    assert w.current() == "b" and p.status(verify=True)["ready"]


def test_a_revision_of_before_projections_is_projected_when_asked_for_and_a_lost_one_is_an_error(spark, tmp_path):
    w = Workspace(spark, str(tmp_path / "w"))
    p = Projection(w)
    assert p.status()["status"] == "no_published_revision"
    w.prepare("old", tables(spark), None, "p")
    w.publish("old")
    assert p.status()["status"] == "missing"
    assert p.page("acme")[0] == len(plain("acme"))
    assert p.status(verify=True)["ready"]
    p.prepare("new", tables(spark), "old", "p")
    p.publish("new")
    w.fs.delete(w._path(f"{w.root}/projection/state/new.json"), False)
    with pytest.raises(ValueError, match="missing"):
        p.page("acme")
    assert p.page("acme", revision="old")[0] == len(plain("acme"))  # the other partition is as it was
