"""Literal search by character triples equals a scan, and reads only the files that hold the triples asked for."""

import random

from kinweave.operators import identity, textsearch


def test_searches_equal_a_scan(spark):
    rnd = random.Random(9)
    rows = [(i, "".join(rnd.choice("abcß漢 %_") for _ in range(rnd.randint(0, 14)))) for i in range(400)] + [(900, None), (901, "aaaa"), (902, "aab")]
    values = spark.createDataFrame(rows, "id long, value_folded string")
    table = textsearch.postings(values, ["id"])
    queries = ["a", "ab", "abc", "aaa", "b%_", "漢a", "ß漢", "zzz", "abca", " ab", *(v[2:7] for _, v in rows[:25] if v)]
    for q in queries:
        got = sorted(r["id"] for r in textsearch.literal(values, table, ["id"], q).collect())
        assert got == sorted(i for i, v in rows if v is not None and q in v), q


def test_written_postings_are_ranges_of_triples(spark, tmp_path):
    values = spark.range(5000).selectExpr("id", "concat('name ', sha2(string(id), 256)) value_folded")
    path = str(tmp_path / "postings")
    textsearch.stored(textsearch.postings(values, ["id"])).write.parquet(path)
    table = spark.read.parquet(path)
    plan = table.where("gram in ('abc', 'bcd')")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "In(gram" in plan
    spans = table.selectExpr("input_file_name() f", "gram").groupBy("f").agg({"gram": "min"}).orderBy("min(gram)").collect()
    assert len(spans) > 1 and len({r["min(gram)"] for r in spans}) == len(spans)
    got = sorted(r["id"] for r in textsearch.literal(values, table, ["id"], "abcd").collect())
    assert got == sorted(r["id"] for r in values.where("contains(value_folded, 'abcd')").collect()) and got


def test_a_page_without_postings_makes_no_triples(spark):
    rows = [("e1", "over the hill"), ("e2", None), ("e2", "weather"), ("e3", "tea"), ("e4", "THE"), ("e2", "the end")]
    search = spark.createDataFrame(rows, "entity_id string, value_folded string")
    page = identity.entity_page(search.select("entity_id"), search, "THE", 0, 10)
    assert [r.entity_id for r in page.collect()] == ["e1", "e2"]
    assert "Generate" not in page._jdf.queryExecution().optimizedPlan().toString()
    stored = textsearch.postings(search, ["entity_id", "value_folded"])
    assert identity.entity_page(search.select("entity_id"), search, "THE", 0, 10, stored).collect() == page.collect()
