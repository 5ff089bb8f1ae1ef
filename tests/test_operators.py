"""Features, models, metrics, review, splits, sources, stores, streams and the whole run."""

import io
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from kinweave.functions import normalize as N
from kinweave.functions import similarity as S
from kinweave.operators import blocking, incremental, integrity, metrics, retrieval, review, scoring, splits
from kinweave.plans import match
from kinweave.sources import archives
from kinweave.sources.store import Workspace, export_csv
from kinweave.streaming import imports

RECORD = "record_id string, source string, name string, address string, city string, postcode string, country string"


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(column).collect()]


def test_normalization(spark):
    assert one(spark, N.normalize_text("v"), " Straße&Co. ", "x²y", "ñandu", "", None, "A_b  c") == ["STRASSE CO", "X2Y", "ÑANDU", None, None, "A_B C"]
    assert one(spark, N.normalize_postcode("v"), " sw1a 1aa") == ["SW1A1AA"]
    assert one(spark, N.company_number("v"), " 0123456a ", "123", "12345678x") == ["0123456A", None, None]
    assert one(spark, N.price("v"), "1.50", "-1", "0", "1e5", "x") == [1.5, None, None, None, None]
    assert one(spark, N.formula_guard("v"), "=1+1", "ok", "@x", "\tx") == ["'=1+1", "ok", "'@x", "'\tx"]
    assert one(spark, N.casefold("v"), "STRASSE", "straße", "ΟΔΟΣ", "οδός", "ﬁne", "ǅ", None) == ["strasse", "strasse", "οδοσ", "οδόσ", "fine", "ǆ", None]
    assert one(spark, N.redacted("v", F.lit("12-34")), "no 1234 here", "fine") == [None, "fine"]


def test_register_countries(spark):
    known = {"England": "GB", "wales ": "GB", "SCOTLAND": "GB", "Northern Ireland": "GB", "United Kingdom": "GB", "GREAT BRITAIN": "GB", "Jersey": "JE", "GUERNSEY": "GG", " Isle of Man": "IM", "PANAMA": "PA", "Cayman Islands": "KY", "AUSTRALIA": "AU"}
    unknown = ["FRANCE", "GERMANY", "SPAIN", "IRELAND", "UNITED STATES", "NETHERLANDS", "ENGLAND & WALES", ""]
    assert one(spark, N.register_country("v"), *known, *unknown, None) == [*known.values(), *[None] * (len(unknown) + 1)]


def test_similarities():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))) for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert S.lcs_length(a, b) == table[-1][-1]
        assert S.indel_ratio(a, b) == S.indel_ratio(b, a)
    assert S.token_set_ratio("a b c", "c b a x") == 1.0 and S.token_set_ratio("", "a") == 0.0
    assert abs(S.jaro_winkler("MARTHA", "MARHTA") - 0.961111) < 1e-6


def records(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (7 - len(r))) for r in rows], RECORD)


def test_blocking_rules_and_budget(spark):
    r = records(spark, [("1", "a", "ACME HOLDINGS", "1 ROAD", None, "X1", "GB"), ("2", "b", "ACME HOLDINGS", "1 ROAD", None, "X1", None), ("3", "b", "ACME HOLD", None, None, None, "FR"), ("4", "a", "", "", None, "", "GB")])
    got = {(x.left, x.right): x.rules for x in blocking.candidates(r).collect()}
    assert got == {("1", "2"): ["address_exact", "name_exact", "name_prefix8", "postcode_name_prefix3"]}
    with pytest.raises(ValueError, match="name_prefix8"):
        blocking.check_budget(r, 1)


def test_word_grams(spark):
    assert one(spark, F.array_join(retrieval.word_grams(F.col("v")), "|"), "ab", "a") == [" ab|ab | ab ", " a "]


def test_retrieval_is_symmetric_and_bounded(spark):
    r = records(spark, [("1", "a", "NORTHERN STEEL WORKS"), ("2", "b", "NORTHERN STEEL WORK"), ("3", "b", "SOUTHERN STEEL WORKS"), ("4", "a", "BAKERY")])
    got = {(x.left, x.right) for x in retrieval.name_retrieval(r, retrieval.fit_vocabulary(r), 1, 0.1).collect()}
    assert ("1", "2") in got and not any("4" in p for p in got)


def test_linear_model_and_platt(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"l{i}", f"r{i}", x := rng.random(), int(rng.random() < 1 / (1 + math.exp(-8 * (x - 0.5))))) for i in range(400)]
    df = spark.createDataFrame(rows, "left string, right string, x double, label int")
    m = scoring.fit_linear(df, ["x"])
    w, b = 0.0, 0.0
    for _ in range(60):  # Newton's method on the same objective
        ps = [1 / (1 + math.exp(-(w * x + b))) for _, _, x, _ in rows]
        gw, gb = sum((p - y) * x for p, (_, _, x, y) in zip(ps, rows)) + w, sum(p - y for p, (*_, y) in zip(ps, rows))
        hww, hwb, hbb = sum(p * (1 - p) * x * x for p, (_, _, x, _) in zip(ps, rows)) + 1, sum(p * (1 - p) * x for p, (_, _, x, _) in zip(ps, rows)), sum(p * (1 - p) for p in ps)
        det = hww * hbb - hwb * hwb
        w, b = w - (hbb * gw - hwb * gb) / det, b - (hww * gb - hwb * gw) / det
    assert abs(m.weights[0] - w) < 1e-5 and abs(m.intercept - b) < 1e-5
    m.save(spark, str(tmp_path / "m.json"))
    assert scoring.Linear.load(spark, str(tmp_path / "m.json")) == m
    scored = df.select("label", m.probability().alias("score"))
    assert scoring.fit_platt(scored)[0] > 0 and scoring.fit_platt(scored.limit(5)) == (1.0, 0.0)
    with pytest.raises(ValueError):
        scoring.check_labels(df.where("label = 1"))


def test_replayed_tree(spark):
    tree = {"feature": [0, 0, 0], "threshold": [0.5, 0, 0], "left": [1, -1, -1], "right": [2, -1, -1], "value": [0, -1.0, 2.0]}
    df = spark.createDataFrame([(0.5,), (0.6,)], "x double")
    assert [r[0] for r in df.select(scoring.tree_logit([tree], ["x"], 0.1, 0.5)).collect()] == [-0.4, 1.1]


def test_fellegi_sunter_separates(spark):
    rng, rows = random.Random(3), []
    for i in range(300):
        name = "".join(rng.choice("ABCDEFGH") for _ in range(8))
        other = name if i % 3 == 0 else "".join(rng.choice("ABCDEFGH") for _ in range(8))
        rows.append((f"l{i}", f"r{i}", name, other, "P1" if i % 3 == 0 else "P2", "P1", name, other, int(i % 3 == 0)))
    p = spark.createDataFrame(rows, "left string, right string, name_l string, name_r string, postcode_l string, postcode_r string, address_l string, address_r string, label int")
    levels = scoring.agreement_levels(p).cache()
    model = scoring.fit_fellegi_sunter(levels, scoring.estimate_u(levels.where("label = 0")), 0.3)
    s = model.match_weight(levels).groupBy("label").agg(F.min("score").alias("lo"), F.max("score").alias("hi")).collect()
    by = {r.label: r for r in s}
    assert by[1].lo > 0.99 and by[0].hi < 0.5


def test_metrics_edges(spark):
    rows = [("t", "a", "b", 0.9, 1), ("t", "a", "c", 0.9, 0), ("t", "a", "d", 0.2, 1), ("n", "x", "y", 0.5, 0)]
    df = spark.createDataFrame(rows, "track string, left string, right string, score double, label int")
    c = {r.track: r for r in metrics.labelled_confusion(df, ["track"], 0.5).collect()}
    assert c["t"].precision == 0.5 and c["n"].recall is None
    r = {x.track: x for x in metrics.ranking(df, ["track"]).collect()}
    assert abs(r["t"].average_precision - (0.5 * 0.5 + 0.5 * 2 / 3)) < 1e-12 and r["n"].average_precision is None
    b = {x.track: x for x in metrics.best_threshold(df, ["track"]).collect()}
    assert b["n"].threshold is None and b["n"].cost == 0
    curve = [x for x in metrics.review_budgets(df, ["track"], [1, 2]).collect() if x.track == "t"]
    assert {(x.budget, x.positives, x.negatives, x.ties) for x in curve} == {(1, 1, 0, 2), (2, 1, 1, 2)}


def test_trees_are_exported_replayed_saved_and_verified(spark, tmp_path):
    import dataclasses
    import math

    rng = random.Random(11)
    rows = [(f"l{i}", f"r{i}", x := rng.random(), y := rng.random(), int(x * y + 0.1 * rng.random() > 0.3)) for i in range(300)]
    df = spark.createDataFrame(rows, "left string, right string, x double, y double, label int")
    model = scoring.fit_trees(df, ["x", "y"], trees=12, depth=3, rate=0.3)  # fails by itself where replay and fit differ
    assert len(model.trees) == 12 and max(t["feature"][0] for t in model.trees) >= 0

    def plain(x, y):
        total = 0.0
        for t in model.trees:
            i = 0
            while t["left"][i] != -1:
                i = t["left"][i] if (x, y)[t["feature"][i]] <= t["threshold"][i] else t["right"][i]
            total += t["value"][i]
        return 1 / (1 + math.exp(-total))

    got = {r["left"]: r["p"] for r in df.select("left", model.probability().alias("p")).collect()}
    assert all(abs(got[r[0]] - plain(r[2], r[3])) < 1e-12 for r in rows)
    assert sum((got[r[0]] > 0.5) == bool(r[4]) for r in rows) > 270
    path = str(tmp_path / "trees.json")
    model.save(spark, path)
    assert scoring.Trees.load(spark, path) == model
    with pytest.raises(ValueError, match="not a Linear"):
        scoring.Linear.load(spark, path)
    text = (tmp_path / "trees.json").read_text()
    (tmp_path / ".trees.json.crc").unlink(missing_ok=True)
    (tmp_path / "trees.json").write_text(text.replace('"base": 0.0', '"base": 0.5'))
    with pytest.raises(ValueError, match="fingerprint"):
        scoring.Trees.load(spark, path)
    assert dataclasses.replace(model, platt=(1.0, 0.0)).fingerprint() != model.fingerprint()

def test_bucket_pairs_of_hot_buckets_are_dealt_out_in_cells(spark):
    from kinweave.operators import blocking

    rows = [("hot", f"h{i:04}", i % 3) for i in range(500)] + [("small", f"s{i}", i % 2) for i in range(5)] + [("one", "o", 0), (None, "n1", 0), (None, "n2", 1)]
    df = spark.createDataFrame(rows, "k string, id string, src int")
    met = blocking.bucket_pairs(df, ["k"], "id", ["src"], cell=32)
    got = [tuple(sorted((r["id1"], r["id2"]))) for r in met.collect()]
    want = [tuple(sorted((a[1], b[1]))) for i, a in enumerate(rows) for b in rows[:i] if a[0] == b[0] and a[0] is not None]
    assert len(got) == len(set(got)) and sorted(got) == sorted(want)
    source = {(r["id1"], r["src1"]) for r in met.collect()} | {(r["id2"], r["src2"]) for r in met.collect()}
    assert source <= {(r[1], r[2]) for r in rows}


def greedy_queue(rows, limit, key):
    waiting, out = sorted(rows, key=key), []
    while waiting and len(out) < limit:
        used, rest = set(), []
        for r in waiting:
            if r[0] in used or r[1] in used:
                rest.append(r)
            else:
                used |= {r[0], r[1]}
                out.append(r)
        waiting = rest
    return out[:limit]


def test_review_queue_equals_the_sequential_rule(spark):
    import hashlib

    rng = random.Random(4)
    rows = sorted({(f"a{rng.randint(0, 6)}", f"b{rng.randint(0, 6)}") for _ in range(30)})
    rows = [(a, b, rng.choice([0.4, 0.5, 0.7])) for a, b in rows]
    key = lambda r: (abs(r[2] - 0.5), hashlib.sha256(f"7|{r[0]}|{r[1]}".encode()).hexdigest())
    got = review.review_queue(spark.createDataFrame(rows, "left string, right string, score double"), 12).orderBy("rank").collect()
    assert [(r.left, r.right, r.score) for r in got] == greedy_queue(rows, 12, key)


@pytest.mark.parametrize("prefixes,hubs,limit", [((4, 16, 64), 400, 25), ((1, 2, 8), 400, 25), ((1, 2), 3, 10), ((), 9, 12)])
def test_review_queue_from_prefixes_and_over_the_whole_graph(spark, monkeypatch, prefixes, hubs, limit):
    import hashlib

    monkeypatch.setattr(review, "PREFIXES", prefixes)
    rng = random.Random(hubs)
    rows = sorted({(f"a{rng.randint(0, hubs)}", f"b{rng.randint(0, 400)}") for _ in range(600)})
    rows = [(a, b, round(rng.random(), 2)) for a, b in rows]
    key = lambda r: (abs(r[2] - 0.5), hashlib.sha256(f"7|{r[0]}|{r[1]}".encode()).hexdigest())
    got = review.review_queue(spark.createDataFrame(rows, "left string, right string, score double"), limit).orderBy("rank").collect()
    assert [(r.left, r.right, r.score) for r in got] == greedy_queue(rows, limit, key)
    assert [r["rank"] for r in got] == list(range(1, limit + 1))


def test_splits_do_not_leak(spark):
    rng = random.Random(5)
    rows = [(f"a{k}{rng.randint(0, 2)}", f"b{k}{rng.randint(0, 2)}", 1, "train" if rng.random() < 0.7 else "test") for k in range(60) for _ in range(3)]
    df = spark.createDataFrame(sorted(set(rows)), "left string, right string, label int, original_split string")
    for out in (splits.endpoint_split(df.drop("original_split")), splits.protected_split(df)[0]):
        assert splits.leaks(out).count() == 0 and out.count() > 0
    kept, dropped = splits.positive_split(df.drop("original_split"))
    assert kept.count() + dropped.count() == df.count()
    bad = spark.createDataFrame([("a", "b", 1), ("b2", "c", 1), ("a", "c2", 1), ("b", "c2", 0)], "left string, right string, label int").where("left <> 'b2'")
    with pytest.raises(ValueError):
        splits.endpoint_split(spark.createDataFrame([("a", "b", 1), ("a", "c", 1), ("b", "c", 0)], "left string, right string, label int"))
    assert bad.count() == 3


def test_adjudication(spark):
    j = spark.createDataFrame([("a", "b", "TP"), ("b", "a", "TP"), ("c", "d", "Ambiguous"), ("e", "f", "TP"), ("f", "e", "TN"), ("g", "h", "TN")], "left string, right string, type string")
    kept, removed = splits.adjudicated(j)
    assert {tuple(r) for r in kept.collect()} == {("a", "b", 1), ("g", "h", 0)} and {tuple(r) for r in removed.collect()} == {("c", "d"), ("e", "f")}


def zipped(path, name, text):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(name, text)


def test_register_archives(spark, tmp_path):
    zipped(tmp_path / "r.zip", "r.csv", "CompanyName, CompanyNumber,RegAddress.PostTown,PreviousName_1.CompanyName,PreviousName_1.CONDATE,RegAddress.Country\nAcme,01234567,Leeds,Old Acme,01/02/2003,England\n,01234568,,,,\nBad,12,,,,\nShort,1\n")
    good, bad = archives.national_register(spark, str(tmp_path / "r.zip"))
    row = good.first()
    assert (row.source_key, row.name, row.country, row.previous_names[0].name) == ("01234567", "Acme", "GB", "Old Acme")
    assert sorted(r.reason for r in bad.collect()) == ["invalid_number", "missing_name", "wrong_width"]
    zipped(tmp_path / "g.zip", "g.csv", "LEI,Entity.LegalName,Entity.LegalAddress.Country,Entity.LegalAddress.FirstAddressLine\nL1,Alpha,GB,1 Way\nL2,Beta,FR,x\n,Gamma,GB,y\n")
    good, bad = archives.golden_copy(spark, str(tmp_path / "g.zip"), "GB")
    assert [r.source_key for r in good.collect()] == ["L1"] and [r.reason for r in bad.collect()] == ["missing_key"]
    with pytest.raises(Exception, match="lacks"):
        archives.zip_csv(spark, str(tmp_path / "g.zip"), ("Nope",)).collect()


def test_workbook_and_nested_archives(spark, tmp_path):
    import gzip

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>one</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row><row><c r="B2" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
    with zipfile.ZipFile(tmp_path / "named.xlsx", "w") as z:  # the second member is the first sheet
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="first" r:id="x2"/><sheet name="other" r:id="x1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="x1" Target="worksheets/sheet1.xml"/><Relationship Id="x2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        for k, v in ((1, "one"), (2, "two")):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet {ns}><sheetData><row/><row><c r="AA1"><v>{v}</v></c><c><v>next</v></c></row></sheetData></worksheet>')
    named = (tmp_path / "named.xlsx").read_bytes()
    assert list(archives.workbook_rows(named)) == [[], [""] * 26 + ["two", "next"]] and list(archives.workbook_rows(named, "other"))[1][26] == "one"
    assert [r.cells for r in archives.workbook(spark, str(tmp_path / "w.xlsx")).orderBy("line").collect()] == [["one", "", "3"], ["", "in"]]
    with zipfile.ZipFile(tmp_path / "n.zip", "w") as z:
        packed = io.BytesIO()
        with gzip.GzipFile(fileobj=packed, mode="w") as g:
            g.write(b'{"a": 1}\n{"a": 2}\n')
        z.writestr("x.jsonl.gz", packed.getvalue())
    assert sorted(r.a for r in archives.nested_jsonl(spark, str(tmp_path / "n.zip"), "a int").collect()) == [1, 2]
    with pytest.raises(Exception, match="bounds"):
        archives.nested_jsonl(spark, str(tmp_path / "n.zip"), "a int", most_rows=1).collect()


def test_labels_and_hashes(spark, tmp_path):
    (tmp_path / "l.csv").write_text("a,b,true\nc,d,FALSE\n")
    assert [tuple(r) for r in archives.label_csv(spark, str(tmp_path / "l.csv")).collect()] == [("a", "b", 1), ("c", "d", 0)]
    got = archives.verify_hashes(spark, str(tmp_path / "l.csv"), {"l.csv": "0" * 64}).first()
    assert got.name == "l.csv" and not got.ok


def test_workspace_publishes_whole_revisions(spark, tmp_path):
    w = Workspace(spark, f"file://{tmp_path}/w")
    r = records(spark, [("1", "a", "ACME"), ("2", "b", "ACME"), ("3", "a", "OTHER")])
    match.run(w, "r1", r, match.Policy())
    with pytest.raises(LookupError):
        w.table("membership")
    w.publish("r1")
    first = {x.record_id: x.entity_id for x in w.table("membership").collect()}
    assert first["1"] == first["2"] != first["3"]
    match.run(w, "r2", r.where("record_id <> '2'"), match.Policy(), publish=True)
    second = {x.record_id: x.entity_id for x in w.table("membership").collect()}
    assert second["3"] == first["3"] and second["1"] != first["1"]
    assert {(x.from_entity, x.kind) for x in w.table("lineage").collect()} == {(first["3"], "CONTINUE"), (first["1"], "SPLIT")}
    with pytest.raises(ValueError, match="parent"):
        w.publish("r1")
    w.load("revisions/r2/membership").limit(1).write.mode("overwrite").parquet(f"file://{tmp_path}/w/revisions/r2/records")
    with pytest.raises(ValueError, match="digest"):
        w.verify("r2")
    export_csv(spark.createDataFrame([("=x", 1)], "a string, b int"), f"file://{tmp_path}/csv")
    assert "'=x" in spark.read.text(f"file://{tmp_path}/csv").where("value like '%x%'").first()[0]


def test_policy_is_checked():
    for bad in ({"threshold": 0.4}, {"review_threshold": 0.0}, {"candidates": "all"}):
        with pytest.raises(ValueError):
            match.Policy(**bad)
    assert not match.Policy(candidates="hybrid").incremental


def test_hybrid_run_finds_more(spark):
    r = records(spark, [("1", "a", "NORTHERN STEEL WORKS", None, None, None, None), ("2", "b", "THE NORTHERN STEEL WORKS", None, None, None, None)])
    fixed, hybrid = (match.candidate_pairs(r, match.Policy(candidates=c)).count() for c in ("fixed", "hybrid"))
    assert (fixed, hybrid) == (0, 1)


def test_streamed_imports_version_and_replay(spark, tmp_path):
    sink = imports.VersionedImport(spark, f"file://{tmp_path}/s", ["name"])
    schema = "source string, source_key string, name string, tombstone boolean, seq long"
    batch = lambda rows: spark.createDataFrame(rows, schema)
    state = lambda: {r.source_key: (r.version, r.tombstone) for r in sink.state().collect()}
    sink(batch([("s", "k", "A", False, 1), ("s", "j", "J", False, 2)]), 0)
    first = state()
    sink(batch([("s", "k", "B", False, 3)]), 1)
    sink(batch([("s", "k", "ignored", False, 9)]), 1)  # a replay
    assert state()["j"] == first["j"] and state()["k"] != first["k"]
    second = state()
    sink(batch([("s", "k", "A", False, 4)]), 2)
    assert state()["k"][0] not in (first["k"][0], second["k"][0])
    sink(batch([("s", "k", "A", True, 5)]), 3)
    assert state()["k"][1] is True


def test_streamed_imports_write_what_they_change_and_compact(spark, tmp_path):
    import os

    sink = imports.VersionedImport(spark, f"file://{tmp_path}/s", ["name"], compact=3)
    schema = "source string, source_key string, name string, tombstone boolean, seq long"
    size = lambda name: sum(f.endswith(".parquet") for _, _, fs in os.walk(tmp_path / "s" / name) for f in fs)
    plain, versions = {}, {}
    rng = random.Random(5)
    for batch in range(5):
        keys = [f"k{i}" for i in range(200)] if batch == 0 else [f"k{rng.randint(0, 210)}" for _ in range(4)]
        rows = [("s", k, rng.choice("ab"), rng.random() < 0.2, i) for i, k in enumerate(keys)]
        sink(spark.createDataFrame(rows, schema), batch)
        for _, k, name, gone, _ in [r for i, r in enumerate(rows) if r[1] not in [x[1] for x in rows[i + 1 :]]]:
            if plain.get(k) != (name, gone):
                plain[k], versions[k] = (name, gone), f"s:{k}:{batch}"
        got = {r.source_key: (r.version, r.tombstone) for r in sink.state().collect()}
        assert got == {k: (versions[k], plain[k][1]) for k in plain}
    assert 0 < size("log/batch=4") <= 4 < size("log/batch=0")  # as many files as buckets that changed
    assert sink._pointer() == {"last": 4, "base": 2}
    assert sink.state(1).count() <= sink.state(4).count() and sink.state(0).count() == 200
    before = sorted(map(tuple, sink.state().collect()))
    sink.vacuum()
    assert sorted(map(tuple, sink.state().collect())) == before and not os.path.exists(tmp_path / "s/log/batch=1")
    with pytest.raises(LookupError):
        sink.state(1)


def test_stream_end_to_end(spark, tmp_path):
    rows = spark.createDataFrame([("s", f"k{i % 3}", f"n{i}", False, i) for i in range(9)], "source string, source_key string, name string, tombstone boolean, seq long")
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    sink = imports.VersionedImport(spark, f"file://{tmp_path}/out", ["name"])
    q = imports.run_import(spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in"), sink, f"file://{tmp_path}/ck")
    q.awaitTermination()
    assert sink.state().count() == 3


def test_integrity_queries(spark):
    rev = spark.createDataFrame([("r1", None), ("r2", "r1"), ("x", "y"), ("y", "x")], "revision_id string, parent_id string")
    assert sorted(r[0] for r in integrity.ancestry_cycles(rev).collect()) == ["x", "y"]
    r = records(spark, [("1", "a", "A"), ("1", "a", "B")])
    with pytest.raises(ValueError, match="repeats"):
        integrity.check_records(r, tuple(r.columns))
    bad = spark.createDataFrame([("1", "2", 1.5)], "left string, right string, score double")
    with pytest.raises(ValueError):
        integrity.check_edges(bad, r)
    pairs = spark.createDataFrame([("a", "b", "g"), ("b", "a", "g"), ("a", "c", "h")], "left string, right string, group_id string")
    assert {x.rule for x in integrity.label_violations(pairs).collect()} == {"repeated_pair", "endpoint_in_groups"}


def test_refreshed_scores_equal_full_scores(spark):
    rng = random.Random(6)
    rows = [(f"r{i:02d}", "ab"[i % 2], f"NAME {rng.randint(0, 9)} X", None, None, None, None) for i in range(40)]
    old, new = records(spark, rows), records(spark, [(*r[:2], "NAME 3 X", *r[3:]) if r[0] == "r07" else r for r in rows if r[0] != "r11"])
    score = lambda recs, pairs: scoring.fuzzy_scores(blocking.with_records(pairs, recs, ["name"]))
    full = lambda recs: score(recs, blocking.candidates(recs)).select("left", "right", "score")
    assert incremental.equal_sets(incremental.refresh_scores(old, new, full(old), score), full(new))


def test_backup_and_restore(spark, tmp_path):
    from kinweave.sources.store import backup, restore, verify_backup

    w = Workspace(spark, f"file://{tmp_path}/w")
    r = records(spark, [("1", "a", "ACME"), ("2", "b", "ACME")])
    match.run(w, "r1", r, match.Policy(), publish=True)
    match.run(w, "r2", r.where("record_id = '1'"), match.Policy(), publish=True)
    assert backup(w, f"file://{tmp_path}/b")["revisions"] == ["r1", "r2"]
    again = restore(spark, f"file://{tmp_path}/b", f"file://{tmp_path}/c")
    assert again.current() == "r2" and again.table("membership", "r1").count() == 2
    spark.range(1).write.mode("overwrite").parquet(f"file://{tmp_path}/b/revisions/r1/membership")
    with pytest.raises(Exception):
        verify_backup(spark, f"file://{tmp_path}/b")


def test_learning_loop(spark):
    from kinweave.operators import learning

    rng = random.Random(7)
    rows = [(f"l{i}", f"r{i}", x := rng.random(), int(x + 0.1 * rng.random() > 0.5), ("train", "calibration", "validation", "test")[i % 4]) for i in range(400)]
    df = spark.createDataFrame(rows, "left string, right string, x double, label int, split string")
    model, threshold, test = learning.train_candidate(df, ["x"])
    assert threshold is not None and test.first().precision > 0.9 and model.platt
    grid = spark.createDataFrame([("a", 100, 0.9), ("b", 50, 0.89), ("c", 10, 0.5)], "setting string, candidates int, recall double")
    assert learning.smallest_candidate_grid(grid).first().setting == "b"
    models = spark.createDataFrame([("m1", 1, 90, 5.0, 0.8), ("m2", 2, 90, 4.0, 0.7)], "model string, declared int, positives_at_100 int, cost double, average_precision double")
    assert learning.choose_model(models).first().model == "m2"
    scored = df.select("left", "right", F.col("x").alias("score"))
    both = {r.model: r.positives for r in learning.compare_at_budget(df, scored, scored.withColumn("score", 1 - F.col("score")), 50).collect()}
    assert both["first"] == 50 and both["second"] == 0
    with pytest.raises(ValueError):
        learning.compare_at_budget(df, scored, scored.limit(3), 5)
    places = {(r.left, r.right): r.place for r in learning.ranked(scored, "score", "place").collect()}
    assert [places[r[:2]] for r in sorted(rows, key=lambda r: (-r[2], r[0], r[1]))] == list(range(1, 401))


def plain_jaro(a, b):
    """The textbook's double loop."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach, used, first = max(max(len(a), len(b)) // 2 - 1, 0), [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                first.append(c)
                break
    second = [c for c, u in zip(b, used) if u]
    if not first:
        return 0.0
    m = len(first)
    return (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(first, second)) // 2) / m) / 3


def test_jaro_against_the_double_loop():
    from kinweave.functions import similarity

    rng = random.Random(12)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abcdeé漢 ") for _ in range(rng.randint(0, 14))) for _ in "ab")
        assert similarity.jaro(a, b) == plain_jaro(a, b), (a, b)


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8])
def test_similar_pairs_are_exact(spark, least):
    """Heads of rare n-grams lose no pair: every pair by dictionaries, with names that many share and one frequent word."""
    rng = random.Random(3)
    words = ["".join(rng.choice("ABCDEFG") for _ in range(rng.randint(2, 7))) for _ in range(25)]
    names = [" ".join(["COMMON"] * (rng.random() < 0.5) + rng.sample(words, rng.randint(1, 3))) for _ in range(120)] + ["SAME NAME"] * 20
    r = spark.createDataFrame([(f"r{i:03d}", "ab"[i % 2], n, rng.choice([None, "x", "y"])) for i, n in enumerate(names)], "record_id string, source string, name string, country string")
    v = retrieval.vectors(r, retrieval.fit_vocabulary(r))
    met = "source1 < source2 and (country1 is null or country2 is null or country1 = country2)"
    got = {(x.record_id1, x.record_id2): x.similarity for x in retrieval.similar_pairs(v, r.select("record_id", "source", "country"), least, met).collect() if x.similarity >= least}
    vec = {}
    for x in v.collect():
        vec.setdefault(x.record_id, {})[x.ngram] = x.weight
    facts = {x.record_id: x for x in r.collect()}
    want = {(a, b): s for a in vec for b in vec if facts[a].source < facts[b].source and (not facts[a].country or not facts[b].country or facts[a].country == facts[b].country) and (s := sum(w * vec[b].get(g, 0) for g, w in vec[a].items())) >= least}
    near = {p for p, s in want.items() if abs(s - least) < 1e-9}
    assert set(got) - near == set(want) - near and len(want) > 80 and all(abs(got[p] - want[p]) < 1e-9 for p in set(got) & set(want))


def test_fellegi_sunter_counts_pairs_by_variants(spark):
    from kinweave.operators import scoring

    rng = random.Random(9)
    rows = [(f"r{i}", rng.choice("abc"), rng.choice(["ACME", "ACNE", "OTHER NAME", None]), rng.choice(["1", "2", None]), rng.choice(["LONG STREET", "LANG STREET", None])) for i in range(90)]
    r = spark.createDataFrame(rows, "record_id string, source string, name string, postcode string, address string")
    across = [(x, y) for i, x in enumerate(rows) for y in rows[i + 1 :] if x[1] != y[1]]
    assert scoring.random_pairs(r, 10**6).count() == len(across)
    few = scoring.random_pairs(r, 500).count()
    assert 150 < few < 700
    assert scoring.blocked_levels(r, "name").agg(F.sum("weight")).first()[0] == sum(x[2] is not None and x[2] == y[2] for x, y in across)
    model = scoring.train_fellegi_sunter(r)
    assert model.prior == 1 / max(sum(x[1] == s for x in rows) for s in "abc") and all(abs(sum(p) - 1) < 1e-6 for side in (model.m, model.u) for p in side.values())
