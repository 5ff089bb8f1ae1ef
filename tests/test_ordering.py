"""Prefix scans and selection by rank against plain loops, with hot keys, nulls and ties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators import ordering


def test_running_sums_of_a_hot_key_spread_over_many_tasks(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot"] * 6 + [None, "b", "c"]), i, rnd.choice([None, 1, 2, 5])) for i in range(3000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, seq long, v long").repartition(7)
    got = ordering.running_sums(df, ["k"], ["seq"], {"total": F.col("v"), "n": F.lit(1).cast("long")}).collect()
    want, total, n = {}, {}, {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        total[k], n[k] = total.get(k, 0) + (v or 0), n.get(k, 0) + 1
        want[i] = (k, total[k], n[k])
    assert {r["seq"]: (r["k"], r["total"], r["n"]) for r in got} == want
    placed = ordering.ordinals(df, ["k"], ["seq"]).where("k = 'hot'").select("ordinal").collect()
    assert sorted(r[0] for r in placed) == list(range(len(placed)))


def test_equal_rows_are_numbered_without_gaps_and_empty_tables_stay_empty(spark):
    df = spark.createDataFrame([("a", 1)] * 50 + [("b", 1)] * 3, "k string, v long")
    got = ordering.ordinals(df, ["k"], ["v"]).collect()
    assert sorted((r["k"], r["ordinal"]) for r in got) == sorted([("a", i) for i in range(50)] + [("b", i) for i in range(3)])
    assert ordering.ordinals(df.limit(0), ["k"], ["v"]).count() == 0
    assert ordering.exact_quantiles(df.limit(0), ["k"], "v", {"p": 0.5}).count() == 0


def test_quantiles_by_rank(spark):
    rnd = random.Random(2)
    rows = [(k, float(rnd.randint(0, 40))) for k in ["x"] * 997 + ["y"] * 4 + ["z"]] + [("z", None), ("none", None)]
    got = {r["k"]: r for r in ordering.exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p25": 0.25, "p95": 0.95}, {"disc": 0.95, "least": 0.0}).collect()}
    assert set(got) == {"x", "y", "z"}
    for k, r in got.items():
        own = np.array([v for key, v in rows if key == k and v is not None])
        assert r["p25"] == pytest.approx(np.quantile(own, 0.25)) and r["p95"] == pytest.approx(np.quantile(own, 0.95))
        assert r["disc"] == np.quantile(own, 0.95, method="inverted_cdf") and r["least"] == own.min()
