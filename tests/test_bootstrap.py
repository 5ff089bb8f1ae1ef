"""Group bootstrap against a plain loop over the same draws."""

import random

import numpy as np
import pytest

from kinweave.operators import bootstrap


def labelled(groups, seed=3):
    rnd = random.Random(seed)
    rows = []
    for g in range(groups):
        for i in range(rnd.randint(1, 4)):
            y = rnd.randint(0, 1)
            rows.append((f"l{g:04}{i}", f"r{g:04}{i}", y, f"g{g:04}", round(rnd.random() * 0.6 + 0.3 * y, 2), round(rnd.random() * 0.5 + 0.4 * y, 2)))
    return rows


SCHEMA = "left string, right string, label int, g string, score_first double, score_second double"


def test_weights_are_draws_of_as_many_groups_as_there_are():
    groups, n = 2500, 400
    w = np.concatenate([bootstrap.block_weights(b, groups, n, 5) for b in range(3)], 1)
    assert w.shape == (n, groups) and (w.sum(1) == groups).all()
    assert abs(w.mean() - 1) < 1e-9 and abs(w.var() - 1) < 0.02  # close to Poisson(1)
    assert abs(np.corrcoef(w[:, 0], w[:, 2400])[0, 1]) < 0.2
    assert (bootstrap.block_weights(1, groups, n, 5) == bootstrap.block_weights(1, groups, n, 5)).all()


@pytest.mark.parametrize("chunk", [bootstrap.CHUNK, 7])
def test_paired_differences_equal_a_plain_loop(spark, monkeypatch, chunk):
    monkeypatch.setattr(bootstrap, "CHUNK", chunk)
    monkeypatch.setattr(bootstrap, "BLOCK", 64)
    rows, n, budget = labelled(150), 60, 40
    names = sorted({r[3] for r in rows})
    weights = np.concatenate([bootstrap.block_weights(b, len(names), n, 9, 64) for b in range(-(-len(names) // 64))], 1)
    monkeypatch.setattr(bootstrap, "block_weights", lambda b, g, r, s, size=64, f=bootstrap.block_weights: f(b, g, r, s, size))

    def metrics(w):
        out = {}
        for name, at in (("first", 4), ("second", 5)):
            left, found = budget, 0
            for r in sorted(rows, key=lambda r: (-r[at], r[0], r[1])):
                used = min(left, w[r[3]])
                left, found = left - used, found + used * r[2]
            tp = lambda t: sum(w[r[3]] for r in rows if r[at] >= t and r[2])
            fp = lambda t: sum(w[r[3]] for r in rows if r[at] >= t and not r[2])
            fn = lambda t: sum(w[r[3]] for r in rows if r[at] < t and r[2])
            out[name] = np.array([2 * tp(0.5) / max(1, 2 * tp(0.5) + fp(0.5) + fn(0.5)), 10 * fp(0.7) + fn(0.7), found])
        return out["second"] - out["first"]

    draws = np.array([metrics(dict(zip(names, w.tolist()))) for w in weights])
    one = metrics(dict.fromkeys(names, 1))
    sizes, got = bootstrap.paired_bootstrap(spark.createDataFrame(rows, SCHEMA).repartition(5), "g", (0.5, 0.5), (0.7, 0.7), budget, resamples=n, seed=9)
    assert sizes.sufficient and sizes.groups == 150
    for i, k in enumerate(("f1", "cost", f"positives_at_{budget}")):
        assert got[k] == pytest.approx((one[i], *np.quantile(draws[:, i], [0.025, 0.975])))


def test_one_scorer_beside_itself_has_no_difference(spark):
    rows = [(*r[:5], r[4]) for r in labelled(40)]
    _, got = bootstrap.paired_bootstrap(spark.createDataFrame(rows, SCHEMA), "g", (0.5, 0.5), (0.6, None), resamples=50)
    assert got["f1"] == (0, 0, 0) and got["positives_at_100"] == (0, 0, 0)
    assert got["cost"] != (0, 0, 0)  # None accepts nothing


def test_a_dominating_group_is_refused_and_unknown_pairs_are_an_error(spark):
    rows = labelled(3)
    big = spark.createDataFrame(rows + [(f"x{i}", "y", 1, "big", 0.5, 0.5) for i in range(50)], SCHEMA)
    sizes, got = bootstrap.paired_bootstrap(big, "g", (0.5, 0.5), (0.5, 0.5))
    assert not sizes.sufficient and sizes.largest_fraction > 0.5 and got == {}
    assert bootstrap.group_bootstrap(big.withColumnRenamed("score_first", "score").limit(0), "g", 0.5)[1] == {}
    with pytest.raises(ValueError):
        bootstrap.paired_bootstrap(spark.createDataFrame([*labelled(9), ("a", "b", None, "gg", 0.1, 0.2)], SCHEMA), "g", (0.5, 0.5), (0.5, 0.5))


def test_intervals_hold_the_estimate(spark):
    rows = [("l", "r", 1, f"g{i}", 0.9 if i % 4 else 0.1, 0.0) for i in range(40)]
    _, got = bootstrap.group_bootstrap(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("score_first", "score"), "g", 0.5, 200)
    value, low, high = got["recall"]
    assert value == 0.75 and low < 0.75 < high and got["precision"] == (1, 1, 1)
