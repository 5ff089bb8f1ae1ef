"""Learning from reviews: train, calibrate, freeze, then test; model choice, fixed-budget and paired comparisons."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import metrics, scoring
from kinweave.operators.ordering import numbered
from kinweave.session import cut


def train_candidate(labelled: DataFrame, features: list[str], fp_cost: float = 10.0, fn_cost: float = 1.0) -> tuple[scoring.Linear, float | None, DataFrame]:
    """(model, threshold, test metrics) of labelled pairs with features and a split: fitted on train, calibrated on
    calibration, its threshold chosen on validation; test is read last, with everything frozen."""
    part = lambda name: labelled.where(F.col("split") == name)
    model = scoring.fit_linear(part("train"), features)
    raw = part("calibration").select("label", model.probability(calibrated=False).alias("score"))
    model = replace(model, platt=scoring.fit_platt(raw))
    scored = lambda name: part(name).select(F.lit("all").alias("track"), "left", "right", "label", model.probability().alias("score"))
    chosen = metrics.best_threshold(cut(scored("validation")), ["track"], fp_cost, fn_cost).first()
    threshold = chosen["threshold"] if chosen else None
    return model, threshold, metrics.labelled_confusion(cut(scored("test")), ["track"], 2.0 if threshold is None else threshold)


def choose_model(results: DataFrame) -> DataFrame:
    """Of (model, declared, positives_at_100, cost, average_precision): most positives, then the least cost, then the
    best average precision, then the order of declaration."""
    return results.orderBy(F.desc("positives_at_100"), "cost", F.desc("average_precision"), "declared").limit(1)


def smallest_candidate_grid(grid: DataFrame, share: float = 0.95) -> DataFrame:
    """Of (setting, candidates, recall): the fewest candidates that keep ``share`` of the best recall."""
    best = grid.agg(F.max("recall").alias("best"))
    return grid.crossJoin(F.broadcast(best)).where(F.col("recall") >= share * F.col("best")).drop("best").orderBy("candidates", "setting").limit(1)  # one row


def compare_at_budget(labels: DataFrame, first: DataFrame, second: DataFrame, budget: int) -> DataFrame:
    """Positives that two scorers (left, right, score) find within one review budget; both must score the same pairs."""
    scoring.require_same_pairs(first, second)
    out = None
    for name, s in (("first", first), ("second", second)):
        joined = s.join(labels.select("left", "right", "label"), ["left", "right"], "left").select(F.lit(name).alias("model"), "left", "right", "score", "label")
        row = metrics.review_budgets(joined, ["model"], [budget])
        out = row if out is None else out.union(row)
    return out


def ranked(scored: DataFrame, score: str, name: str) -> DataFrame:
    """A rank from 1 by score, ties by pair, over all rows."""
    return numbered(scored, [F.desc(score), "left", "right"], "__place")[0].withColumn(name, F.col("__place") + 1).drop("__place")
