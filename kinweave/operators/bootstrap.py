"""Bootstrap over whole dependency groups, resampled where the groups lie.

A resample draws as many groups as there are, with repetition. Groups are numbered and cut into blocks of BLOCK; how many of a
resample's draws fall into a block follows from halving the blocks again and again, a binomial draw at each halving that is
seeded by its place. So any task can tell the weights of any block's groups by itself, all tasks agree on them, and together
they are exactly multinomial. Sums over groups (true positives, costs) are summed by block and resample; budgets are
filled from the head of the ranking, a pair counting as often as its group was drawn, for all resamples at once.

Only sums by resample, numbers of blocks and the head of the ranking reach the driver, the head in chunks until every
resample has filled its budget.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.ordering import numbered

BLOCK, CHUNK = 1024, 2048


@dataclass(frozen=True)
class Groups:
    """How large the groups of labelled pairs are."""

    groups: int
    pairs: int
    largest_fraction: float
    effective: float

    @property
    def sufficient(self) -> bool:
        """Whether there are two groups at least, none with more than half of the pairs."""
        return self.groups >= 2 and self.largest_fraction <= 0.5


def group_sizes(labelled: DataFrame, group: str) -> Groups:
    n = F.col("n").cast("double")
    sizes = labelled.groupBy(group).agg(F.count("*").alias("n"))
    r = sizes.agg(F.count("*").alias("g"), F.sum("n").alias("p"), F.max("n").alias("m"), F.sum(n * n).alias("q")).first()
    return Groups(r["g"], r["p"] or 0, (r["m"] or 0) / (r["p"] or 1), float((r["p"] or 0) ** 2 / (r["q"] or 1)))


def block_weights(block: int, groups: int, resamples: int, seed: int, size: int = BLOCK) -> np.ndarray:
    """How often each group of a block is drawn in each resample: resamples x groups of the block."""
    blocks = -(-groups // size)
    width = lambda a, b: min(b * size, groups) - a * size  # noqa: E731  groups in blocks a to b
    draws, low, high = np.full(resamples, groups, np.int64), 0, blocks
    while high - low > 1:
        middle = (low + high) // 2
        left = np.random.default_rng([seed, low, high]).binomial(draws, width(low, middle) / width(low, high))
        draws, low, high = (left, low, middle) if block < middle else (draws - left, middle, high)
    own = width(low, high)
    return np.random.default_rng([seed, low, high, 1]).multinomial(draws, np.full(own, 1 / own))


def resampled_sums(counts: DataFrame, groups: int, columns: list[str], resamples: int, seed: int) -> np.ndarray:
    """Sums of the counts (row_no of a group, columns) over each resample: resamples x columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last, weights = np.zeros((resamples, len(columns))), -1, None
        for b in batches:
            number = b.column("row_no").to_numpy()
            values = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], 1)
            for block in np.unique(number // BLOCK):
                if block != last:
                    weights, last = block_weights(int(block), groups, resamples, seed), block
                own = number // BLOCK == block
                total += weights[:, number[own] % BLOCK] @ values[own]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), *(pa.array(total[:, i]) for i in range(len(columns)))], names=["resample", *columns])

    schema = "resample long, " + ", ".join(f"{c} double" for c in columns)
    parts = counts.sortWithinPartitions("row_no").mapInArrow(run, schema)
    out = np.zeros((resamples, len(columns)))
    for r in parts.groupBy("resample").agg(*[F.sum(c).alias(c) for c in columns]).collect():
        out[r["resample"]] = [r[c] for c in columns]
    return out


def budget_positives(ranked: DataFrame, order: list[Column], budget: int, groups: int, resamples: int, seed: int) -> tuple[np.ndarray, float]:
    """Positives of a review budget in each resample, and without resampling. ``ranked`` has row_no (of the pair's group) and
    label; a pair counts as often as its group is drawn, the one at the edge in part."""
    filled, found, plain_filled, plain = np.zeros(resamples, np.int64), np.zeros(resamples), 0, 0.0
    blocks: dict[int, np.ndarray] = {}

    def take(rows: list) -> None:
        nonlocal filled, plain_filled, plain
        y = np.array([r["label"] for r in rows], float)
        w = np.empty((resamples, len(rows)), np.int64)
        for i, r in enumerate(rows):
            block = r["row_no"] // BLOCK
            if block not in blocks:
                if len(blocks) > 64:
                    blocks.clear()
                blocks[block] = block_weights(block, groups, resamples, seed)
            w[:, i] = blocks[block][:, r["row_no"] % BLOCK]
        before = filled[:, None] + np.cumsum(w, 1) - w
        found[:] += np.minimum(w, np.maximum(budget - before, 0)) @ y
        filled = filled + w.sum(1)
        plain += float(y[: max(0, budget - plain_filled)].sum())
        plain_filled += len(rows)

    held: list = []
    for r in ranked.orderBy(*order).select("row_no", "label").toLocalIterator():
        held.append(r)
        if len(held) == CHUNK:
            take(held)
            held = []
            if filled.min() >= budget and plain_filled >= budget:
                break
    if held:
        take(held)
    return found, plain


def _intervals(draws: dict[str, np.ndarray], estimates: dict[str, float], confidence: float) -> dict[str, tuple[float, float, float]]:
    """(estimate, low, high) of each metric; a metric needs 95 % of defined resamples."""
    edge = (1 - confidence) / 2
    out = {}
    for k, v in draws.items():
        v = v[~np.isnan(v)]
        if len(v) >= 0.95 * len(draws[k]) and len(v):
            out[k] = (estimates[k], *np.quantile(v, [edge, 1 - edge]).tolist())
    return out


def _divide(a: np.ndarray, b: np.ndarray, undefined: float) -> np.ndarray:
    return np.divide(a, b, out=np.full(np.shape(a), undefined, float), where=np.asarray(b) != 0)


def _sums(labelled: DataFrame, group: str, columns: dict[str, Column]) -> DataFrame:
    return labelled.groupBy(group).agg(*[F.sum(F.when(t, 1).otherwise(0)).cast("long").alias(c) for c, t in columns.items()])


def group_bootstrap(labelled: DataFrame, group: str, threshold: float, resamples: int = 1000, seed: int = 7, confidence: float = 0.95) -> tuple[Groups, dict[str, tuple[float, float, float]]]:
    """Precision, recall and F1 (estimate, low, high) of labelled pairs (score, label, group) at a threshold; none where the
    groups don't suffice."""
    sizes = group_sizes(labelled, group)
    if not sizes.sufficient:
        return sizes, {}
    hit, yes = F.col("score") >= threshold, F.col("label") == 1
    names = ["tp", "fp", "fn"]
    counts, total = numbered(_sums(labelled, group, {"tp": hit & yes, "fp": hit & ~yes, "fn": ~hit & yes}), [group])
    sums = resampled_sums(counts, total, names, resamples, seed)
    whole = counts.agg(*[F.sum(c).alias(c) for c in names]).first()

    def metrics(tp, fp, fn) -> dict[str, np.ndarray]:
        return {"precision": _divide(tp, tp + fp, np.nan), "recall": _divide(tp, tp + fn, np.nan), "f1": _divide(2 * tp, 2 * tp + fp + fn, np.nan)}

    estimates = {k: float(v) for k, v in metrics(*[np.array(float(whole[c])) for c in names]).items()}
    return sizes, _intervals(metrics(*sums.T), estimates, confidence)


def paired_bootstrap(
    labelled: DataFrame, group: str, f1_thresholds: tuple[float | None, float | None], cost_thresholds: tuple[float | None, float | None],
    budget: int = 100, fp_cost: float = 10.0, resamples: int = 1000, seed: int = 7, confidence: float = 0.95,
) -> tuple[Groups, dict[str, tuple[float, float, float]]]:
    """Second scorer minus first, (estimate, low, high) of: positives within the budget, F1 at one pair of thresholds, cost
    (fp_cost a false positive, 1 a missed pair) at another; none where the groups don't suffice.

    ``labelled`` has left, right, label, group, score_first and score_second, both known for every pair. A threshold of None
    accepts nothing. Each resample fills its budget anew, in order of score and then of the pair."""
    sizes = group_sizes(labelled, group)
    if not sizes.sufficient:
        return sizes, {}
    if labelled.where("label is null or score_first is null or score_second is null").limit(1).count():
        raise ValueError("every pair needs a label and both scores")
    yes, tests = F.col("label") == 1, {}
    for i, s in enumerate(("first", "second")):
        for policy, t in (("f1", f1_thresholds[i]), ("cost", cost_thresholds[i])):
            hit = F.col(f"score_{s}") >= t if t is not None else F.lit(False)
            tests |= {f"{policy}_{s}_tp": hit & yes, f"{policy}_{s}_fp": hit & ~yes, f"{policy}_{s}_fn": ~hit & yes}
    counts, total = numbered(_sums(labelled, group, tests), [group])
    names = list(tests)
    sums = dict(zip(names, resampled_sums(counts, total, names, resamples, seed).T, strict=True))
    whole = counts.agg(*[F.sum(c).cast("double").alias(c) for c in names]).first().asDict()

    def differences(s: dict) -> dict[str, np.ndarray]:
        f1 = lambda n: _divide(2 * s[f"f1_{n}_tp"], 2 * s[f"f1_{n}_tp"] + s[f"f1_{n}_fp"] + s[f"f1_{n}_fn"], 0.0)
        cost = lambda n: fp_cost * s[f"cost_{n}_fp"] + s[f"cost_{n}_fn"]
        return {"f1": f1("second") - f1("first"), "cost": cost("second") - cost("first")}

    draws, estimates = differences(sums), {k: float(v) for k, v in differences({k: np.array(v) for k, v in whole.items()}).items()}
    ranked = labelled.join(counts.select(F.col(group).alias("__group"), "row_no"), F.col(group).eqNullSafe(F.col("__group")))
    captured = [budget_positives(ranked, [F.desc(f"score_{s}"), F.col("left"), F.col("right")], budget, total, resamples, seed) for s in ("first", "second")]
    draws[f"positives_at_{budget}"], estimates[f"positives_at_{budget}"] = captured[1][0] - captured[0][0], captured[1][1] - captured[0][1]
    return sizes, _intervals(draws, estimates, confidence)
