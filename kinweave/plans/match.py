"""A matching run end to end: records to candidates, scores, resolution, identities and a prepared revision."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import blocking, graph, identity, integrity, retrieval, scoring
from kinweave.session import cut
from kinweave.sources.store import Workspace

Scorer = Callable[[DataFrame], DataFrame]
METHODS: dict[str, Scorer] = {"exact": scoring.exact_scores, "fuzzy": scoring.fuzzy_scores}
FIELDS = ["name", "address", "city", "postcode", "country"]


@dataclass(frozen=True)
class Policy:
    method: str = "exact"
    candidates: str = "fixed"  # fixed, or hybrid with names by retrieval
    threshold: float = 0.9
    review_threshold: float = 0.5
    review_only: bool = False
    most_per_bucket: int | None = None
    retrieval_k: int = 5
    retrieval_least: float = 0.5

    def __post_init__(self) -> None:
        if not 0 <= self.review_threshold <= self.threshold <= 1:
            raise ValueError("thresholds must be ordered within 0..1")
        if self.method == "exact" and self.review_threshold <= 0:
            raise ValueError("an exact match needs a threshold above 0")
        if self.candidates not in ("fixed", "hybrid"):
            raise ValueError("candidates must be fixed or hybrid")

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()

    @property
    def incremental(self) -> bool:
        """Global top-k retrieval and review-only runs are always recomputed in full."""
        return self.candidates == "fixed" and not self.review_only


def candidate_pairs(records: DataFrame, policy: Policy, vocabulary: DataFrame | None = None) -> DataFrame:
    fixed = blocking.candidates(records, policy.most_per_bucket)
    if policy.candidates == "fixed":
        return fixed
    v = retrieval.fit_vocabulary(records) if vocabulary is None else vocabulary
    found = retrieval.name_retrieval(records, v, policy.retrieval_k, policy.retrieval_least)
    return blocking.merge_candidates(fixed, found.select("left", "right", F.array(F.lit("name_retrieval")).alias("rules")))


def score_pairs(records: DataFrame, pairs: DataFrame, policy: Policy, scorer: Scorer | None = None) -> DataFrame:
    """(left, right, rules, score, auto_merge, evidence) of exactly the given pairs."""
    both = blocking.with_records(pairs, records, FIELDS)
    scored = (scorer or METHODS[policy.method])(both)
    return scored.select("left", "right", "rules", "score", F.lit(not policy.review_only).alias("auto_merge"), scoring.evidence().alias("evidence"))


def match(records: DataFrame, policy: Policy, constraints: DataFrame | None = None, previous: DataFrame | None = None, scorer: Scorer | None = None) -> dict[str, DataFrame]:
    """edges, decisions, membership (record_id, entity_id) and lineage. ``constraints`` (left, right, kind)."""
    spark = records.sparkSession
    edges = cut(score_pairs(records, candidate_pairs(records, policy), policy, scorer))
    integrity.check_edges(edges, records)
    rules = constraints if constraints is not None else spark.createDataFrame([], "left string, right string, kind string")
    of = lambda k: rules.where(F.col("kind") == k).select("left", "right")
    parts, decisions = graph.resolve(records, edges, of("must"), of("cannot"), of("suppressed"), policy.threshold, policy.review_threshold)
    old = previous if previous is not None else spark.createDataFrame([], "record_id string, entity_id string")
    membership = cut(identity.assign(cut(parts), old))
    return {"edges": edges, "decisions": decisions, "membership": membership, "lineage": identity.lineage(old, membership)}


def run(workspace: Workspace, revision: str, records: DataFrame, policy: Policy, constraints: DataFrame | None = None, publish: bool = False) -> dict:
    """A revision prepared from the records, its parent the current one; published on request."""
    parent = workspace.current()
    previous = workspace.table("membership") if parent else None
    result = match(records, policy, constraints, previous)
    manifest = workspace.prepare(revision, result | {"records": records}, parent, policy.digest())
    if publish:
        workspace.publish(revision)
    return manifest
