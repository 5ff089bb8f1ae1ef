"""Query projection: tables derived from a published revision that answer searches without its full artifact.

A revision's artifact is its tables ``memberships`` (record_id, record_version_id, entity_id), ``records``
(record_version_id, name, aliases, ...) and ``canonical`` (entity_id, canonical). Its projection is

- ``entities`` (entity_id, canonical), ``members`` (entity_id, record_id, record_version_id), ``search`` (entity_id,
  ordinal, value_folded: the distinct case-folded names and aliases of an entity, numbered in order) and ``grams`` (the
  character triples of these, by which searches find them), each partitioned by revision, so that one revision is replaced by dynamic partition overwrite and read by partition pruning;
- a completion record of version, artifact digest, content digest and counts, written last: without it there is
  no projection.

``publish`` refuses a revision whose projection is missing or differs, by rows, from what its artifact says. A revision of
before projections existed (its manifest names none) gets one when it is first asked for.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.normalize import casefold
from kinweave.operators import textsearch
from kinweave.operators.ordering import ordinals
from kinweave.sources.store import Workspace, table_digest

VERSION = "entity-query-v1"
TABLES = {"entities": ["entity_id", "canonical"], "search": ["entity_id", "ordinal", "value_folded"], "members": ["entity_id", "record_id", "record_version_id"], "grams": ["gram", "entity_id", "ordinal"]}


def search_values(memberships: DataFrame, records: DataFrame) -> DataFrame:
    """(entity_id, ordinal, value_folded) of the members' names and aliases; a missing name is an empty one."""
    named = memberships.join(records, "record_version_id")
    aliases = F.coalesce("aliases", F.array().cast("array<string>")) if "aliases" in records.columns else F.array().cast("array<string>")
    every = F.concat(F.array(F.coalesce("name", F.lit(""))), F.filter(aliases, lambda a: a.isNotNull()))
    folded = named.select("entity_id", F.explode(every).alias("v")).select("entity_id", casefold("v").alias("value_folded")).distinct()
    return ordinals(folded, ["entity_id"], ["value_folded"]).select(*TABLES["search"])


def expected_rows(artifact: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The projection's tables as the artifact's tables say them."""
    members = artifact["memberships"].select(*TABLES["members"])
    search = search_values(members, artifact["records"])
    return {"entities": artifact["canonical"].select(*TABLES["entities"]), "search": search, "members": members, "grams": textsearch.postings(search, ["entity_id", "ordinal"]).select(*TABLES["grams"])}


class Projection:
    """The projections of a workspace's revisions."""

    def __init__(self, workspace: Workspace) -> None:
        self.workspace, self.spark, self.root = workspace, workspace.spark, f"{workspace.root}/projection"

    def _artifact(self, revision: str) -> dict[str, DataFrame]:
        return {n: self.workspace.load(f"revisions/{revision}/{n}") for n in ("memberships", "records", "canonical")}

    def _manifest(self, revision: str) -> dict:
        return json.loads(self.workspace._read_text(f"revisions/{revision}/manifest.json"))

    def _artifact_digest(self, revision: str) -> str:
        return hashlib.sha256(json.dumps(self._manifest(revision)["tables"], sort_keys=True).encode()).hexdigest()

    def table(self, name: str, revision: str) -> DataFrame:
        """One revision's rows of a projected table; other partitions are not read."""
        if not self.workspace.exists(f"projection/{name}"):
            raise ValueError(f"the projection has no table {name}")
        return self.spark.read.parquet(f"{self.root}/{name}").where(F.col("revision") == revision).select(*TABLES[name])

    def write(self, revision: str) -> dict:
        """Replace this revision's derived rows, then its completion record. The artifact is only read."""
        state = f"projection/state/{revision}.json"
        if self.workspace.exists(state):
            self.workspace.fs.delete(self.workspace._path(f"{self.workspace.root}/{state}"), False)
        counts, digests = {}, {}
        for name, rows in expected_rows(self._artifact(revision)).items():
            out = textsearch.stored(rows) if name == "grams" else rows.repartition("entity_id").sortWithinPartitions(*TABLES[name][:2])
            out.withColumn("revision", F.lit(revision)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("revision").parquet(f"{self.root}/{name}")
            stored = self.table(name, revision)
            counts[name], digests[name] = stored.count(), table_digest(stored)
        content = hashlib.sha256(json.dumps(digests, sort_keys=True).encode()).hexdigest()
        record = {"revision": revision, "version": VERSION, "artifact": self._artifact_digest(revision), "content": content, "counts": counts}
        self.workspace._write_text(state, json.dumps(record, sort_keys=True))
        return record

    def state(self, revision: str) -> dict | None:
        """The completion record, if there is one; one of another version or artifact is an error."""
        if not self.workspace.exists(f"projection/state/{revision}.json"):
            return None
        record = json.loads(self.workspace._read_text(f"projection/state/{revision}.json"))
        if record["version"] != VERSION or record["artifact"] != self._artifact_digest(revision):
            raise ValueError("the projection's version or artifact is another; rebuild the projection")
        return record

    def verify(self, revision: str) -> dict:
        """Every row both ways against the artifact, and the completion record against the rows."""
        record = self.state(revision)
        if record is None:
            raise ValueError("the projection is missing")
        digests = {}
        for name, expected in expected_rows(self._artifact(revision)).items():
            stored = self.table(name, revision)
            digests[name] = table_digest(stored)
            differs = stored.exceptAll(expected).limit(1).count() or expected.exceptAll(stored).limit(1).count()
            if differs or stored.count() != record["counts"][name]:
                raise ValueError(f"the projection's {name} differ from the artifact")
        if hashlib.sha256(json.dumps(digests, sort_keys=True).encode()).hexdigest() != record["content"]:
            raise ValueError("the projection's content differs from its completion record")
        return record

    def prepare(self, revision: str, tables: dict[str, DataFrame], parent: str | None, policy: str) -> dict:
        """A revision with its projection; ``tables`` has the artifact's three and may have more."""
        manifest = self.workspace.prepare(revision, tables, parent, policy, {"query_projection": VERSION})
        self.write(revision)
        return manifest

    def publish(self, revision: str) -> None:
        """Publish a prepared revision if its projection is whole; else the current revision stays."""
        self.verify(revision)
        self.workspace.publish(revision)

    def ensure(self, revision: str) -> dict:
        """The completion record of a published revision. One of before projections existed is projected now."""
        self.workspace.published(revision)
        record = self.state(revision)
        if record is None:
            if "query_projection" in self._manifest(revision):
                raise ValueError("the projection is missing; rebuild it from the artifact")
            self.write(revision)
            record = self.verify(revision)
        return record

    def status(self, revision: str | None = None, verify: bool = False) -> dict:
        revision = revision or self.workspace.current()
        if revision is None:
            return {"revision": None, "ready": False, "status": "no_published_revision"}
        try:
            record = self.verify(revision) if verify else self.state(revision)
        except ValueError as e:
            return {"revision": revision, "ready": False, "status": str(e)}
        return {"revision": revision, "ready": record is not None, "status": "ready" if record else "missing"}

    def page(self, query: str = "", revision: str | None = None, offset: int = 0, limit: int = 50) -> tuple[int, DataFrame]:
        """How many entities have the query, case-folded, literally in a name or alias, and a page of them by entity_id."""
        revision = revision or self.workspace.current()
        self.ensure(revision)
        found = self.table("entities", revision)
        if query:
            hits = textsearch.literal(self.table("search", revision), self.table("grams", revision), ["entity_id", "ordinal"], query.casefold())
            found = found.join(hits.select("entity_id"), "entity_id", "left_semi")
        return found.count(), found.orderBy("entity_id").offset(offset).limit(limit)

    def detail(self, entity_id: str, revision: str | None = None) -> DataFrame:
        """The entity's members with the record versions that the revision froze."""
        revision = revision or self.workspace.current()
        self.ensure(revision)
        members = self.table("members", revision).where(F.col("entity_id") == entity_id)
        return members.join(self.workspace.load(f"revisions/{revision}/records"), "record_version_id").orderBy("record_id")
