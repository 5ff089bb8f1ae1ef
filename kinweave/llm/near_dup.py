"""Near-duplicates by SetSketch: band register values, estimate jointly by likelihood, verify on full sets.

Every text becomes its set of distinct word shingles; equal sets are one class from then on (the copies need no
pairs). Classes that share a band of registers are candidates. Candidates become pairs in two steps, neither of
which emits the pairs of a bucket:

1. each bucket has LEADERS leaders (smallest by as many hashes). A class is compared with LOOK of its leaders by
   estimate and verified with the BEST nearest of them; the verified links are closed into components;
2. buckets whose members already are of one component have nothing left to say. Of the others, the members are
   packed (PACK to a row; those of the bucket's largest component apart from the rest), and packs meet packs, except
   those of the largest component among themselves. A task looks at the pairs of two packs across components
   by their registers and lists, for each class, the plausible ones, a pair in the first band it shares only. The
   lists are verified where the sets of the listed classes are; links alone come out.

A pair within one component changes no component, so no link that matters is lost to step 2's restriction. The
only loss is that of banding itself: a pair at exactly 0.8 shares none of 40 bands of 6 registers with a
probability under 6e-6. Estimates discard below the threshold less SLACK, more than four standard deviations.

Defined results: no words: an empty set (0 shingles), linked with nothing; fewer words than the width: the whole
sequence is the one shingle; a row with a null doc_id is linked with nothing but its exact copies and has a null kept; repeated rows are exact copies. A
very long text has its whole set. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import setsketch
from kinweave.llm.common import cut, hand_back, holding, read_table, texts
from kinweave.llm.shingles import WordHashes, shingle_set
from kinweave.operators.graph import components

SLACK = 0.12  # by which an estimate may fall short of the threshold
LEADERS, LOOK, BEST, PACK, HOME = 3, 16, 2, 256, 1024
MANY = 1000  # a class with this share of the rows is joined by broadcast
_HASHES = WordHashes()


def _forget() -> None:
    _HASHES.clear()


def _shingles(text: str, width: int) -> np.ndarray:
    return shingle_set(text, width, _HASHES)


def _set_id(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, sid (digest of the set; null if empty) and regs of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("near_dup", _forget)
        for b in batches:
            n, sid, regs = [], [], []
            for value in b.column("text"):
                s = _shingles(value.as_py(), width)
                n.append(len(s))
                sid.append(_set_id(s) if len(s) else None)
                regs.append(setsketch.registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(n, pa.int64()), pa.array(sid, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "sid", "regs"])
        hand_back()

    src = texts(docs)
    return src.select(src.doc_id.cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, n_shingles long, sid binary, regs binary")


def _banded(classes: DataFrame) -> DataFrame:
    """(bucket, band, sid) for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            keys = [xxhash.xxh3_64_intdigest(r.as_py()[k * size : (k + 1) * size], seed=k) for r in b.column("regs") for k in range(setsketch.BANDS)]
            at = pa.array(np.repeat(np.arange(b.num_rows), setsketch.BANDS))
            band = np.tile(np.arange(setsketch.BANDS, dtype=np.int32), b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(band), b.column("sid").take(at)], names=["bucket", "band", "sid"])

    size = 2 * setsketch.ROWS
    return classes.select("sid", "regs").mapInArrow(run, "bucket long, band int, sid binary")


def _estimated(pairs: DataFrame, least: float) -> DataFrame:
    """(a, b, estimate) of the pairs (a, na, ra, b, nb, rb) whose likeliest similarity is ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                ra, rb = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, setsketch.M) for c in ("ra", "rb"))
                na, nb = (part.column(c).to_numpy().astype(float) for c in ("na", "nb"))
                e = setsketch.similarity(ra, rb, na, nb)
                out = part.select(["a", "b"]).filter(pa.array(e >= least))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(e[e >= least])], names=["a", "b", "estimate"])

    return pairs.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a binary, b binary, estimate double")


def _across(packs: DataFrame, threshold: float) -> DataFrame:
    """(a, home, bs): for a class, the plausible classes of other components by home, from pairs of packs (band, p, q,
    same; p and q: lists of sid, label, n, regs, home; p is the pack of rarer components)."""
    width = 2 * setsketch.ROWS

    def lists(band: int, p: list[dict], q: list[dict], same: bool) -> Iterator[tuple[bytes, int, list[bytes]]]:
        rp, rq = (np.frombuffer(b"".join(x["regs"] for x in m), np.uint16).reshape(-1, setsketch.M) for m in (p, q))
        size_p, size_q = (np.array([x["n"] for x in m], float) for m in (p, q))
        names = {x["label"]: i for i, x in enumerate([*p, *q])}
        lp, lq = (np.array([names[x["label"]] for x in m]) for m in (p, q))
        for i in range(len(p)):
            ok = (lq != lp[i]) & (np.minimum(size_p[i], size_q) >= threshold * np.maximum(size_p[i], size_q) - 1e-9)
            if same:
                ok[: i + 1] = False
            j = np.flatnonzero(ok)
            j = j[(rq[j] == rp[i]).sum(1) >= (threshold - 2 * SLACK) * setsketch.M]  # registers agree at least as often as the similarity
            if not len(j):
                continue
            e = setsketch.similarity(np.repeat(rp[i : i + 1], len(j), 0), rq[j], np.full(len(j), size_p[i]), size_q[j])
            by_home: dict[int, list[bytes]] = {}
            for k in j[e >= threshold - SLACK]:
                x, y = p[i]["regs"], q[k]["regs"]
                if not any(x[t * width : (t + 1) * width] == y[t * width : (t + 1) * width] for t in range(band)):
                    by_home.setdefault(q[k]["home"], []).append(q[k]["sid"])
            for home, bs in by_home.items():
                yield p[i]["sid"], home, bs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x for r in range(b.num_rows) for x in lists(*(b.column(c)[r].as_py() for c in ("band", "p", "q", "same")))]
            cols = list(zip(*found)) or [(), (), ()]
            kinds = [pa.binary(), pa.int64(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["a", "home", "bs"])

    return packs.mapInArrow(run, "a binary, home long, bs array<binary>")


def _verified_at_home(wanted: DataFrame, homes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the lists (a, home, bs): each list meets the sets of its home, HOME to a group, and only what
    passes leaves the task. Homes with many lists are salted, their sets repeated for each salt."""
    salts = wanted.groupBy("home").agg(F.ceil(F.count("*") / (4 * HOME)).alias("salts"))
    mine = wanted.join(sets.select(F.col("sid").alias("a"), F.col("elements").alias("ea")), "a").join(salts, "home")
    mine = mine.select("home", F.pmod(F.xxhash64("a"), "salts").cast("long").alias("salt"), "a", "ea", "bs")
    there = homes.join(salts, "home").join(sets, "sid").select("home", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "sid", "elements")

    def verify(lists: pa.Table, own: pa.Table) -> pa.Table:
        elements = dict(zip(own.column("sid").to_pylist(), own.column("elements")))
        out = []
        for a, ea, bs in zip(lists.column("a").to_pylist(), lists.column("ea"), lists.column("bs").to_pylist()):
            p = np.frombuffer(ea.as_py(), np.uint64)
            for b in bs:
                q = np.frombuffer(elements[b].as_py(), np.uint64)
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                if 100 * both >= percent * (len(p) + len(q) - both):
                    out.append((a, b))
        cols = list(zip(*out)) or [(), ()]
        return pa.table({"a": pa.array(cols[0], pa.binary()), "b": pa.array(cols[1], pa.binary())})

    return mine.groupBy("home", "salt").cogroup(there.groupBy("home", "salt")).applyInArrow(lambda x, y: verify(x, y), "a binary, b binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa"), b.column("sb")):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(sets.select(F.col("sid").alias("a"), F.col("elements").alias("sa")), "a")
    two = one.join(sets.select(F.col("sid").alias("b"), F.col("elements").alias("sb")), "b")
    return two.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(sid, elements) of the wanted classes (sid, doc_id), from the texts of one document each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sid, elements = [], []
            for text, want in zip(b.column("text"), b.column("sid")):
                s = _shingles(text.as_py(), width)
                if _set_id(s) == want.as_py():  # a doc_id may stand for several texts
                    sid.append(want.as_py())
                    elements.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sid, pa.binary()), pa.array(elements, pa.binary())], names=["sid", "elements"])
        hand_back()

    src = texts(docs)
    joined = src.select(src.doc_id.cast("long").alias("doc_id"), "text").join(wanted.select("doc_id", "sid"), "doc_id")
    return joined.select("text", "sid").mapInArrow(run, "sid binary, elements binary").dropDuplicates(["sid"])


def link(docs: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with sid, classes with n, copies and the smallest doc_id, verified links between classes as (a, b)).

    Links suffice for the components; they are not all pairs of a group.
    """
    threshold, spark = percent / 100, docs.sparkSession
    rows = cut(sketch(docs, width))
    classes = rows.where("sid is not null and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"), F.count("*").alias("copies"))
    classes = cut(classes)
    entries = _banded(classes)
    leaders = entries.groupBy("bucket").agg(F.count("*").alias("size"), *[F.min(F.struct(F.xxhash64("sid", F.lit(k)), F.col("sid"))).alias(f"l{k}") for k in range(LEADERS)]).where("size > 1")
    shared = cut(entries.join(leaders, "bucket").select("bucket", "band", "sid", *[F.col(f"l{k}.sid").alias(f"l{k}") for k in range(LEADERS)]))
    # step 1: the nearest leaders
    chosen = shared.groupBy("sid").agg(*[F.collect_set(f"l{k}").alias(f"l{k}") for k in range(LEADERS)])
    chosen = chosen.select(F.col("sid").alias("a"), F.explode(F.slice(F.array_sort(F.transform(F.array_remove(F.array_distinct(F.concat(*[f"l{k}" for k in range(LEADERS)])), F.col("sid")), lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("sid")))), 1, LOOK)).alias("l")).select("a", F.col("l.sid").alias("b"))
    facts = lambda side: classes.select(F.col("sid").alias(side), F.col("n").alias("n" + side), F.col("regs").alias("r" + side))
    sized = chosen.join(facts("a"), "a").join(facts("b"), "b").where(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)
    nearest = _estimated(sized, threshold - SLACK).groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("estimate", "b")), asc=False), 1, BEST).alias("best"))
    stars = cut(nearest.select("a", F.explode("best.b").alias("b")), narrow=2)
    involved = shared.select("sid").distinct()
    sets = cut(_sets(docs, classes.join(involved, "sid", "left_semi").select("sid", "doc_id"), width))
    links = cut(_verified(stars, sets, percent), narrow=16)
    # step 2: across the components found so far
    label = components(links, "a", "b")
    placed = shared.select("bucket", "band", "sid").join(label.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    counts = placed.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    live = counts.groupBy("bucket").agg(F.sum("n").alias("size"), F.count("*").alias("labels"), F.max(F.struct("n", "label"))["label"].alias("largest")).where("labels > 1").drop("labels")
    members = cut(placed.join(live, "bucket").withColumn("rest", (F.col("label") != F.col("largest")).cast("int")))
    involved = members.select("sid", "label").distinct()
    groups = max(1, sets.count() // HOME)  # classes of a component live together, in parts
    crowds = involved.groupBy("label").agg(F.ceil(F.count("*") / PACK).alias("parts"))
    homes = cut(involved.join(crowds, "label").select("sid", F.pmod(F.xxhash64("label", F.pmod(F.xxhash64("sid"), "parts")), F.lit(groups)).cast("long").alias("home")), narrow=2)
    packed = members.withColumn("pack", F.pmod(F.xxhash64("sid"), F.ceil(F.col("size") / PACK)).cast("int") * 2 + F.col("rest")).join(homes.join(classes.select("sid", "n", "regs"), "sid"), "sid")
    packs = packed.groupBy("bucket", "band", "pack").agg(F.collect_list(F.struct("sid", "label", "n", "regs", "home")).alias("m"))
    side = lambda s, p: packs.select("bucket", "band", F.col("pack").alias("pack" + s), F.col("m").alias(p))
    met = side("a", "p").join(side("b", "q"), ["bucket", "band"]).where("packa % 2 = 1 and (packb % 2 = 0 or packa <= packb)")
    wanted = cut(_across(met.select("band", "p", "q", (F.col("packa") == F.col("packb")).alias("same")), threshold), narrow=16)
    links = links.union(cut(_verified_at_home(wanted, homes, sets, percent), narrow=16))
    return rows, classes, links


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    return _grouped(docs, width, percent).drop("text_hash", "sid")


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """What ``near_duplicates`` gives, and text_hash and sid.

    Rows without words need no class. Classes that hold a MANYth of all rows or more (so at most MANY of them) are
    broadcast; the rows of the others are dealt by class, and none of these is large against a task's share."""
    rows, classes, links = link(docs, width, percent)
    label = components(links, "a", "b")
    least = label.join(classes.select(F.col("sid").alias("node"), "doc_id"), "node")
    lowest = least.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    grouped = label.join(lowest, "label").select(F.col("node").alias("sid"), "component_id")
    total = classes.agg(F.sum("copies").alias("total"))  # one row
    known = classes.select("sid", F.col("doc_id").alias("own"), "copies").join(grouped, "sid", "left").crossJoin(F.broadcast(total))
    known = cut(known.select("sid", F.coalesce("component_id", "own").alias("component_id"), (F.col("copies") * MANY >= F.col("total")).alias("large")), narrow=2)
    large = F.broadcast(known.where("large").drop("large"))
    every = rows.select("doc_id", "text_hash", "n_shingles", "sid")
    alone = every.where("sid is null").withColumn("component_id", F.col("doc_id"))
    of_large = every.where("sid is not null").join(large, "sid").select(*alone.columns)
    of_small = every.where("sid is not null").join(F.broadcast(known.where("large").select("sid")), "sid", "left_anti").join(known.where("not large").drop("large"), "sid", "left").select(*every.columns, F.coalesce("component_id", "doc_id").alias("component_id"))
    out = alone.unionByName(of_large).unionByName(of_small)
    return out.select("doc_id", "text_hash", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "sid")


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, of which one of each group stays.

    A group is a component or, where no row of equal sets has a doc_id, these rows. The one that stays has the smallest
    doc_id and, among texts that share it, the smallest hash. Another text of the same doc_id is judged on its own. Rows
    equal in doc_id (null as well) and text are one. Rows without words are in no group.
    """
    grouped = cut(_grouped(docs, width, percent).select("doc_id", "text_hash", "component_id", "sid", "kept"), narrow=16)
    key = [F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")]
    later = grouped.where("component_id is not null and not (kept <=> true)").select(*key)
    # several texts of one set under the smallest doc_id, or of one set without a doc_id: few, and all but one go
    firsts = grouped.where("sid is not null and kept").groupBy("component_id").agg(F.min("text_hash").alias("first"), F.max("text_hash").alias("last")).where("first < last")
    tied = grouped.where("kept").join(firsts, "component_id").where("text_hash <> first").select(*key)
    nameless = grouped.where("sid is not null and component_id is null")
    firsts = nameless.groupBy("sid").agg(F.min("text_hash").alias("first"), F.max("text_hash").alias("last")).where("first < last")
    unnamed = nameless.join(firsts, "sid").where("text_hash <> first").select(*key)
    gone = cut(later.union(tied).union(unnamed).distinct(), narrow=2)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__hash"))
    kept = docs.join(gone, same, "left_anti")
    again = cut(grouped.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").join(gone.select(F.col("__id").alias("i"), F.col("__hash").alias("h")), F.col("__id").eqNullSafe(F.col("i")) & (F.col("__hash") == F.col("h")), "left_anti").drop("n"), narrow=2)
    if not again.limit(1).count():
        return kept
    one = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, same, "left_anti").union(one)


def op8_setsketch_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), width=4)


OP8_SQL = """with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') words from documents),
 s as (select distinct doc_id, hash(case when len(words) < 4 then words else words[i : i + 3] end) h from w, lateral (select unnest(generate_series(1, greatest(len(words) - 3, 1))) i) where len(words) > 0),
 n as (select doc_id, count(*) n from s group by 1),
 met as (select a.doc_id a, b.doc_id b, count(*) k from s a join s b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
 link as (select a, b from met join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
 edge as (select a u, b v from link union select b, a from link),
 reach(node, seen) as (select doc_id, doc_id from documents union select reach.node, edge.v from reach join edge on edge.u = reach.seen),
 comp as (select node doc_id, min(seen) component_id from reach group by 1)
 select doc_id, coalesce(n.n, 0) n_shingles, component_id, doc_id = component_id kept from documents left join n using (doc_id) join comp using (doc_id)"""
