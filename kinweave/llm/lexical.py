"""Ranked lexical search: document-sharded CSR postings with integer impacts, searched a term at a time.

The index is a table with a row a shard of documents (``SHARD``). A shard holds about TOKENS terms of whole documents,
sorted by doc_id: its vocabulary, and in compressed sparse rows for each term the documents that hold it and their
integer impacts. An impact has all of the score but the term's weight, which is one factor a term and is applied
when its postings are added up; so impacts need only N and L, and an index can be read for any queries.

1. one pass counts N (documents with a term) and L (their terms);
2. one pass writes the shards;
3. the document frequencies of the queries' terms are summed from the shards' pointers (no posting is read);
4. each task goes over its shards: for a query, each of its terms adds weight times impact to one number a document
   (numpy), the k best are picked by argpartition, ties by the smallest doc_id, and merged with those of its shards before;
5. the tasks' best of an item are merged, in two levels where tasks are many.

No text or posting is shuffled, only k rows an item and task. Queries go to the tasks in groups of at most GROUP bytes of
text, each group in one pass over the index; the sizes of groups do not change results.

Defined results: a null or empty text has no terms: such a document is never found and not counted in N, such an item
has no result. Equal scores: ascending doc_id, a null doc_id last. Documents that repeat a doc_id are ranked each by itself.
Equal items (item_id and text) are one; an item_id with several texts has a ranking for each text, one behind another.
A very long text is one document of one shard, its terms made in parts. Empty tables give an empty result. Extra columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.llm.common import Scratch, cut, hand_back, holding, read_table, scan_partitions, texts

K, B_WEIGHT = 10, 75  # results an item; percent of a document's length in its norm
TOKENS, PIECE, GROUP = 1 << 21, 1 << 20, 8 << 20
SHARD = "n_docs int, n_null int, doc_ids binary, vocabulary binary, starts binary, rows binary, impacts binary"
# Bytes of UTF-8 as terms need them: A-Z lower-cased, all other ASCII but letters and digits a space, the rest as it is.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_LAST = np.iinfo(np.int64).max


def term_lists(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in lists from about PIECE bytes each."""
    b = text.encode().translate(_TERM)
    at = 0
    while at < len(b):
        end = b.find(b" ", at + PIECE) if len(b) - at > PIECE else -1
        end = len(b) if end < 0 else end
        yield b[at:end].split()
        at = end


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """N and L: documents with at least one term, and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in batches:
            for x in b.column("text"):
                k = sum(len(t) for t in term_lists(x.as_py()))
                n, total = n + (k > 0), total + k
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["n", "total"])

    r = texts(docs).select("text").mapInArrow(run, "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    return r["n"] or 0, r["total"] or 0


class _Shard:
    """Documents gathered for one shard."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.terms: dict[bytes, int] = {}
        self.tokens: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, text: str) -> None:
        number = self.terms
        parts = [np.fromiter((number.setdefault(t, len(number)) for t in ts), np.int32, len(ts)) for ts in term_lists(text)]
        size = sum(map(len, parts))
        if size:
            self.ids.append(doc_id)
            self.sizes.append(size)
            self.tokens += parts
            self.held += size

    def row(self, n: int, total: int) -> dict[str, object]:
        key = np.array([_LAST if i is None else i for i in self.ids], np.int64)
        null = np.array([i is None for i in self.ids])
        sizes = np.array(self.sizes, np.int64)
        order = np.lexsort((null, key))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        vocabulary = sorted(self.terms)
        renumber = np.empty(len(vocabulary), np.int64)
        renumber[[self.terms[t] for t in vocabulary]] = np.arange(len(vocabulary))
        posting, tf = np.unique(renumber[np.concatenate(self.tokens)] * len(order) + np.repeat(place, sizes), return_counts=True)
        term, row = posting // len(order), posting % len(order)
        norm = 100 - B_WEIGHT + (B_WEIGHT * sizes[order] * n) // total
        impact = (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf + 8 * norm[row])
        starts = np.searchsorted(term, np.arange(len(vocabulary) + 1))
        return {
            "n_docs": len(order), "n_null": int(null.sum()), "doc_ids": key[order].tobytes(), "vocabulary": zstandard.ZstdCompressor(3).compress(b" ".join(vocabulary)),
            "starts": starts.astype(np.int64).tobytes(), "rows": row.astype(np.uint32).tobytes(), "impacts": impact.astype(np.uint32).tobytes(),
        }


_SHARD_ARROW = pa.schema([("n_docs", pa.int32()), ("n_null", pa.int32()), *((c, pa.binary()) for c in ("doc_ids", "vocabulary", "starts", "rows", "impacts"))])


def index(docs: DataFrame, tokens: int = TOKENS) -> DataFrame:
    """The shards of all ``docs`` (doc_id, text), one row each; to be written before it is searched more than once."""
    n, total = corpus_size(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("lexical")
        shard = _Shard()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                shard.add(doc_id, text.as_py())
                if shard.held >= tokens:
                    yield pa.RecordBatch.from_pylist([shard.row(n, total)], _SHARD_ARROW)
                    shard = _Shard()
        if shard.held:
            yield pa.RecordBatch.from_pylist([shard.row(n, total)], _SHARD_ARROW)
        hand_back()

    return texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SHARD)


def _known(vocabulary: bytes, wanted: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """Numbers in ``wanted`` and places in the shard of the terms that both have."""
    here = zstandard.ZstdDecompressor().decompress(vocabulary).split(b" ")
    if len(wanted) < len(here) // 8:
        place = {t: i for i, t in enumerate(here)}
        both = [(k, place[t]) for t, k in wanted.items() if t in place]
    else:
        both = [(wanted[t], i) for i, t in enumerate(here) if t in wanted]
    return [k for k, _ in both], [i for _, i in both]


def document_frequencies(shards: DataFrame, wanted: dict[bytes, int]) -> np.ndarray:
    """How many documents hold each wanted term; reads vocabularies and pointers only."""
    sent = shards.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(sent.value), np.int64)
        for b in batches:
            for vocabulary, starts in zip(b.column("vocabulary"), b.column("starts"), strict=True):
                numbers, places = _known(vocabulary.as_py(), sent.value)
                df[numbers] += np.diff(np.frombuffer(starts.as_py(), np.int64))[places]
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], names=["term", "df"])

    out = np.zeros(len(wanted), np.int64)
    for r in shards.select("vocabulary", "starts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def best_of(score: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k highest scores above 0; of equal ones at the edge, the first rows."""
    if len(score) > k:
        edge = score[np.argpartition(score, len(score) - k)[len(score) - k :]].min()
        if edge > 0:
            above = np.flatnonzero(score > edge)
            return np.concatenate([above, np.flatnonzero(score == edge)[: k - len(above)]])
    return np.flatnonzero(score > 0)


def _merged(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    score, key, null = (np.concatenate(x) for x in zip(*found, strict=True))
    first = np.lexsort((null, key, -score))[:k]
    return score[first], key[first], null[first]


def _search_shard(shard: dict, wanted: dict[bytes, int], queries: list[tuple[list[int], np.ndarray]], k: int) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    ids, starts = np.frombuffer(shard["doc_ids"], np.int64), np.frombuffer(shard["starts"], np.int64)
    rows, impacts = np.frombuffer(shard["rows"], np.uint32), np.frombuffer(shard["impacts"], np.uint32).astype(np.int64)
    null = np.arange(len(ids)) >= len(ids) - shard["n_null"]
    place = np.full(len(wanted), -1, np.int64)
    numbers, places = _known(shard["vocabulary"], wanted)
    place[numbers] = places
    for q, (terms, factors) in enumerate(queries):
        score = np.zeros(len(ids), np.int64)
        for p, factor in zip(place[terms], factors, strict=True):
            if p >= 0:
                at = slice(starts[p], starts[p + 1])
                score[rows[at]] += factor * impacts[at]
        if len(best := best_of(score, k)):
            yield q, (score[best], ids[best], null[best])


def search(shards: DataFrame, n: int, items: list[str], k: int = K) -> DataFrame:
    """(item, rank, doc_id, score): the k best documents for each text in ``items`` (their places in the list), which
    hold a bounded number of bytes. ``n`` is the N that the index was made with."""
    spark = shards.sparkSession
    counts: list[dict[bytes, int]] = []
    for text in items:
        own: dict[bytes, int] = {}
        for ts in term_lists(text):
            for t in ts:
                own[t] = own.get(t, 0) + 1
        counts.append(own)
    wanted = {t: i for i, t in enumerate(sorted({t for own in counts for t in own}))}
    df = document_frequencies(shards, wanted)
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    queries = [([wanted[t] for t in own], np.array([c * weight[wanted[t]] for t, c in own.items()], np.int64)) for own in counts]
    sent = spark.sparkContext.broadcast((wanted, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("lexical")
        wanted, queries = sent.value
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for b in batches:
            for shard in b.to_pylist():
                for q, found in _search_shard(shard, wanted, queries, k):
                    best[q] = _merged([best[q], found], k) if q in best else _merged([found], k)
        for q, (score, key, null) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), q, np.int32)), pa.array(key, mask=null), pa.array(score)], names=["item", "doc_id", "score"])
        hand_back()

    found = cut(shards.mapInArrow(run, "item int, doc_id long, score long"), narrow=2)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rank = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(*order))
    parts = math.isqrt(scan_partitions(shards))
    if parts > 4:  # many tasks: their results of an item meet in parts first
        found = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(parts)))
        found = found.withColumn("rank", rank("item", "part")).where(F.col("rank") <= k).drop("part")
    return found.withColumn("rank", rank("item")).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K, group: int = GROUP) -> DataFrame:
    """item_id, rank, doc_id, score of the k best ``docs`` for each of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    with Scratch(spark) as scratch:
        n, _ = corpus_size(docs)
        shards = scratch.keep(index(docs))
        out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")

        def answer(ids: list, held: list[str]) -> DataFrame:
            names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {kind}")
            return cut(search(shards, n, held, k).join(names, "item").select("item_id", "rank", "doc_id", "score"), narrow=2)

        ids, held, size = [], [], 0
        for r in texts(items, "item_id").distinct().toLocalIterator():
            ids.append(r["item_id"])
            held.append(r["text"])
            size += len(r["text"])
            if size >= group:
                out, ids, held, size = out.unionByName(answer(ids, held)), [], [], 0
        return out.unionByName(answer(ids, held)) if ids else out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_SPLIT = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""with doc as (select row_number() over () r, doc_id, {_SPLIT} t from documents where text is not null),
 size as (select r, doc_id, len(t) n from doc where len(t) > 0),
 corpus as (select count(*) n_docs, cast(sum(n) as bigint) n_terms from size),
 asked as (select item_id, term, count(*) times from (select item_id, unnest({_SPLIT}) term from (select distinct item_id, text from benchmark) where text is not null) group by 1, 2),
 tf as (select r, term, count(*) tf from (select r, unnest(t) term from doc) where term in (select term from asked) group by 1, 2),
 weight as (select term, cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double)) as bigint) w from tf, corpus group by term, n_docs),
 impact as (select r, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)) q from tf join size using (r), corpus),
 scored as (select item_id, r, doc_id, cast(sum(times * w * q) as bigint) score from asked join weight using (term) join impact using (term) group by all),
 ranked as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) "rank", doc_id, score from scored where score > 0)
 select item_id, "rank", doc_id, score from ranked where "rank" <= 10"""
