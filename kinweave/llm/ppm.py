"""Language-model scores by prediction by partial matching (PPM) over bytes.

A text is its words (white space tells them apart, A-Z lower-cased), joined by a space and ended by a newline; no word holds
either, so words and bytes tell the same. Contexts are the ORDER bytes before a byte, newlines before the first. A context that
training has seen predicts each of its bytes by (count - 1/2) over the count of all, and escapes with the rest (method D: half
the number of different bytes over the count of all) to the context one byte shorter, where the bytes that the longer one
knows are excluded; behind the empty context all ALPHABET bytes not excluded are equally likely. A context not seen at
all passes on without a cost. The longest contexts count bytes as often as they come, shorter ones where the byte was new in
the longer one (update exclusion), so a count there is the number of longer contexts that have the byte.

The trie of contexts is a table a level: a node's byte, its count, and the sums of its context. What excluding takes from
a level depends on the context one byte longer alone, so levels are built one from another, from the empty context
upwards, by joins whose keys have at most ALPHABET rows each: no key is hot, whatever the corpus, and no level is
collected or broadcast.

1. tasks pack documents into blocks of about BLOCK bytes, and list each block's distinct (context, byte) and words with
   their counts in training documents;
2. counts are summed over blocks; the levels give each listed (context, byte) its log-probability, each word that several
   blocks list its count (a word of one block alone has its count there);
3. the answers go back to their blocks, where whole texts are scored.

``adaptive_bits`` is the other use: a document's own code length by a model that learns as it reads and starts from nothing.

Defined results: a null or empty text is the end alone (one token); a null doc_id is hashed as the empty string; documents
that repeat are scored and learned from as often as they stand. A very long text is a block of its own, read in parts. Without
training documents all bytes are equally likely and every word is unknown. An empty table gives an empty result. Extra
columns are not read. Words over LONG bytes are told apart by a 128-bit digest.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Collection, Iterable, Iterator
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.llm.common import Scratch, cut, hand_back, holding, read_table, texts

ORDER = 5
END = b"\n"
ALPHABET = 256 - 4  # bytes that a text as above can hold: not the tab, 0x0B, 0x0C, 0x0D
BLOCK, CHUNK, LONG = 32 << 20, 1 << 20, 48
FOLDS, HELD_OUT = 7, 2
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLOCKS = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("text", pa.binary()), ("grams", pa.binary()), ("gram_counts", pa.binary()), ("words", pa.binary()), ("word_counts", pa.binary())])
BLOCKS = "block long, doc_ids array<long>, held_out array<boolean>, sizes array<long>, text binary, grams binary, gram_counts binary, words binary, word_counts binary"


def held_out(doc_id: int | None) -> bool:
    return crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


def canonical(text: str) -> bytes:
    """The words of a text as bytes, a space between them, and the end."""
    return b" ".join(text.encode().translate(_LOWER).split()) + END


def grams(b: bytes, before: bytes = END * ORDER, order: int = ORDER) -> np.ndarray:
    """Of each byte, the ``order`` bytes before it and itself as one number; ``before``: what stands before the first."""
    a = np.frombuffer(before + b, np.uint8).astype(np.uint64)
    out = a[order:].copy()
    for k in range(1, order + 1):
        out |= a[order - k : len(a) - k] << np.uint64(8 * k)
    return out


def chunks(b: bytes) -> Iterator[np.ndarray]:
    """The grams of one document, about CHUNK at a time."""
    for at in range(0, len(b), CHUNK):
        yield grams(b[at : at + CHUNK], (END * ORDER + b[max(0, at - ORDER) : at])[-ORDER:])


def word_key(word: bytes) -> bytes:
    return word if len(word) <= LONG else END + blake2b(word, digest_size=16).hexdigest().encode()


def joined_grams(texts: list[bytes], order: int = ORDER) -> np.ndarray:
    """The grams of documents, one behind another."""
    sizes = np.array([len(t) for t in texts])
    g = grams((END * order).join(texts), order=order)
    keep = np.ones(len(g), bool)
    behind = np.cumsum(sizes + order)[:-1] - order  # where the newlines before the next document are
    keep[(behind[:, None] + np.arange(order)).ravel()] = False
    return g[keep]


def words_of(text: bytes) -> list[bytes]:
    """The words of documents one behind another, as they are counted; their ends are left out."""
    found = text.split()
    return [word_key(w) for w in found] if max(map(len, found), default=0) > LONG else found


def _counted(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)


def _together(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Runs of documents that are worked on at once, about CHUNK; a longer one is alone."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > CHUNK:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


class _Block:
    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.held: list[bool] = []
        self.texts: list[bytes] = []
        self.size = 0
        self.words: Counter[bytes] = Counter()
        self.asked: set[bytes] = set()
        self.merged: list[tuple[np.ndarray, np.ndarray]] = []
        self.loose: tuple[list[bytes], list[bytes]] = ([], [])  # not held out, held out
        self.loose_size = 0

    def add(self, doc_id: int | None, text: str) -> None:
        b, out = canonical(text), held_out(doc_id)
        self.ids.append(doc_id)
        self.held.append(out)
        self.texts.append(b)
        self.size += len(b)
        self.loose[out].append(b)
        self.loose_size += len(b)
        if self.loose_size >= CHUNK:
            self._merge()

    def _merge(self) -> None:
        for out, texts in enumerate(self.loose):
            for part in _together(texts):
                for g in [joined_grams(part)] if len(part) > 1 else chunks(part[0]):
                    keys, n = np.unique(g, return_counts=True)
                    self.merged.append((keys, n * (not out)))
                words = words_of(b"".join(part))
                if out:
                    self.asked.update({END, *words}.difference(self.words))
                else:
                    self.words.update(words)
                    self.words[END] += len(part)
        self.loose, self.loose_size = ([], []), 0
        if len(self.merged) > 8:
            self.merged = [_counted(self.merged)]

    def row(self, block: int) -> dict[str, object]:
        self._merge()
        keys, n = _counted(self.merged)
        words, pack = sorted(self.asked.union(self.words)), zstandard.ZstdCompressor(3).compress
        return {
            "block": block, "doc_ids": self.ids, "held_out": self.held, "sizes": [len(t) for t in self.texts], "text": pack(b"".join(self.texts)), "grams": pack(np.diff(keys, prepend=np.uint64(0)).tobytes()), "gram_counts": pack(n.tobytes()),
            "words": pack(b" ".join(words)), "word_counts": pack(np.array([self.words[w] for w in words], np.int64).tobytes()),
        }


def blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """``docs`` packed into rows of about ``size`` bytes of text each; to be written before it is read more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        holding("ppm")
        number, block = TaskContext.get().partitionId() << 32, _Block()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                block.add(doc_id, text.as_py())
                if block.size >= size:
                    yield pa.RecordBatch.from_pylist([block.row(number)], _BLOCKS)
                    number, block = number + 1, _Block()
        if block.ids:
            yield pa.RecordBatch.from_pylist([block.row(number)], _BLOCKS)
        hand_back()

    return texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCKS)


def _unpack(value: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(value), kind)


_STEP = 1 << 18


def listed_grams(packed: DataFrame) -> DataFrame:
    """(block, gram, n): each block's distinct grams with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, g, n in zip(*(b.column(c).to_pylist() for c in ("block", "grams", "gram_counts")), strict=True):
                g, n = np.cumsum(_unpack(g, np.uint64), dtype=np.uint64).view(np.int64), _unpack(n, np.int64)
                for at in range(0, len(g), _STEP):
                    part = slice(at, at + _STEP)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g[part]), block)), pa.array(g[part]), pa.array(n[part])], names=["block", "gram", "n"])

    return packed.select("block", "grams", "gram_counts").mapInArrow(run, "block long, gram long, n long")


def listed_words(packed: DataFrame) -> DataFrame:
    """(block, place, word, n): each block's distinct words in their order, with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, words, n in zip(*(b.column(c).to_pylist() for c in ("block", "words", "word_counts")), strict=True):
                words, n = zstandard.ZstdDecompressor().decompress(words).split(b" "), _unpack(n, np.int64)
                for at in range(0, len(words), _STEP):
                    part = words[at : at + _STEP]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(np.arange(at, at + len(part))), pa.array(part, pa.binary()), pa.array(n[at : at + _STEP])], names=["block", "place", "word", "n"])

    return packed.select("block", "words", "word_counts").mapInArrow(run, "block long, place long, word binary, n long")


def log_probabilities(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, logp), natural logarithms, of all rows of ``counts`` (gram, n; distinct grams); n = 0: asked for only."""
    levels = {order: counts.select("gram", "n")}
    for k in range(order - 1, -1, -1):
        mask = F.lit((1 << (8 * (k + 1))) - 1)
        levels[k] = cut(levels[k + 1].groupBy(F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.sum((F.col("n") > 0).cast("long")).alias("n")), narrow=16)
    # What a level hands up: of each gram its count, the sums of its context, its log-probability with the context's bytes
    # all possible (whole), and where the context doesn't know it, behind the escape (behind).
    known = F.when(F.col("n") > 0, F.lit(1)).otherwise(0)
    below = None
    for k in range(order + 1):
        rows = levels[k]
        if below is None:
            rows = rows.withColumn("of", F.lit(0)).withColumns({c: F.lit(0).cast("long") for c in ("n1", "total1", "kinds1")}).withColumns({c: F.lit(0.0) for c in ("whole1", "behind1")})
        else:
            rows = rows.withColumn("below", F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1))).join(below, "below").withColumn("of", F.shiftrightunsigned("gram", 8))
        context = W.partitionBy("of")
        rows = rows.withColumns({"total": F.sum("n").over(context), "kinds": F.sum(known).over(context), "excluded": F.sum(F.when(F.col("n") > 0, F.col("n1")).otherwise(0)).over(context)})
        seen, total, kinds = F.col("n") > 0, F.col("total"), F.col("kinds")
        if below is None:  # behind the empty context
            behind = -F.log(F.lit(ALPHABET) - kinds)
        else:
            left, left_kinds = F.col("total1") - F.col("excluded"), F.col("kinds1") - kinds
            behind = F.when(F.col("n1") > 0, F.log((F.col("n1") - 0.5) / left)).otherwise(F.when(left_kinds > 0, F.log(0.5 * left_kinds / left)).otherwise(0.0) + F.col("behind1"))
        behind = F.when(~seen, behind)
        whole = F.when(seen, F.log((F.col("n") - 0.5) / total)).when(total > 0, F.log(0.5 * kinds / total) + F.col("behind"))
        whole = whole.otherwise(F.col("whole1") if below is not None else F.lit(-math.log(ALPHABET)))
        rows = rows.withColumn("behind", behind).withColumn("whole", whole)
        if k < order:
            below = cut(rows.select(F.col("gram").alias("below"), F.col("n").alias("n1"), F.col("total").alias("total1"), F.col("kinds").alias("kinds1"), F.col("whole").alias("whole1"), F.col("behind").alias("behind1")), narrow=16)
    return rows.select("gram", F.col("whole").alias("logp"))


class Slots:
    """Places of distinct 64-bit keys: a table of two to four slots a key, where a key stands at its hash or soon behind."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.shift, self.mask = keys, np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            on = self.slots[at] != left
            left, at = left[on], (at[on] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The places of keys that are all in the table."""
        at = self._home(keys)
        out = self.slots[at]
        left = np.flatnonzero(self.keys[out] != keys)
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            out[left] = self.slots[at]
            on = self.keys[out[left]] != keys[left]
            left, at = left[on], at[on]
        return out


class Lookup:
    """Numbers of distinct words by 64-bit hashes, in far less memory than a dictionary; a dictionary where two words share one."""

    def __init__(self, words: list[bytes], numbers: np.ndarray) -> None:
        hashes = np.fromiter(map(hash, words), np.int64, len(words))
        if (np.diff(np.sort(hashes)) == 0).any():
            self.exact = dict(zip(words, numbers.tolist(), strict=True))
        else:
            self.exact, self.slots, self.numbers = None, Slots(hashes), numbers

    def __call__(self, words: Collection[bytes]) -> np.ndarray:
        """The numbers of words that are all known."""
        if self.exact is not None:
            return np.array([self.exact[w] for w in words], np.int64)
        return self.numbers[self.slots(np.fromiter(map(hash, words), np.int64, len(words)))]


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score_block(packed: pa.Table, answers: pa.Table, train_tokens: int, train_words: int) -> pa.Table:
    """The documents of one block. Answers: of place -1 the gram ``key`` with its log-probability, else a word's count."""
    holding("ppm")
    if not packed.num_rows:
        return _SCORES.empty_table()
    place, key, value = (answers.column(c).to_numpy() for c in ("place", "key", "value"))
    g = place < 0
    find, logp = Slots(key[g]), value[g]
    row = packed.to_pylist()[0]
    counts = _unpack(row["word_counts"], np.int64).copy()
    counts[place[~g]] = value[~g].astype(np.int64)
    del packed, answers, place, key, value
    unpack = zstandard.ZstdDecompressor().decompress
    count_of = Lookup(unpack(row["words"]).split(b" "), counts)
    text, out = unpack(row["text"]), []
    least = math.log10(train_tokens + train_words + 1)  # N + 1 * (V + 1)
    log10e = 1 / math.log(10)
    places = np.cumsum([0, *row["sizes"]]).tolist()
    ends = int(count_of([END])[0])
    for run in _together(text[a:b] for a, b in zip(places[:-1], places[1:])):
        if len(run) > 1:
            starts = np.cumsum([0, *map(len, run[:-1])])
            sums = np.add.reduceat(logp[find(joined_grams(run).view(np.int64))], starts)
        else:
            sums = np.array([sum(float(logp[find(part.view(np.int64))].sum()) for part in chunks(run[0]))])
        sizes = [len(t.split()) for t in run]
        c = count_of(words_of(b"".join(run)))
        owner = np.repeat(np.arange(len(run)), sizes)
        base = np.bincount(owner, np.log10(c + 1.0) - least, len(run)) + (math.log10(ends + 1.0) - least)
        known = np.bincount(owner[c > 0], minlength=len(run)) + (ends > 0)
        out += [(n + 1, k, b, s * log10e) for n, k, b, s in zip(sizes, known.tolist(), base.tolist(), sums.tolist(), strict=True)]
    out = [(doc_id, held, n, k, train_tokens, b, s) for doc_id, held, (n, k, b, s) in zip(row["doc_ids"], row["held_out"], out, strict=True)]
    hand_back()
    return pa.Table.from_pylist([dict(zip(_SCORES.names, r, strict=True)) for r in out], _SCORES)


def scores(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (of single words) and score (PPM) of all ``docs``
    (doc_id, text); both are log10 probabilities under models of the documents that are not held out."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        packed = scratch.keep(blocks(docs, size))
        asked = listed_grams(packed)
        model = scratch.keep(log_probabilities(scratch.keep(asked.groupBy("gram").agg(F.sum("n").alias("n")), narrow=16)), narrow=16)
        words = listed_words(packed)
        counted = scratch.keep(words.groupBy("word").agg(F.sum("n").alias("c"), F.count("*").alias("blocks")), narrow=16)
        sums = counted.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
        n, v = sums["n"] or 0, sums["v"] or 0
        from_grams = asked.select("block", "gram").join(model, "gram").select("block", F.lit(-1).cast("long").alias("place"), F.col("gram").alias("key"), F.col("logp").alias("value"))
        from_words = words.select("block", "place", "word").join(counted.where("blocks > 1"), "word").select("block", "place", F.lit(0).cast("long").alias("key"), F.col("c").cast("double").alias("value"))
        answers = from_grams.unionByName(from_words)
        parts = packed.select("block", "doc_ids", "held_out", "sizes", "text", "words", "word_counts")
        scored = parts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda a, b: _score_block(a, b, n, v), SCORES)
        return cut(scored, narrow=16)


def adaptive_bits(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_bytes and bits: the code length of each text by a model that starts empty and learns each byte after it has
    coded it. One pass without a shuffle; a trie a document, as large as the document's distinct contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [adaptive_code(canonical(t.as_py()), order) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(canonical(t.as_py())) for t in b.column("text")], pa.int64()), pa.array(found, pa.float64())], names=["doc_id", "n_bytes", "bits"])

    return texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, bits double")


def adaptive_code(b: bytes, order: int = ORDER) -> float:
    trie: dict[bytes, dict[int, int]] = {}
    padded, bits = END * order + b, 0.0
    for i in range(order, len(padded)):
        s, excluded = padded[i], frozenset()
        for k in range(order, -1, -1):
            counts = trie.get(padded[i - k : i])
            if not counts:
                continue
            left = {c: n for c, n in counts.items() if c not in excluded} if excluded else counts
            total = sum(left.values())
            if s in left:
                bits -= math.log2((left[s] - 0.5) / total)
                break
            if left:
                bits -= math.log2(0.5 * len(left) / total)
            excluded = counts.keys()
        else:
            bits += math.log2(ALPHABET - len(excluded))
        for k in range(order, -1, -1):
            counts = trie.setdefault(padded[i - k : i], {})
            counts[s] = counts.get(s, 0) + 1
            if counts[s] > 1:  # it was known here, so shorter contexts don't count it
                break
    return bits


def op11_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(read_table(spark, sf_dir, "documents"))
