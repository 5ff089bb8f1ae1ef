"""Byte-level BPE by prefix dynamic programming.

For a piece of bytes, exactly one token can come last in the BPE encoding of each prefix. A candidate (a
vocabulary entry that ends the prefix) is that token if it is valid after the last token of the prefix it
leaves: the pair merges to itself and nothing else. ``last`` holds the unique valid last token of each
prefix, so an append continues where it stopped, and an edit recomputes from the edit until the states
agree again. Pair validity depends on two tokens only and is remembered.

Defined results: a null or empty text has no tokens; text is split by the pattern first, each match is
encoded on its own, strings of special tokens are ordinary text. Repeated rows repeat in the result.
A very long text is encoded match by match, whole. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from kinweave.llm.common import hand_back, holding, read_table, texts

CACHED_PIECES = 400_000  # pieces remembered by a worker in each of two generations
CACHED_PAIRS = 500_000
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


class PrefixBPE:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.alone: dict[bytes, bool] = {}  # whether a token is the encoding of its own bytes
        self.reach: dict[bytes, int] = {}  # longest entry by its first two bytes
        for t in ranks:
            self.reach[t[:2]] = max(len(t), self.reach.get(t[:2], 1))

    def _merge(self, data: bytes) -> list[bytes]:
        """Plain merging by lowest rank; used for the short strings of a pair only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        get = self.ranks.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: bytes, b: bytes) -> bool:
        """Whether token b can stand after token a: their bytes encode to just this pair."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self._merge(a + b) == [a, b]
        return known

    def stands(self, token: bytes) -> bool:
        """Whether token can come first: its bytes encode to just itself."""
        known = self.alone.get(token)
        if known is None:
            known = self.alone[token] = len(token) == 1 or self._merge(token) == [token]
        return known

    def longest_matches(self, piece: bytes) -> list[bytes] | None:
        """The piece by longest matches, if these tokens are its encoding: the first stands and each follows the one
        before. Where they aren't, None; the prefix states decide then."""
        ranks, reach, pairs, out, at, n, before = self.ranks, self.reach, self.pairs, [], 0, len(piece), None
        while at < n:
            end = at + reach.get(piece[at : at + 2], 1)
            if end > n:
                end = n
            while (token := piece[at:end]) not in ranks:
                end -= 1
            if before is None:
                if not self.stands(token):
                    return None
            else:
                ok = pairs.get((before, token))
                if ok is None:
                    ok = self.follows(before, token)
                if not ok:
                    return None
            out.append(token)
            before, at = token, end
        return out

    def extend(self, data: bytes, last: list[bytes], upto: int | None = None) -> list[bytes]:
        """``last`` (for the prefixes of data[:len(last)]) continued to the prefixes up to ``upto``."""
        ranks, longest, pairs = self.ranks, self.longest, self.pairs
        for end in range(len(last) + 1, (len(data) if upto is None else upto) + 1):
            for start in range(max(0, end - longest), end):
                token = data[start:end]
                if token in ranks:
                    if start:
                        before = last[start - 1]
                        ok = pairs.get((before, token))
                        if ok is None:
                            ok = self.follows(before, token)
                    else:
                        ok = self.stands(token)
                    if ok:
                        last.append(token)
                        break
            else:
                raise AssertionError("no valid last token")  # single bytes exist, so this cannot happen
        return last

    def tokens_of(self, last: list[bytes]) -> list[int]:
        out, at = [], len(last)
        while at:
            token = last[at - 1]
            out.append(self.ranks[token])
            at -= len(token)
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)  # a piece that is an entry is that entry, even where merging can't reach it
        if whole is not None:
            return [whole]
        tokens = self.longest_matches(piece)
        return self.tokens_of(self.extend(piece, [])) if tokens is None else list(map(self.ranks.__getitem__, tokens))

    def edit(self, data: bytes, last: list[bytes], start: int, stop: int, new: bytes) -> tuple[bytes, list[bytes]]:
        """data[start:stop] replaced by ``new``, and the states: those before ``start`` are kept; behind the edit,
        once as many states in a row as the longest token agree with the old ones, the rest is taken over."""
        out = data[:start] + new + data[stop:]
        state, agree, shift = last[:start], 0, len(new) - (stop - start)
        while len(state) < len(out):
            self.extend(out, state, len(state) + 1)
            old = len(state) - shift
            agree = agree + 1 if old > stop and state[-1] == last[old - 1] else 0
            if agree >= self.longest:
                return out, state + last[old:]
        return out, state

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class TextEncoder(dict):
    """Ids of whole texts as decimal strings; as a mapping, from a piece to its ids joined by commas."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cached: int = CACHED_PIECES) -> None:
        super().__init__()
        self.bpe, self.find, self.cached = PrefixBPE(ranks), regex.compile(pattern).findall, cached
        self.old: dict[str, str] = {}
        self.bytes_of = {str(v): k for k, v in ranks.items()}

    def __missing__(self, piece: str) -> str:
        ids = self.old.get(piece)
        if ids is None:
            ids = ",".join(map(str, self.bpe.encode_piece(piece.encode())))
        if len(self) >= self.cached:
            self.old = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def ids(self, text: str) -> list[str]:
        return ",".join(map(self.__getitem__, self.find(text))).split(",") if text else []

    def decode(self, ids: list[str]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_ENCODERS: dict[tuple[str, str], TextEncoder] = {}  # of this worker: its remembered pieces serve later tasks


def _forget() -> None:
    _ENCODERS.clear()


def encoder(content: bytes, pattern: str) -> TextEncoder:
    key = (hashlib.sha256(content).hexdigest(), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(parse_ranks(content), pattern)
    return _ENCODERS[key]


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Each document's token count and the digests of its ids and of the decoded bytes; with_ids: the ids too.

    One pass without a shuffle. The rank file is read on the driver and broadcast (its size is that of
    the vocabulary, not of the data).
    """
    with open(rank_file, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("bpe", _forget)
        enc = encoder(content.value, pattern)
        for b in batches:
            counts, id_hash, text_hash, every = [], [], [], []
            for text in b.column("text"):
                ids = enc.ids(text.as_py())
                counts.append(len(ids))
                id_hash.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
                text_hash.append(hashlib.sha256(enc.decode(ids)).hexdigest())
                if with_ids:
                    every.append(list(map(int, ids)))
            more = [pa.array(every, pa.list_(pa.int32()))] if with_ids else []
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_hash, pa.string()), pa.array(text_hash, pa.string()), *more], names=names)
        hand_back()

    src = texts(docs)
    return src.select(src.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT + (", ids array<int>" if with_ids else ""))


def decode_ids(encoded: DataFrame, rank_file: str) -> DataFrame:
    """(doc_id, ids) back to (doc_id, text)."""
    with open(rank_file, "rb") as f:
        content = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {v: k for k, v in parse_ranks(content.value).items()}
        for b in batches:
            out = [b"".join(map(tokens.__getitem__, ids.as_py() or ())).decode("utf-8", "replace") for ids in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(read_table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
