"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut into parts of at most PART characters where the tokenizer can't see across: behind a
space, tab or newline (white space belongs to no token of a vocabulary that drops it, and no special
string holds any). Parts go to the library in batches of about BATCH bytes, whatever the row
sizes, so that memory does not depend on how long the texts of a batch are.

A vocabulary whose splitter keeps white space (``drops_white_space``) sees across it, so its texts stay whole.

Defined results: a null or empty text has 0 tokens and 0 bytes; a text without a safe boundary stays whole, however long;
repeated rows repeat; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from kinweave.llm.common import holding, read_table, texts

PART, BATCH, LIMIT = 16_384, 1 << 20, 2048
_SAFE = " \n\t\r"


def safe_parts(text: str, most: int = PART) -> Iterator[str]:
    """``text`` in parts that end behind white space, each of ``most`` characters where such a place exists."""
    at, end = 0, len(text)
    while end - at > most:
        cut = max(text.rfind(c, at, at + most) for c in _SAFE)
        if cut < 0:
            cut = min((i for c in _SAFE if (i := text.find(c, at + most)) >= 0), default=end - 1)
        yield text[at : cut + 1]
        at = cut + 1
    if at < end:
        yield text[at:]


def drops_white_space(splitter: dict | None) -> bool:
    """Whether a tokenizer file's ``pre_tokenizer`` leaves white space out, so that no token can lie across it."""
    if not splitter:
        return False
    kind = splitter.get("type")
    if kind == "Sequence":
        return any(map(drops_white_space, splitter.get("pretokenizers", [])))
    if kind == "Split":  # what matches is kept, the rest goes; the pattern must not take white space in
        pattern = splitter.get("pattern", {}).get("Regex", "")
        return splitter.get("behavior") == "Removed" and bool(splitter.get("invert")) and not any(regex.fullmatch(pattern, c) for c in _SAFE)
    return kind in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer")


_TOKENIZERS: dict[str, object] = {}


def _forget() -> None:
    _TOKENIZERS.clear()



def _tokenizer(kind: str, content: bytes):
    import hashlib

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
    key = f"{kind}:{hashlib.sha256(content).hexdigest()}"
    if key not in _TOKENIZERS:
        if kind == "json":
            from tokenizers import Tokenizer

            t = Tokenizer.from_str(content.decode())
            t.no_truncation()
            t.no_padding()
        else:
            import sentencepiece

            t = sentencepiece.SentencePieceProcessor(model_proto=content)
        _TOKENIZERS[key] = t
    return _TOKENIZERS[key]


def lengths(kind: str, content: bytes, parts: list[str]) -> list[int]:
    t = _tokenizer(kind, content)
    if kind == "json":
        return [len(e) for e in t.encode_batch_fast(parts, add_special_tokens=False)]
    return [len(x) for x in t.encode(parts, num_threads=1)]


def count_tokens(docs: DataFrame, model_file: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each document; one pass, no shuffle.

    The model file is read on the driver and broadcast (the size of a vocabulary). A sentencepiece model
    sees across white space, so its texts stay whole.
    """
    kind = "json" if model_file.endswith(".json") else "model"
    with open(model_file, "rb") as f:
        raw = f.read()
    content = docs.sparkSession.sparkContext.broadcast(raw)
    parted = kind == "json" and drops_white_space(json.loads(raw).get("pre_tokenizer"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("token_counts", _forget)
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            size = np.zeros(b.num_rows, np.int64)
            parts: list[str] = []
            rows: list[int] = []
            held = 0

            def flush() -> None:
                if parts:
                    np.add.at(n, rows, lengths(kind, content.value, parts))
                    parts.clear()
                    rows.clear()

            for i, value in enumerate(b.column("text")):
                text = value.as_py()
                size[i] = len(text.encode())
                for p in safe_parts(text) if parted else ([text] if text else []):
                    parts.append(p)
                    rows.append(i)
                    held += len(p)
                    if held >= BATCH:
                        flush()
                        held = 0
            flush()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    src = texts(docs)
    return src.select(src.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read_table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
