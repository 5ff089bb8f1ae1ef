"""The corpus pipeline: quality, near-duplicates, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
A stage sees what its predecessor kept. Documents are told apart by all of (doc_id, text), so rows that repeat
a doc_id with another text are judged on their own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import bpe, decontaminate, kneser_ney, near_dup, pii
from kinweave.llm.common import cut, read_table, ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENS = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    ship(spark)
    docs = _columns(docs)
    judged = kneser_ney.classify(docs, read_table(spark, sf_dir, "labels"))
    bad = judged.where(~F.col("kept")).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("bad_hash"))
    return docs.join(bad, same, "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    ship(spark)
    return near_dup.drop_near_duplicates(_columns(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    ship(spark)
    return decontaminate.drop_contaminated(_columns(docs), read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data replaced by its kind; n_chars is that of the new text."""
    ship(spark)
    return pii.redact(_columns(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids of each document."""
    ship(spark)
    return bpe.encode_documents(_columns(docs), TOKENS, public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("byte-level BPE", tokens),
]
ORACLE_SQL = None  # perplexities and edit distances are no SQL; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what each stage before it keeps is written once, as later ones read it several times."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
