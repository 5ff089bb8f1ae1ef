"""Long texts are cut only for vocabularies that drop white space; counts are the library's either way."""

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from kinweave.llm import token_counts


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_counts_of_long_texts_with_runs_of_white_space(spark, name):
    texts = ["one two  three\n\n\nfour\t \t five   " * 1500, " " * 40_000 + "x", "", "short  text"]
    t = Tokenizer.from_file(str(P.path(name)))
    df = spark.createDataFrame([(i, x, 5) for i, x in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, str(P.path(name))).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}


def test_splitters():
    drops = token_counts.drops_white_space
    assert drops({"type": "Whitespace"}) and drops({"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"[\p{L}]+|[^\s\p{L}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel"}]})
    assert not drops(None) and not drops({"type": "ByteLevel"}) and not drops({"type": "Split", "pattern": {"Regex": r"\s|\w+"}, "behavior": "Removed", "invert": True})
