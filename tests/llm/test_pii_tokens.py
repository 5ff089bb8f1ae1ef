"""Identifiers are taken to their ends: long keys, long passwords, signs at their ends."""

from kinweave.llm import pii


def tokens(text):
    return [text[f["start"] : f["end"]] for f in pii.found_in(text, pii.base_spans(text), pii._assigned(text)) if not f["base"]]


def test_tokens_of_any_length_and_with_signs():
    key, password = "ab12" * 32, "aB3$" * 20
    assert tokens(f'token = "{key}" end') == [key]
    assert pii.found_in(f"x {key}", [], {})[0]["seed"]
    assert tokens(f"password={password} x") == [password]
    assert tokens("password: pass1word#$%& then") == ["pass1word#$%&"]
    assert tokens("say **key12345** or (key99999), a=12345678&b=2.") == ["key12345", "key99999", "12345678"]
    assert tokens("z" * 5000 + "1") == ["z" * 5000 + "1"]
    assert all(len(p) < 120 for f in pii.found_in("é" * 5000 + "=1é2" * 3000, [], {}) for p in f["patterns"])


def test_names_of_any_length_and_base_spans_inside_a_word():
    assert pii._assigned("N" * 50 + ' = "v') == {54: ("n" * 50 + '="', '="')}
    text = "id1;" * 12 + "ip10.1.2.3and10.1.2.4x7"
    assert tokens(text) == []  # no token holds a base span, however many stand before it


def test_long_secrets_are_redacted(spark):
    word = lambda i: "".join("bcdfg"[(i >> k) % 5] + "aeiou"[(i >> k) % 5] for k in range(4))
    keys, passwords = [f"{i:02x}" * 64 for i in range(16, 40)], ["pW9$" * 20 + f"{i:03d}#" for i in range(12)]
    texts = [f'then token = "{k}" {word(i)}' for i, k in enumerate(keys)] + [f'here token = "{p}" {word(i)}' for i, p in enumerate(passwords)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = [r["text"] for r in pii.redact(df).collect()]
    assert not any(s in t for t in clean for s in [*keys, *passwords]) and not any("#" in t for t in clean)
