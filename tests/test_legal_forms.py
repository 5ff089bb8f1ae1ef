"""Names without legal forms, over the whole table of forms, against a plain loop."""

import random

from kinweave.functions.legal_forms import LEGAL_FORMS, legal_base


def plain(name):
    if name is None:
        return None
    tokens, forms = name.split(" "), {tuple(f.split(" ")) for f in LEGAL_FORMS}
    for _ in range(2):
        for k in range(max(map(len, forms)), 0, -1):
            if len(tokens) >= k and tuple(tokens[len(tokens) - k :]) in forms:
                tokens = tokens[: len(tokens) - k]
    return " ".join(tokens) or None


def test_every_form_alone_behind_names_and_behind_each_other(spark):
    rnd = random.Random(2)
    word = lambda: rnd.choice(["ACME", "NORTH", "CO", "SPA", "Z", "O", "DE", "STRAßE"])
    names = [None, "", "ACME"] + list(LEGAL_FORMS) + [f"ACME {f}" for f in LEGAL_FORMS] + [f"{f} ACME" for f in LEGAL_FORMS]
    names += [" ".join([*(word() for _ in range(rnd.randint(0, 3))), rnd.choice(LEGAL_FORMS), *rnd.choices(LEGAL_FORMS, k=rnd.randint(0, 2))]) for _ in range(1500)]
    got = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string").select("i", legal_base("name").alias("b")).collect()
    assert {r["i"]: r["b"] for r in got} == {i: plain(n) for i, n in enumerate(names)}


def test_expected_names(spark):
    want = {"ACME HOLDINGS CO LTD": "ACME HOLDINGS", "ACME GMBH CO KG": "ACME", "FABRYKA SP Z O O": "FABRYKA", "BANCO S A DE C V": "BANCO", "LIMITED EDITIONS": "LIMITED EDITIONS", "ACME INC PLC": "ACME", "LTD": None}
    rows = spark.createDataFrame([(k,) for k in want], "name string").select("name", legal_base("name").alias("b")).collect()
    assert {r["name"]: r["b"] for r in rows} == want
