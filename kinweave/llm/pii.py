"""Personal data: exact base patterns as seeds, and bootstrapped contextual extraction on top.

1. One pass over the texts finds the base spans and, outside them, identifier-like tokens (with a digit or an @). Seeds are
   the base spans and tokens in the form of a key (KEY: 32 and more hexadecimal digits). Each has its lexical patterns:
   - around it: the two words before (``2``), the word before with the word behind (``1``), the word before (``L``), each of
     the CUES words before as a cue (``C``), the name it is assigned to with the signs between (``A``: ``token="``), these
     signs alone (``W``);
   - of its form: class of characters with the length (``S``), the class alone (``G``), letters and digits in a long mixture
     (``E``), capital letters at its start (``X``).
   The pass counts the words, names and signs of the texts, too.
2. Patterns and instances form a graph of edges (pattern, instance) with counts, scored in Spark. A pattern's confidence is
   the share of what it surrounds that is known. Against it count the other places of its words (for two words: as many as
   would meet by chance), tokens that are plain numbers, and, by UNKNOWN, the rest. A pattern has support by SUPPORT distinct
   known instances. An instance's belief joins its best pattern around it, of form and of start, as independent evidence.
   Seeds are known, and what is believed (CONFIDENT) is from then on. Confidence grows with what is known and the known only
   grow, so the rounds end at a fixed point, when a round adds no instance. Sums are combined before each shuffle, so a
   pattern that stands in a third of all texts is a few partial rows.
3. Tokens whose own patterns give a belief of CONFIDENT are new spans of kind ``ident``; base spans stay as they are.

Defined results: a null or empty text has no spans; offsets are code points, ends exclusive; rows with one
doc_id are separate texts; a token is taken to its ends, however long. An empty table gives an empty result. Extra columns
are not read by ``find`` and kept by ``redact``. Limits that are features: identifiers have SHORTEST characters at least,
the words around are looked for 40 characters before and 24 behind, cues 96 before. Signs at a token's end are part of it,
but for punctuation and signs that stand at its start, too (``**key1**``). Names, forms and tokens longer than LONG stand in
patterns by their hash.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import cut, hand_back, holding, read_table, texts

KINDS = ("email", "ip", "card", "phone")  # fixed order of the digest
LEARNED = "ident"
LONG, SHORTEST = 64, 6
CONFIDENT, SUPPORT, PRIOR, UNKNOWN = 0.6, 3, 2.0, 0.25
CUES = 4
MIXED, CHANGES = 16, 3  # least length, and changes between letters and digits, of a mixture
_HELD = 50_000  # distinct words that a task counts before it hands them on

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# The contract's patterns; possessive where giving back characters can't make a match, so that time is linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\W\d_]+")
_TRIM, _SIGN = ".,;:!?()[]{}<>\"'", "|*%$#&"
_APART = frozenset("=:,;()[]{}<>\"'|&")
_SIGNS = re.compile(r"([=:])\s{0,4}([\"'(\[]?)")
_KEY = re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}")
_CLOSED = frozenset("\"')]}>,;:")
_START = re.compile(r"[A-Z]{3,4}")
_CHANGE = re.compile(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")
_CLASSES = [("9", re.compile("[0-9]+")), ("h", re.compile("[0-9a-f]+")), ("H", re.compile("[0-9A-F]+")), ("a", re.compile("[0-9a-z]+")), ("A", re.compile("[0-9A-Z]+")), ("m", re.compile("[0-9A-Za-z]+"))]
_RUNS = [(re.compile("[0-9]+"), "9"), (re.compile("[a-z]+"), "a"), (re.compile("[A-Z]+"), "A")]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches: each has one @, so each @ is tried once, with the run before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end), sorted."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    out.sort()
    return out


def digest(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def _tokens(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Identifier-like tokens outside the base spans: runs without white space and the signs of _APART."""
    at, n, k = 0, len(text), 0
    by_end = sorted((e, s) for s, _, e in spans)
    first = [n] * (len(by_end) + 1)  # where the spans from here on start at the earliest
    for i in range(len(by_end) - 1, -1, -1):
        first[i] = min(first[i + 1], by_end[i][1])
    inside = lambda i: 0 <= i < n and not text[i].isspace() and text[i] not in _APART
    while m := _MARK.search(text, at):
        start = m.start()
        while start > at and inside(start - 1):
            start -= 1
        end = m.end()
        while end < n and inside(end):
            end += 1
        more = end  # a run of signs that ends the word is the token's, too
        while more < n and text[more] in _SIGN:
            more += 1
        end = more if more == n or text[more].isspace() or text[more] in _CLOSED else end
        at = end
        while k < len(by_end) and by_end[k][0] <= start:
            k += 1
        if first[k] < end:
            continue
        begun = start
        while start < end and text[start] in _TRIM + _SIGN:
            start += 1
        before = text[begun:start]
        while end > start and (text[end - 1] in _TRIM or (text[end - 1] in _SIGN and text[end - 1] in before)):
            end -= 1
        if end - start >= SHORTEST and _MARK.search(text, start, end):
            yield start, end


def _assigned(text: str) -> dict[int, tuple[str, str]]:
    """By the place where a value starts: its name with the signs between, and the signs alone."""
    out = {}
    if "=" in text or ":" in text:
        for m in _SIGNS.finditer(text):
            end = m.start()
            while end > 0 and m.start() - end < 4 and text[end - 1].isspace():
                end -= 1
            start = end
            while start > 0 and (text[start - 1].isalpha() or _WORD.match(text[start - 1])):
                start -= 1
            if start < end:
                out[m.end()] = f"{_short(text[start:end].lower())}{m[1]}{m[2]}", f"{m[1]}{m[2]}"
    return out


def _short(value: str) -> str:
    """``value``, or its hash where it is long."""
    return value if len(value) <= LONG else hashlib.blake2b(value.encode(), digest_size=16).hexdigest()


def _forms(token: str) -> list[str]:
    kind = next((k for k, c in _CLASSES if c.fullmatch(token)), None)
    if kind is None:
        shape = token
        for run, sign in _RUNS:
            shape = run.sub(sign, shape)
        return [f"S:{_short(shape)}"]
    out = [f"S:{kind}{len(token)}"]
    if kind != "9" and len(token) >= MIXED:
        out += [f"G:{kind}"] + ["E:"] * (len(_CHANGE.findall(token)) >= CHANGES)
    return out


def _patterns(text: str, start: int, end: int, assigned: dict[int, tuple[str, str]]) -> list[str]:
    before = [w.lower() for w in _WORD.findall(text, max(0, start - 40), start)][-2:]
    after = _WORD.search(text, end, min(len(text), end + 24))
    low = max(0, start - 96)
    cues = [m[0].lower() for m in _WORD.finditer(text, low, start) if m.start() > low or not low or not _WORD.match(text[low - 1])][-CUES:]
    out = [f"2:{' '.join(before)}"] if len(before) == 2 else []
    out += [f"1:{before[-1]} {after[0].lower()}"] if before and after else []
    out += [f"L:{w}" for w in cues[-1:]] + [f"C:{w}" for w in dict.fromkeys(cues)]
    if start in assigned:
        out += [f"A:{assigned[start][0]}", f"W:{assigned[start][1]}"]
    first = _START.match(text, start, end)
    return out + _forms(text[start:end]) + ([f"X:{first[0]}"] if first else [])


def found_in(text: str, spans: list[tuple[int, int, int]], assigned: dict[int, tuple[str, str]]) -> list[dict]:
    """The base spans and the identifier-like tokens of a text, with what the graph needs of them."""
    out = []
    for s, e, base in [(s, e, True) for s, _, e in spans] + [(s, e, False) for s, e in _tokens(text, spans)]:
        token = text[s:e]
        key = int.from_bytes(hashlib.blake2b(token.lower().encode(), digest_size=8).digest(), "big", signed=True)
        plain = not base and not any(c.isalpha() or c == "@" for c in token)
        out.append({"start": s, "end": e, "base": base, "seed": base or _KEY.fullmatch(token) is not None, "plain": plain, "instance": key, "patterns": _patterns(text, s, e, assigned)})
    return out


def words_in(text: str, assigned: dict[int, tuple[str, str]]) -> Iterator[str]:
    yield from map(str.lower, _WORD.findall(text))
    for pair in assigned.values():
        yield from pair


_FOUND = "struct<start:int,end:int,base:boolean,seed:boolean,plain:boolean,instance:bigint,patterns:array<string>>"


def _word_key(word: str) -> int:
    """60 bits that ``_word_key_of`` gives in Spark: the checkpoint then has numbers only."""
    return int(hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()[:15], 16)


def _word_key_of(word):
    return F.conv(F.substring(F.md5(word), 1, 15), 16, 10).cast("long")


def extract(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_hash, base (array of start, kind, end), found (seeds and candidates with their patterns) and
    words and uses (the keys and counts of a run of rows' words, names and signs, in its last row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            holding("pii")
            base_out, found_out, keys_out, uses_out, words = [], [], [], [], Counter()
            for i, value in enumerate(b.column("text"), 1):
                text = value.as_py()
                assigned = _assigned(text)
                words.update(words_in(text, assigned))
                full = len(words) >= _HELD or i == b.num_rows
                keys_out.append([*map(_word_key, words)] if full else [])
                uses_out.append([*words.values()] if full else [])
                if full:
                    words = Counter()
                spans = base_spans(text)
                base_out.append([{"start": s, "kind": KINDS[k], "end": e} for s, k, e in spans])
                found_out.append(found_in(text, spans, assigned))
            base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
            found_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("seed", pa.bool_()), ("plain", pa.bool_()), ("instance", pa.int64()), ("patterns", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(base_out, base_type), pa.array(found_out, found_type), pa.array(keys_out, pa.list_(pa.int64())), pa.array(uses_out, pa.list_(pa.int32()))], names=["doc_id", "text_hash", "base", "found", "words", "uses"])
        hand_back()

    src = texts(docs)
    out = src.select(src.doc_id.cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id long, text_hash long, base array<struct<start:int,kind:string,end:int>>, found array<{_FOUND}>, words array<long>, uses array<int>")
    return out.withColumn("row", F.monotonically_increasing_id())


def _belief(pattern: str, confidence: str):
    """One less the chance that the best patterns around it, of its form and of its start are all wrong."""
    best = lambda kinds: 1 - F.coalesce(F.max(F.when(F.substring(pattern, 1, 1).isin(*kinds), F.col(confidence))), F.lit(0.0))
    return 1 - best("21LCAW") * best("SGE") * best("X")


def _blank(able: DataFrame, extracted: DataFrame) -> DataFrame:
    """(pattern, blank): the other places of a pattern's words in the texts."""
    words = cut(extracted.select(F.explode(F.arrays_zip("words", "uses")).alias("w")).groupBy(F.col("w.words").alias("word")).agg(F.sum("w.uses").alias("all")), narrow=2)
    total = words.agg(F.sum("all").alias("total"))  # one row
    parts = F.split(F.expr("substring(pattern, 3)"), " ")
    around = able.where(F.substring("pattern", 1, 1).isin(*"21LCAW")).withColumn("pair", F.substring("pattern", 1, 1).isin(*"21"))
    each = around.select("pattern", "uses", "pair", F.posexplode(F.when(F.col("pair"), parts).otherwise(F.array(F.expr("substring(pattern, 3)")))).alias("k", "w")).withColumn("word", _word_key_of(F.col("w")))
    met = each.join(words, "word").groupBy("pattern", "uses", "pair").agg(F.max(F.when(F.col("k") == 0, F.col("all"))).alias("a"), F.max(F.when(F.col("k") == 1, F.col("all"))).alias("b"))
    places = F.when(F.col("pair"), F.col("a") * F.coalesce("b", F.lit(0)) / F.col("total")).otherwise(F.col("a"))
    return met.crossJoin(F.broadcast(total)).select("pattern", F.greatest(places - F.col("uses"), F.lit(0.0)).alias("blank"))


def scored_patterns(extracted: DataFrame, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """Patterns (pattern, confidence) with support at the fixed point of the pattern-instance graph's scores."""
    found = extracted.select(F.explode("found").alias("f")).select("f.seed", "f.plain", "f.instance", F.explode("f.patterns").alias("pattern"))
    edges = found.groupBy("pattern", "instance").agg(F.max("seed").alias("known"), F.min("plain").alias("plain"), F.count("*").alias("n"))
    # with fewer instances of any kind a pattern never gets support
    able = cut(edges.groupBy("pattern").agg(F.count("*").alias("instances"), F.sum("n").alias("uses")).where(F.col("instances") >= support), narrow=2)
    edges = cut(edges.join(able.select("pattern"), "pattern", "left_semi"), narrow=2)
    blank = cut(_blank(able, extracted), narrow=2)
    while True:
        weight = F.log1p("n")
        against = F.when(F.col("plain"), weight).otherwise(UNKNOWN * weight)
        sums = edges.groupBy("pattern").agg(F.sum(F.when(F.col("known"), weight).otherwise(0.0)).alias("held"), F.sum(F.when(F.col("known"), 0.0).otherwise(against)).alias("against"), F.sum(F.col("known").cast("int")).alias("support")).where(F.col("support") >= support)
        rest = (PRIOR + F.coalesce("blank", F.lit(0.0))) * F.log1p(F.lit(1))
        patterns = cut(sums.join(blank, "pattern", "left").select("pattern", (F.col("held") / (F.col("held") + F.col("against") + rest)).alias("confidence")), narrow=2)
        hopeful = edges.where("not known").select("instance", "pattern").join(patterns, "pattern")
        fresh = cut(hopeful.groupBy("instance").agg(_belief("pattern", "confidence").alias("belief")).where(F.col("belief") >= confident).select("instance"), narrow=2)
        if not fresh.limit(1).count():
            return patterns
        edges = cut(edges.join(fresh.withColumn("fresh", F.lit(True)), "instance", "left").select("pattern", "instance", (F.col("known") | F.coalesce("fresh", F.lit(False))).alias("known"), "plain", "n"), narrow=2)


def learned_spans(extracted: DataFrame, patterns: DataFrame, confident: float = CONFIDENT) -> DataFrame:
    """(row, learned): new spans, by row."""
    candidates = extracted.select("row", F.explode("found").alias("f")).where(~F.col("f.base")).select("row", "f.start", "f.end", F.explode("f.patterns").alias("pattern"))
    hits = candidates.join(patterns, "pattern").groupBy("row", "start", "end").agg(_belief("pattern", "confidence").alias("belief")).where(F.col("belief") >= confident)
    return hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", F.lit(LEARNED).alias("kind"), "end"))).alias("learned"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and learned spans (arrays of start, kind, end) of every row."""
    extracted = cut(extract(docs))
    learned = learned_spans(extracted, scored_patterns(extracted))
    none = F.array().cast("array<struct<start:int,kind:string,end:int>>")
    return extracted.select("row", "doc_id", "base").join(learned, "row", "left").select("doc_id", "base", F.coalesce("learned", none).alias("learned"))


def _redacted(text: str, spans: list[tuple[int, str, int]]) -> str:
    """Each span, or run of spans that overlap, as the name of its first kind in brackets."""
    out, at = [], 0
    for start, kind, end in sorted(spans, key=lambda s: (s[0], (*KINDS, LEARNED).index(s[1]))):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """The documents, all columns, without personal data in ``text``; ``n_chars``, if there, is that of the new text.

    Base spans are found again where the text is; texts are joined only if there are learned spans at all.
    """
    names = docs.columns
    extracted = cut(extract(docs))
    learned = cut(learned_spans(extracted, scored_patterns(extracted)), narrow=2)
    source = docs.withColumn("__learned", F.lit(None).cast("array<struct<start:int,kind:string,end:int>>"))
    if learned.limit(1).count():
        places = extracted.join(learned, "row").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("learned").alias("__learned")).dropDuplicates(["__id", "__hash"])
        same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__hash"))
        source = docs.join(places, same, "left").select(*docs.columns, "__learned")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for value, more in zip(b.column("text"), b.column("__learned")):
                text = value.as_py()
                spans = [(s, KINDS[k], e) for s, k, e in base_spans(text)] if text else []
                spans += [(x["start"], x["kind"], x["end"]) for x in more.as_py() or ()]
                out.append(_redacted(text, spans) if spans else text)
            cols = {n: b.column(n) for n in names} | {"text": pa.array(out, pa.string())}
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in out], b.column("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return source.mapInArrow(run, docs.schema)


def _order(x):
    return F.struct(x["start"].alias("start"), F.array_position(F.array(*map(F.lit, [*KINDS, LEARNED])), x["kind"]).alias("at"), x["kind"].alias("kind"), x["end"].alias("end"))


def _digest(spans):
    return F.array_join(F.transform(F.array_sort(F.transform(spans, _order)), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op4_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read_table(spark, sf_dir, "documents"))
    of_kind = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(of_kind, KINDS), F.sha2(_digest(F.col("base")), 256).alias("base_sha256"), _digest(F.concat("base", "learned")).alias("spans"), F.size("learned").cast("long").alias("n_ident"), (F.size("base") + F.size("learned")).cast("long").alias("n_spans"))
