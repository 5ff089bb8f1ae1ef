"""URL filters: rules first, then gradient-boosted trees on lexical features.

The trees are trained here from labelled URLs: a bounded sample of at most TRAIN_ROWS labelled rows (those
with the smallest hash of the URL, so that partitions and order do not matter), Newton boosting of the
logistic loss on quantile-binned features. Labels come in groups (``origin``: who or what labelled the URL; in the query, the
rule that decides it). A label that follows from a feature teaches the trees that feature, not what it stands for, so
what they may block is decided on groups held out: each fold of groups is scored by trees that were fitted without it, and the
threshold is the least at which ASKED of the blocked URLs are labelled so, over two groups at least that have such
labels. Where no threshold does, the trees block nothing, and what no rule decides is allowed. Features: lengths, depth, labels of the host, digit ratio, entropy,
hyphens, parameter counts, and statistics of the host's suffix (its smoothed rate of blocks and its
frequency in the sample; each row is seen with and without them). A model has a fixed size and goes to the tasks in the closure.

Defined results: a null URL or one without ``://`` has an empty host and path and no rule; without labelled
rows of both classes the model is their constant rate (allow if there are none). Repeated rows repeat; a very long URL is
read whole; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import cut, read_table

TRAIN_ROWS = 20_000
FOLDS, ASKED, LEAST = 5, 0.9, 30  # folds of label groups; share of right blocks, and of how many, that a threshold needs
#: Fixed rules of the query: (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = re.compile(r"([^/?#]*)([^?#]*)(?:\?([^#]*))?")
FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digit_ratio", "longest_digits", "entropy", "hyphens", "parameters", "query_length", "suffix_rate", "suffix_frequency"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """ASCII-lower-cased host behind the first ``://`` up to ``/ ? #``, and the path up to ``? #``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # a later, longer one overrides
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def suffix_of(url: str | None) -> str:
    rest = (url or "").partition("://")[2]
    return _SPLIT.match(rest)[1].lower().rpartition(".")[2].partition(":")[0]


def lexical(urls: list[str | None], suffixes: dict[str, tuple[float, float]], prior: float) -> np.ndarray:
    out = np.zeros((len(urls), len(FEATURES)))
    for i, url in enumerate(urls):
        url = url or ""
        m = _SPLIT.match(url.partition("://")[2])
        host, path, query = m[1], m[2], m[3] or ""
        n = len(url)
        counts = Counter(url)
        digits = sum(counts[c] for c in "0123456789")
        entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0
        rate, frequency = suffixes.get(host.lower().rpartition(".")[2].partition(":")[0], (prior, 0.0))
        out[i] = (
            n, len(host), len(path), path.count("/"), host.count(".") + 1 if host else 0, digits / n if n else 0.0,
            max(map(len, re.findall("[0-9]+", url)), default=0), entropy, url.count("-"), query.count("&") + query.count(";") + 1 if query else 0, len(query), rate, frequency,
        )
    return out


@dataclass
class Trees:
    """Boosted regression trees of one depth as arrays: node k has the children 2k+1 and 2k+2."""

    base: float
    suffixes: dict[str, tuple[float, float]] = field(default_factory=dict)
    prior: float = 0.5
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int32))
    cut: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        depth = int(math.log2(self.leaf.shape[1])) if self.leaf.size else 0
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += leaf[node - len(f)]
        return out

    def probability(self, urls: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(lexical(urls, self.suffixes, self.prior))))


def fit(urls: list[str], blocked: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 5.0, l2: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss; 1 means block."""
    y = np.asarray(blocked, float)
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.01
        return Trees(math.log(p / (1 - p)))
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # both classes weigh the same
    prior = 0.5
    seen: dict[str, list[float]] = {}
    for u, b, w in zip(urls, y, weight):
        s = seen.setdefault(suffix_of(u), [0.0, 0.0])
        s[0] += w
        s[1] += w * b
    suffixes = {k: ((b + 5 * prior) / (n + 5), math.log1p(n)) for k, (n, b) in seen.items()}
    x = lexical(urls, suffixes, prior)
    unknown = x.copy()  # each row once more as if its suffix had never been seen, so that new suffixes are judged by the rest
    unknown[:, -2:] = prior, 0.0
    x, y, weight = np.concatenate([x, unknown]), np.concatenate([y, y]), np.concatenate([weight, weight]) / 2
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)  # bin b: x <= edges[b]
    base = math.log(prior / (1 - prior))
    margin, inner, leaves = np.full(len(y), base), 2**depth - 1, 2**depth
    features, cuts, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (y - p), weight * p * (1 - p)
        f, c, node = np.zeros(inner, np.int32), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best, pick = np.full(width, 1e-9), [(0, np.inf)] * width
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = (node - first) * (bins + 1) + binned[:, j]
                gs = np.cumsum(np.bincount(key, g, width * (bins + 1)).reshape(width, -1), axis=1)
                hs = np.cumsum(np.bincount(key, h, width * (bins + 1)).reshape(width, -1), axis=1)
                gt, ht, gl, hl = gs[:, -1:], hs[:, -1:], gs[:, : len(e)], hs[:, : len(e)]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < least / 4) | (ht - hl < least / 4)] = -1
                k = gain.argmax(axis=1)
                for n in np.flatnonzero(gain[np.arange(width), k] > best):
                    best[n], pick[n] = gain[n, k[n]], (j, e[k[n]])
            for n, (j, at) in enumerate(pick):
                f[first + n], c[first + n] = j, at
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > c[node])
        at = node - inner
        leaf = rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + l2)
        margin += leaf[at]
        features.append(f)
        cuts.append(c)
        values.append(leaf)
    return Trees(base, suffixes, prior, np.array(features), np.array(cuts), np.array(values))


def held_out_scores(urls: list[str], blocked: list[int], origins: list[str], folds: int = FOLDS) -> np.ndarray:
    """Each URL's probability by trees that have seen no URL of its fold of origins."""
    fold = {o: i % folds for i, o in enumerate(sorted(set(origins)))}
    own, out = np.array([fold[o] for o in origins], np.int64), np.zeros(len(urls))
    for k in sorted(set(fold.values())):
        inside = np.flatnonzero(own == k)
        rest = np.flatnonzero(own != k)
        out[inside] = fit([urls[i] for i in rest], [blocked[i] for i in rest]).probability([urls[i] for i in inside])
    return out


def threshold_of(probability: np.ndarray, blocked: np.ndarray, origins: list[str], asked: float = ASKED, least: int = LEAST) -> float | None:
    """The least probability from which on ``asked`` of the URLs, ``least`` at least, are blocked by their labels, of two
    origins or more; None if there is none."""
    right = n = 0
    seen: set[str] = set()
    best = None
    order = np.argsort(-probability, kind="stable")
    for at, i in enumerate(order):
        n, right = n + 1, right + int(blocked[i])
        if blocked[i]:
            seen.add(origins[i])
        last = at + 1 == len(order) or probability[order[at + 1]] < probability[i]
        if last and n >= least and right >= asked * n and len(seen) >= 2:
            best = float(probability[i])
    return best


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> tuple[Trees, float | None]:
    """A model and its threshold from (url, blocked, origin) rows: at most ``rows`` distinct ones, by the smallest hash of
    the URL.

    Rows whose hash is far from small enough, given their number, do not leave their tasks."""
    known = labelled.where("url is not null and blocked is not null").select("url", F.col("blocked").cast("int").alias("blocked"), F.coalesce("origin", F.lit("")).alias("origin")).distinct()
    known = cut(known.withColumn("h", F.pmod(F.xxhash64("url"), F.lit(1 << 40))))
    near = int(min(1.0, 1.5 * rows / max(1, known.count())) * (1 << 40))
    sample = known.where(F.col("h") <= near).orderBy("h", "url", "blocked", "origin").limit(rows).collect()
    urls, blocked, origins = ([r[c] for r in sample] for c in ("url", "blocked", "origin"))
    threshold = threshold_of(held_out_scores(urls, blocked, origins), np.array(blocked), origins) if urls else None
    return fit(urls, blocked), threshold


def score(pages: DataFrame, model: Trees, id_col: str = "page_id") -> DataFrame:
    """(id, url, block_probability) by the trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.probability(b.column("url").to_pylist()))], names=[*b.schema.names, "block_probability"])

    return pages.select(F.col(id_col).cast("long").alias(id_col), "url").mapInArrow(run, f"{id_col} long, url string, block_probability double")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and block_probability. ``labelled`` (url, blocked, origin) are the labelled URLs;
    without it, the pages that a rule decides are, by rule."""
    host, path = host_and_path(F.col("url"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    parsed = lambda df: df.withColumn("host", host).withColumn("path", path).withColumn("rule", rule).withColumn("decided", verdict)
    if labelled is None:
        labelled = parsed(pages.select("url")).where("decided is not null").select("url", (F.col("decided") == "block").cast("int").alias("blocked"), F.col("rule").alias("origin"))
    model, threshold = train(labelled)
    scored = score(pages, model)
    by_model = F.when(F.col("block_probability") >= threshold, "block").otherwise("allow") if threshold is not None else F.lit("allow")
    return parsed(scored).select("page_id", "host", "path", "rule", F.coalesce("decided", by_model).alias("verdict"), "block_probability")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"))
