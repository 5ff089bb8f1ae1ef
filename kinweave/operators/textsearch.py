"""Literal search in short texts through a table of their character triples.

``postings`` has a row for each different triple of a value; sorted by triple within its files, a search reads only the row
groups that hold the triples it asks for. A value that has the query has all of the query's triples; the rarest few of them
choose the candidates, which are then verified. Queries under three characters have no triple and are answered by a scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, FEW = 3, 3  # characters of a triple; how many of a query's rarest choose candidates


def postings(values: DataFrame, keys: list[str], value: str = "value_folded") -> DataFrame:
    """(gram, keys) of the values, each told apart by ``keys``."""
    places = F.when(F.length(value) >= SIZE, F.sequence(F.lit(1), F.length(value) - (SIZE - 1)))
    grams = F.array_distinct(F.transform(places, lambda i: F.substr(F.col(value), i, F.lit(SIZE))))
    return values.select(F.explode(grams).alias("gram"), *keys)


def stored(rows: DataFrame) -> DataFrame:
    """Postings as they are to be written: ranges of triples, sorted; a common triple takes several files."""
    return rows.repartitionByRange("gram", *[c for c in rows.columns if c != "gram"]).sortWithinPartitions("gram")


def literal(values: DataFrame, table: DataFrame, keys: list[str], query: str, value: str = "value_folded") -> DataFrame:
    """The rows of ``values`` (keys, value) that hold the query as it is. ``table``: their postings."""
    hit = values.where(F.contains(value, F.lit(query)))
    asked = sorted({query[i : i + SIZE] for i in range(len(query) - SIZE + 1)})
    if not asked:
        return hit
    found = table.where(F.col("gram").isin(asked))
    counts = {r["gram"]: r["count"] for r in found.groupBy("gram").count().collect()}  # at most a row a triple of the query
    if len(counts) < len(asked):
        return values.where("false")
    rare = sorted(asked, key=lambda g: (counts[g], g))[:FEW]
    able = found.where(F.col("gram").isin(rare)).groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") == len(rare)).select(*keys)
    return hit.join(able, keys, "left_semi")
