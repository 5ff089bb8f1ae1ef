"""Normalizing scalars of records: native expressions; Python only for texts that need NFKC."""

from __future__ import annotations

import hmac
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_FIELDS = ("name", "address", "city", "postcode", "country")
MATCHER_COLUMNS = ("record_id", "record_version_id", "source", *TEXT_FIELDS)
# Country names of a national register and the codes they stand for.
REGISTER_COUNTRIES = {
    "ENGLAND": "GB", "WALES": "GB", "SCOTLAND": "GB", "NORTHERN IRELAND": "GB", "UNITED KINGDOM": "GB", "GREAT BRITAIN": "GB",
    "JERSEY": "JE", "GUERNSEY": "GG", "ISLE OF MAN": "IM", "PANAMA": "PA", "CAYMAN ISLANDS": "KY", "AUSTRALIA": "AU",
}


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def _folded(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else x.casefold())


def compatible(value: Column | str) -> Column:
    """NFKC of the text; ASCII rows never reach Python's normalizer (it gets null for them)."""
    c = _column(value)
    ascii_only = c.rlike(r"^[\x00-\x7F]*$")
    return F.when(ascii_only | c.isNull(), c).otherwise(_nfkc(F.when(~ascii_only, c)))


def normalize_text(value: Column | str, nfkc: bool = True) -> Column:
    """NFKC, upper case, every character that is neither word nor space a space, spaces collapsed; empty is null."""
    c = compatible(value) if nfkc else _column(value)
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.upper(c), r"(?U)[^\w\s]", " "), r"(?U)\s+", " ")), F.lit(""))


def normalize_postcode(value: Column | str) -> Column:
    return F.nullif(F.regexp_replace(normalize_text(value), r"(?U)\s+", ""), F.lit(""))


def compact(value: Column | str) -> Column:
    """Upper-case letters A-Z and digits only."""
    return F.regexp_replace(F.upper(_column(value)), "[^A-Z0-9]", "")


def redacted(value: Column | str, *identifiers: Column | str) -> Column:
    """Null if the compacted value contains one of the record's own compacted identifiers."""
    c, hit = _column(value), F.lit(False)
    for i in identifiers:
        key = compact(i)
        hit = hit | F.coalesce((F.length(key) > 0) & F.contains(compact(c), key), F.lit(False))
    return F.when(~hit, c)


def matcher_view(df, number: str = "registration_number", lei: str = "lei"):
    """The eight matcher columns: normalized, redacted of own identifiers, empty as null."""
    def field(name: str) -> Column:
        norm = normalize_postcode(name) if name == "postcode" else normalize_text(name)
        return redacted(norm, number, lei).alias(name)

    return df.select("record_id", "record_version_id", "source", *map(field, TEXT_FIELDS))


def company_number(value: Column | str) -> Column:
    c = F.upper(F.trim(_column(value)))
    return F.when(c.rlike("^[A-Z0-9]{8}$"), c)


def register_country(value: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in REGISTER_COUNTRIES.items() for x in kv])
    return F.try_element_at(table, F.upper(F.trim(_column(value))))


def country_aliases(rows):
    """(alias, code) from (code, alias) rows; aliases of several codes are ambiguous and dropped."""
    named = rows.select(F.upper(F.trim("alias")).alias("alias"), "code").where("alias <> ''").distinct()
    return named.groupBy("alias").agg(F.count("*").alias("n"), F.min("code").alias("code")).where("n = 1").select("alias", "code")


def country_key(df, column: str, aliases):
    """``df`` with ``country_key``: iso:XX by exact alias, unrecognized:VALUE otherwise, null for none.

    Spark broadcasts the alias table if it is small, as that of the ISO countries is.
    """
    value = F.upper(F.trim(F.col(column)))
    joined = df.withColumn("__alias", value).join(aliases.withColumnRenamed("alias", "__alias").withColumnRenamed("code", "__code"), "__alias", "left")
    key = F.when(F.col("__code").isNotNull(), F.concat(F.lit("iso:"), "__code")).when(F.col("__alias") != "", F.concat(F.lit("unrecognized:"), "__alias"))
    return joined.withColumn("country_key", key).drop("__alias", "__code")


def country_view(records, aliases):
    """Records for retrieval alone: their country is its key, so that spellings of one country meet. Scores are made from the
    records as they are."""
    return country_key(records, "country", aliases).withColumn("country", F.col("country_key")).select(*records.columns)


def casefold(value: Column | str) -> Column:
    """Full case folding for search: letters that differ by case alone are one, whatever their place in a word, and those
    that fold to several are these. ASCII rows never reach Python (it gets null for them)."""
    c = _column(value)
    ascii_only = c.rlike(r"^[\x00-\x7F]*$")
    return F.when(ascii_only | c.isNull(), F.lower(c)).otherwise(_folded(F.when(~ascii_only, c)))


def serialize_record(fields: list[str]) -> Column:
    """``COL f VAL v`` of the given fields, markers inside values escaped; nulls left out."""
    def one(f: str) -> Column:
        v = F.regexp_replace(F.col(f), r"\b(COL|VAL)\b", r"_$1_")
        return F.when(F.col(f).isNotNull(), F.concat(F.lit(f"COL {f} VAL "), v))

    return F.concat_ws(" ", *map(one, fields))


def exclusion_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, in order; null if none does."""
    out = F.lit(None).cast("string")
    for name, test in reversed(rules):
        out = F.when(test, name).otherwise(out)
    return out


def opaque_id(*parts: Column | str, prefix: str = "") -> Column:
    """A stable id by the hash of the parts; nulls and empties differ."""
    return F.concat(F.lit(prefix), F.sha2(F.to_json(F.struct(*[_column(p).alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256))


def keyed_id(spark, secret: str, *parts: Column | str, prefix: str = "") -> Column:
    """A stable id that only a holder of the secret can make: HMAC-SHA-256 of the parts; nulls and empties differ. The secret goes
    to the tasks as a broadcast, so that it stands in no plan and no event log."""
    key = spark.sparkContext.broadcast(secret.encode())

    @F.pandas_udf(T.StringType())
    def code(values: pd.Series) -> pd.Series:
        return values.map(lambda v: hmac.new(key.value, v.encode(), "sha256").hexdigest())

    return F.concat(F.lit(prefix), code(F.to_json(F.struct(*[_column(p).alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"})))


def content_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's canonical JSON: keys sorted, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def price(value: Column | str) -> Column:
    """A finite positive decimal or null."""
    c = F.trim(_column(value))
    number = F.when(c.rlike(r"^[0-9]+(\.[0-9]+)?$"), c.try_cast("double"))
    return F.when((number > 0) & (number < float("inf")), number)


def formula_guard(value: Column | str) -> Column:
    """A leading = + - @ tab or return gets a quote, so that no spreadsheet runs it."""
    c = _column(value)
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def hash_fraction(value: Column | str) -> Column:
    """First 64 bits of SHA-256 as an exact decimal in 0..2^64-1."""
    return F.conv(F.substring(F.sha2(_column(value), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def entity_split(value: Column | str) -> Column:
    """train, validation, test: 60/20/20 by the hash of the entity."""
    part = hash_fraction(value) / F.lit(str(2**64)).cast("decimal(20,0)")
    return F.when(part < 0.6, "train").when(part < 0.8, "validation").otherwise("test")


def component_split(value: Column | str, bounds: tuple[tuple[int, str], ...] = ((60, "train"), (80, "validation"), (100, "test"))) -> Column:
    """By the hash modulo 100; the first bound above it names the split."""
    part, out = F.pmod(hash_fraction(value), F.lit(100).cast("decimal(20,0)")), F.lit(bounds[-1][1])
    for bound, name in reversed(bounds[:-1]):
        out = F.when(part < bound, name).otherwise(out)
    return out
