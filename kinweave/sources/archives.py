"""Readers of registry archives and spreadsheets as DataFrames; bad rows are kept apart with a reason.

Archives come by ``archive_source``: a member a task, streamed from its place in the file.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.session import ship
from kinweave.sources.archive_source import archive_rows, file_digest, files, open_file

BATCH = 5000


def zip_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Rows of all CSV members of zip archives: fields by stripped header, or the reason why a row has none.

    A member that lacks a required column fails. A member is a task, streamed (``archive_source``).
    """
    return archive_rows(spark, path, "csv", required)


def _text(name: str) -> Column:
    return F.nullif(F.trim(F.try_element_at("fields", F.lit(name))), F.lit(""))


def golden_copy(spark: SparkSession, path: str, country: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of LEI golden-copy archives; the country is filtered on the raw value, before anything else."""
    raw = zip_csv(spark, path, ("LEI", "Entity.LegalName"))
    raw = raw if country is None else raw.where(F.col("reason").isNotNull() | (F.try_element_at("fields", F.lit("Entity.LegalAddress.Country")) == country))
    reason = F.coalesce("reason", F.when(_text("LEI").isNull(), "missing_key").when(_text("Entity.LegalName").isNull(), "missing_name"))
    judged = raw.withColumn("reason", reason)
    lines = F.array_compact(F.array(_text("Entity.LegalAddress.FirstAddressLine"), *[_text(f"Entity.LegalAddress.AdditionalAddressLine.{k}") for k in (1, 2, 3)]))
    others = F.array_compact(F.array(*[_text(f"Entity.OtherEntityNames.OtherEntityName.{k}") for k in range(1, 6)]))
    good = judged.where("reason is null").select(
        _text("LEI").alias("source_key"), _text("Entity.LegalName").alias("name"), F.nullif(F.array_join(lines, ", "), F.lit("")).alias("address"), _text("Entity.LegalAddress.City").alias("city"), _text("Entity.LegalAddress.PostalCode").alias("postcode"),
        _text("Entity.LegalAddress.Country").alias("country"), others.alias("aliases"), _text("Entity.RegistrationAuthority.RegistrationAuthorityID").alias("registration_authority"), _text("Entity.RegistrationAuthority.RegistrationAuthorityEntityID").alias("registration_number"),
        _text("LEI").alias("lei"), _text("Entity.EntityCategory").alias("category"), _text("Entity.EntityStatus").alias("status"), _text("Registration.RegistrationStatus").alias("registration_status"),
    )
    return good, judged.where("reason is not null").select("archive", "member", "line", "reason")


def national_register(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of register archives: structure, then name, then number decide a rejection; numbers stay text."""
    from kinweave.functions.normalize import company_number, register_country

    raw = zip_csv(spark, path, ("CompanyName", "CompanyNumber"))
    number = company_number(_text("CompanyNumber"))
    judged = raw.withColumn("number", number).withColumn("reason", F.coalesce("reason", F.when(_text("CompanyName").isNull(), "missing_name").when(F.col("number").isNull(), "invalid_number")))
    lines = F.array_compact(F.array(_text("RegAddress.AddressLine1"), _text("RegAddress.AddressLine2")))
    before = F.array_compact(F.array(*[F.when(_text(f"PreviousName_{k}.CompanyName").isNotNull(), F.struct(_text(f"PreviousName_{k}.CompanyName").alias("name"), _text(f"PreviousName_{k}.CONDATE").alias("until"))) for k in range(1, 11)]))
    good = judged.where("reason is null").select(
        F.col("number").alias("source_key"), _text("CompanyName").alias("name"), F.nullif(F.array_join(lines, ", "), F.lit("")).alias("address"), _text("RegAddress.PostTown").alias("city"), _text("RegAddress.PostCode").alias("postcode"),
        F.coalesce(register_country(_text("RegAddress.Country")), _text("RegAddress.Country")).alias("country"), before.alias("previous_names"), F.col("number").alias("registration_number"), _text("CompanyCategory").alias("category"), _text("CompanyStatus").alias("status"),
    )
    return good, judged.where("reason is not null").select("archive", "member", "line", "reason")


def lei_json(spark: SparkSession, path: str) -> DataFrame:
    """Flat records from JSON objects of the LEI interface, one a line."""
    entity = "struct<legalName:struct<name:string>,legalAddress:struct<addressLines:array<string>,city:string,postalCode:string,country:string>,otherNames:array<struct<name:string>>,registeredAt:struct<id:string>,registeredAs:string,category:string,status:string>"
    raw = spark.read.schema(f"id string, attributes struct<lei:string,entity:{entity},registration:struct<status:string>>").json(path)
    e = "attributes.entity."
    return raw.select(
        F.coalesce("attributes.lei", "id").alias("source_key"), F.col(e + "legalName.name").alias("name"), F.array_join(e + "legalAddress.addressLines", ", ").alias("address"), F.col(e + "legalAddress.city").alias("city"), F.col(e + "legalAddress.postalCode").alias("postcode"),
        F.col(e + "legalAddress.country").alias("country"), F.transform(e + "otherNames", lambda x: x["name"]).alias("aliases"), F.col(e + "registeredAt.id").alias("registration_authority"), F.col(e + "registeredAs").alias("registration_number"),
        F.col("attributes.lei").alias("lei"), F.col(e + "category").alias("category"), F.col(e + "status").alias("status"), F.col("attributes.registration.status").alias("registration_status"),
    )


def label_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless lines of two ids and true or false; a malformed line fails."""
    raw = spark.read.schema("left string, right string, same string").option("mode", "FAILFAST").csv(path)
    label = F.when(F.lower("same") == "true", 1).when(F.lower("same") == "false", 0).otherwise(F.raise_error(F.concat(F.lit("label: "), F.coalesce("same", F.lit("missing")))).cast("int"))
    return raw.select("left", "right", label.alias("label"))


def pair_tables(spark: SparkSession, root: str, columns: str, pinned: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(table A, table B, labelled pairs with original_split) of a public pair benchmark; malformed rows fail, and so do files
    that have another SHA-256 than ``pinned`` (by name) says."""
    if pinned is not None:
        bad = sorted(r["name"] for r in verify_hashes(spark, root, pinned).where("not ok").collect())
        if bad:
            raise ValueError(f"not as pinned: {bad}")
    read = lambda schema, name: spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(f"{root}/{name}.csv")
    pairs = None
    for name in ("train", "valid", "test"):
        part = read("ltable_id string, rtable_id string, label int", name).select(F.concat(F.lit("a:"), "ltable_id").alias("left"), F.concat(F.lit("b:"), "rtable_id").alias("right"), "label", F.lit("validation" if name == "valid" else name).alias("original_split"))
        pairs = part if pairs is None else pairs.union(part)
    return read(columns, "tableA"), read(columns, "tableB"), pairs


def nested_jsonl(spark: SparkSession, path: str, schema: str, most_bytes: int = 80_000_000, most_rows: int = 25_000) -> DataFrame:
    """Rows of gzipped JSON-lines members inside zip archives; a member over the bounds fails rather than being cut."""
    lines = archive_rows(spark, path, "jsonl", mostBytes=most_bytes, mostRows=most_rows)
    return lines.select("member", F.from_json(F.element_at("fields", F.lit("json")), schema).alias("r")).select("member", "r.*")


def judged_pairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(judgements, tables, sheet) of one archive that holds all: tab-separated judgements, CSV tables, and a spreadsheet. Rows
    have their member and fields."""
    part = lambda kind, pattern: archive_rows(spark, path, kind, pattern=pattern)
    return part("tsv", "*GroundTruth.txt"), part("csv", "*.csv"), part("sheet", "*.xlsx")


# Names of the spreadsheet format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _sheet_path(book: zipfile.ZipFile, title: str | None) -> str:
    """The member of the sheet of this title, or of the first, by the workbook's relations; the first sheet by number
    where the workbook has none."""
    names = set(book.namelist())
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        targets = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for s in ET.fromstring(book.read("xl/workbook.xml")).iter(_MAIN + "sheet"):
            if title in (None, s.get("name")):
                target = targets[s.get(_LINK)]
                return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    sheets = sorted((int(m[1]), m[0]) for n in names if (m := re.fullmatch(r"xl/worksheets/sheet([0-9]+)\.xml", n)))
    if title is not None or not sheets:
        raise ValueError(f"the workbook has no sheet {title or ''}")
    return sheets[0][1]


def _column(reference: str | None, after: int) -> int:
    """Place of a cell such as ``AB12``, counted from 0; without a reference, the place behind the cell before."""
    letters = (reference or "").rstrip("0123456789")
    return sum((ord(c) - 64) * 26**k for k, c in enumerate(reversed(letters))) - 1 if letters else after


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return ["".join(t.text or "" for t in item.iter(_MAIN + "t")) for item in ET.fromstring(book.read("xl/sharedStrings.xml"))]


def workbook_rows(content, title: str | None = None) -> Iterator[list[str]]:
    """Rows of a workbook's sheet (the first, or by title) as texts, read event by event; missing cells are empty.
    ``content``: its bytes, or a file that can be read in any order."""
    with zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content) as book:
        shared, cells, place, kind, text = _shared(book), {}, -1, None, []
        for event, e in ET.iterparse(book.open(_sheet_path(book, title)), events=("start", "end")):
            tag = e.tag.removeprefix(_MAIN)
            if event == "start" and tag == "row":
                cells, place = {}, -1
            elif event == "start" and tag == "c":
                place, kind, text = _column(e.get("r"), place + 1), e.get("t"), []
            elif event == "end" and tag in ("v", "t"):
                text.append(e.text or "")
            elif event == "end" and tag == "c":
                value = "".join(text)
                cells[place] = shared[int(value)] if kind == "s" and value else value
            elif event == "end" and tag == "row":
                yield [cells.get(k, "") for k in range(max(cells, default=-1) + 1)]
                e.clear()


def workbook(spark: SparkSession, path: str, title: str | None = None) -> DataFrame:
    """(path, line, cells) of workbooks, a task a file, whose sheet (the first, or by title) is read in batches."""
    ship(spark)
    names = spark.createDataFrame([(f,) for f in files(path)], "path string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(name: str, first: int, rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(range(first, first + len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=["path", "line", "cells"])

        for b in batches:
            for name in b.column("path").to_pylist():
                held, n = [], 0
                with open_file(name) as f:
                    for row in workbook_rows(f, title):
                        held.append(row)
                        if len(held) == BATCH:
                            yield batch(name, n, held)
                            held, n = [], n + BATCH
                yield batch(name, n, held)

    return names.repartitionByRange(max(1, names.count()), "path").mapInArrow(run, "path string, line long, cells array<string>")


def verify_hashes(spark: SparkSession, path: str, expected: dict[str, str]) -> DataFrame:
    """(name, sha256, ok) of files against a manifest of names and hashes; a file not in the manifest is not ok."""
    known = spark.createDataFrame(list(expected.items()), "name string, wanted string")
    ship(spark)
    names = spark.createDataFrame([(f,) for f in files(path)], "path string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b.column("path").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([p.rsplit("/", 1)[-1] for p in paths], pa.string()), pa.array(list(map(file_digest, paths)), pa.string())], names=["name", "sha256"])

    found = names.repartitionByRange(max(1, names.count()), "path").mapInArrow(run, "name string, sha256 string")
    return found.join(known, "name", "full").select("name", "sha256", F.coalesce(F.col("sha256") == F.col("wanted"), F.lit(False)).alias("ok"))
