"""Archives as a data source: members are tasks, streamed in bounded memory, with checksums and nested sheets."""

import gzip
import io
import tracemalloc
import zipfile

import pytest

from kinweave.sources import archive_source as A
from kinweave.sources import archives

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def sheet(rows):
    body = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{v}</t></is></c>' for v in r) + "</row>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


@pytest.fixture
def mixed(tmp_path):
    path = tmp_path / "mixed.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("Ground Truth/A-GroundTruth.txt", "﻿A_ID\tB_ID\tTYPE\n1\t2\tTP\n3\t4\tTN\n".encode())
        z.writestr("Data/a.csv", 'ID,NAME\n1,"one, with\na line"\n2\n')
        z.writestr(zipfile.ZipInfo("Data/b.CSV"), "ID,NAME\n9,stored\n")  # not deflated
        z.writestr("Data/s.xlsx", sheet([["LEI", "Name", "Note"], ["001", "Crédit 银行"], ["002", "x", "y"]]))
        z.writestr("Data/j.jsonl.gz", gzip.compress(b'{"a": 1}\n{"a": 2}\n'))
    return str(path)


def test_each_member_is_a_task_and_rows_are_as_written(spark, mixed):
    rows = archives.zip_csv(spark, mixed, ("ID",))
    assert rows.rdd.getNumPartitions() == 2
    got = {(r["member"], r["line"]): (r["fields"], r["reason"]) for r in rows.collect()}
    assert got[("Data/a.csv", 2)] == ({"ID": "1", "NAME": "one, with\na line"}, None)
    assert got[("Data/a.csv", 3)] == (None, "wrong_width") and got[("Data/b.CSV", 2)] == ({"ID": "9", "NAME": "stored"}, None)


def test_judgements_tables_and_a_sheet_of_one_archive(spark, mixed):
    judged, tables, cells = archives.judged_pairs(spark, mixed)
    assert sorted((r.fields["A_ID"], r.fields["B_ID"], r.fields["TYPE"]) for r in judged.collect()) == [("1", "2", "TP"), ("3", "4", "TN")]
    assert tables.where("reason is null").count() == 2
    assert sorted((r.fields["LEI"], r.fields["Name"], r.fields["Note"]) for r in cells.collect()) == [("001", "Crédit 银行", ""), ("002", "x", "y")]


def test_a_folder_of_archives_and_missing_columns(spark, tmp_path, mixed):
    with zipfile.ZipFile(tmp_path / "second.zip", "w") as z:
        z.writestr("c.csv", "ID\n5\n")
    assert archives.zip_csv(spark, str(tmp_path), ("ID",)).select("archive").distinct().count() == 2
    with pytest.raises(Exception, match="lacks"):
        archives.zip_csv(spark, str(tmp_path), ("NAME",)).count()


def test_damage_is_found(tmp_path):
    path = tmp_path / "d.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("x.csv", "ID\n" + "1\n" * 100)
    raw = bytearray(path.read_bytes())
    raw[raw.find(b"1\n1\n")] = ord("2")
    path.write_bytes(raw)
    with pytest.raises(ValueError, match="checksum"):
        A.opened(A.members(str(path), "*.csv")[0]).read()
    path.write_bytes(raw[:20] + raw[-200:])
    with pytest.raises((ValueError, EOFError, zipfile.BadZipFile, OSError)):
        A.opened(A.members(str(path), "*.csv")[0]).read()


@pytest.mark.parametrize("rows", [20_000, 400_000])
def test_memory_does_not_depend_on_the_member(tmp_path, rows):
    path = tmp_path / "big.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z, z.open("big.csv", "w") as f:
        f.write(b"ID,NAME\n")
        for k in range(0, rows, 1000):
            f.write(b"".join(b"%d,some name or other\n" % i for i in range(k, k + 1000)))
    reader = A.ArchiveReader({"path": str(path)})
    part = reader.partitions()[0]
    tracemalloc.start()
    n = sum(b.num_rows for b in reader.read(part))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == rows and peak < 12e6
