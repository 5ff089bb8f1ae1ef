"""Archives as a Spark data source: a partition a member, streamed from its place in the file.

Planning reads the archives' central directories only. A partition knows where its member starts, how long it is and how it is
packed, so its task opens the file there and inflates it in pieces; no task holds an archive or a member, and a damaged
member fails by its checksum. A spreadsheet inside an archive is itself an archive, which must be read in any order: it
goes to a temporary file of its task, its sheet is then read event by event.

Files are opened where the tasks run, by pyarrow's file systems: local or mounted paths, and the stores whose drivers that
library has. Python tasks have no access to Spark's own file systems.
"""

from __future__ import annotations

import csv
import fnmatch
import gzip
import hashlib
import io
import struct
import tempfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kinweave.session import ship

ROW = "archive string, member string, line long, fields map<string,string>, reason string"
_ARROW = pa.schema([("archive", pa.string()), ("member", pa.string()), ("line", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("reason", pa.string())])
BATCH_ROWS, PIECE = 5000, 1 << 18
# Fixed values of the format: a member's local header, and the ways to pack it that are read here.
_LOCAL, _SIGNATURE, STORED, DEFLATED = "<4s5H3I2H", b"PK\x03\x04", 0, 8


def file_digest(path: str) -> str:
    """SHA-256 of a file, read in pieces."""
    h = hashlib.sha256()
    with open_file(path) as f:
        while piece := f.read(PIECE):
            h.update(piece)
    return h.hexdigest()


@dataclass
class Member(InputPartition):
    archive: str
    name: str
    offset: int
    packed: int
    method: int
    crc: int
    flags: int


def open_file(path: str):
    """A file that can be read in any order, wherever it lies."""
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def files(path: str) -> list[str]:
    """The file at ``path``, or those in the folder of that path."""
    store, inner = fs.FileSystem.from_uri(path)
    found = store.get_file_info(inner)
    if found.type == fs.FileType.Directory:
        scheme = path.split("://", 1)[0] + "://" if "://" in path and not path.startswith("file:") else ""
        return sorted(scheme + i.path for i in store.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")))
    return [path]


def members(path: str, pattern: str) -> list[Member]:
    """The members whose names fit the pattern, from the archive's central directory."""
    with zipfile.ZipFile(open_file(path)) as z:
        return [Member(path, i.filename, i.header_offset, i.compress_size, i.compress_type, i.CRC, i.flag_bits) for i in z.infolist() if not i.is_dir() and fnmatch.fnmatch(i.filename.lower(), pattern.lower())]


class Stream(io.RawIOBase):
    """A member's bytes, inflated while they are read."""

    def __init__(self, m: Member) -> None:
        if m.method not in (STORED, DEFLATED) or m.flags & 1:
            raise ValueError(f"{m.archive}!{m.name} is packed in a way that isn't read here")
        self.m, self.file = m, open_file(m.archive)
        self.file.seek(m.offset)
        head = struct.unpack(_LOCAL, self.file.read(struct.calcsize(_LOCAL)))
        if head[0] != _SIGNATURE:
            raise ValueError(f"{m.archive}!{m.name} is not where the directory says")
        self.file.seek(m.offset + struct.calcsize(_LOCAL) + head[-2] + head[-1])
        self.left, self.crc, self.held = m.packed, 0, b""
        self.inflate = zlib.decompressobj(-15) if m.method == DEFLATED else None

    def readable(self) -> bool:
        return True

    def _more(self) -> bytes:
        """The next bytes, at most about PIECE; none at the end, where the checksum must hold."""
        while True:
            if self.inflate is not None and self.inflate.unconsumed_tail:
                out = self.inflate.decompress(self.inflate.unconsumed_tail, PIECE)
            elif self.left:
                raw = self.file.read(min(PIECE, self.left))
                if not raw:
                    raise EOFError(f"{self.m.archive}!{self.m.name} ends early")
                self.left -= len(raw)
                out = raw if self.inflate is None else self.inflate.decompress(raw, PIECE)
            else:
                out = b"" if self.inflate is None or self.inflate.eof else self.inflate.flush()
                if not out:
                    if self.crc != self.m.crc:
                        raise ValueError(f"{self.m.archive}!{self.m.name} does not match its checksum")
                    return b""
            if out:
                self.crc = zlib.crc32(out, self.crc)
                return out

    def readinto(self, into) -> int:
        if not self.held:
            self.held = self._more()
        n = min(len(into), len(self.held))
        into[:n], self.held = self.held[:n], self.held[n:]
        return n

    def close(self) -> None:
        if not self.closed:
            self.file.close()
        super().close()


def opened(m: Member) -> io.BufferedReader:
    return io.BufferedReader(Stream(m), PIECE)


Row = tuple[int, dict[str, str] | None, str | None]


def table_rows(lines: Iterator[list[str]], required: tuple[str, ...], where: str, first: int) -> Iterator[Row]:
    """Rows by stripped header, or the reason why a row has none. A header without a required column fails."""
    header = [h.strip() for h in next(lines, [])]
    if missing := [c for c in required if c not in header]:
        raise ValueError(f"{where} lacks {missing}")
    for n, row in enumerate(lines, first):
        yield (n, dict(zip(header, row)), None) if len(row) == len(header) else (n, None, "wrong_width")


def json_lines(stream: io.BufferedIOBase, most_bytes: int, most_rows: int, where: str) -> Iterator[Row]:
    """Lines as they are; a member over the bounds fails rather than being cut."""
    import json

    size = 0
    for n, line in enumerate(stream, 1):
        size += len(line)
        if size > most_bytes or n > most_rows:
            raise ValueError(f"{where} is over its bounds")
        json.loads(line)
        yield n, {"json": line.decode().rstrip("\n")}, None


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.kind = options["path"], options.get("kind", "csv")
        self.pattern = options.get("pattern", {"csv": "*.csv", "tsv": "*.t[sx][vt]", "jsonl": "*.gz", "sheet": "*.xlsx"}[self.kind])
        self.required = tuple(c for c in options.get("required", "").split("\n") if c)
        self.sheet = options.get("sheet")
        self.most_bytes, self.most_rows = int(options.get("mostbytes", 1 << 62)), int(options.get("mostrows", 1 << 62))

    def partitions(self) -> list[Member]:
        return [m for f in files(self.path) for m in members(f, self.pattern)]

    def rows(self, m: Member) -> Iterator[Row]:
        where = f"{m.archive}!{m.name}"
        with opened(m) as stream:
            if self.kind in ("csv", "tsv"):
                text = io.TextIOWrapper(stream, "utf-8-sig", errors="replace", newline="")
                yield from table_rows(csv.reader(text, delimiter="\t" if self.kind == "tsv" else ","), self.required, where, 2)
            elif self.kind == "jsonl":
                yield from json_lines(gzip.open(stream) if m.name.endswith(".gz") else stream, self.most_bytes, self.most_rows, where)
            else:
                from kinweave.sources.archives import workbook_rows

                with tempfile.TemporaryFile() as held:
                    while piece := stream.read(PIECE):
                        held.write(piece)
                    yield from table_rows(_filled(workbook_rows(held, self.sheet)), self.required, where, 2)

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for n, fields, reason in self.rows(partition):
            held.append((partition.archive, partition.name, n, None if fields is None else list(fields.items()), reason))
            if len(held) >= BATCH_ROWS:
                yield _batch(held)
                held = []
        yield _batch(held)


def _filled(rows: Iterator[list[str]]) -> Iterator[list[str]]:
    """Rows of a sheet: cells missing at a row's end are empty ones."""
    head = next(rows, [])
    yield head
    for r in rows:
        yield r + [""] * (len(head) - len(r))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)


class ArchiveSource(DataSource):
    """``spark.read.format("archive")``: options path (a file or a folder), kind (csv, tsv, jsonl, sheet), pattern of
    members, required columns (one a line), sheet (a title), mostBytes and mostRows of a JSON-lines member."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def archive_rows(spark: SparkSession, path: str, kind: str = "csv", required: tuple[str, ...] = (), **options: str | int) -> DataFrame:
    """(archive, member, line, fields, reason) of all fitting members of the archives at ``path``, a task a member."""
    ship(spark)
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").options(path=path, kind=kind, required="\n".join(required), **options).load()
