"""Media columns in Ogg: a writer and a reader of pages, packets and logical streams.

The payload (UTF-8 bytes and bytes 255 up to a positive multiple of 576) is cut into packets of BLOCK
8-bit samples, dealt in turn to two logical streams and multiplexed page by page. The reader verifies
every page's checksum, reassembles packets from lacing values across pages, demultiplexes by serial
number, checks page sequence numbers and derives each packet's time from granule positions; the packets
of all streams ordered by time are the payload.

Defined results: a null or empty text is one packet of 576 bytes 255; equal texts give equal bytes (the
serial numbers come from the payload), so repeated rows repeat. A very long text is many packets and pages. An empty table
gives an empty result; extra columns are not read. Damage raises OggError and never passes silently.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kinweave.llm.common import read_table, texts

UNIT, BLOCK, STREAMS, RATE = 576, 4608, 2, 8000
PAGE_SEGMENTS = 40  # lacing values of a page, so that packets run on over pages
CONTINUED, FIRST, LAST = 1, 2, 4  # header flags fixed by the format
HEADER = struct.Struct("<4sBBqIIIB")  # fixed by the format: capture, version, flags, granule, serial, sequence, checksum, segments
NO_GRANULE = -1  # no packet ends on the page
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    pass


def _reverse32(x: int) -> int:
    return int.from_bytes(x.to_bytes(4, "little").translate(_REVERSED), "big")


def page_checksum(page: bytes) -> int:
    """The format's CRC-32: polynomial 0x04C11DB7, most significant bit first, no inversion. With every byte
    and the result bit-reversed it is the common CRC-32 without its inversions, which zlib computes."""
    return _reverse32(zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF)


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    check = page_checksum(head + body)
    return head[:22] + struct.pack("<I", check) + head[26:] + body


def _pages(packets: list[tuple[int, bytes]], serial: int) -> Iterator[tuple[int, bytes]]:
    """Pages of one logical stream; packets come with the granule position at their end. Each page with a sort key."""
    lacing, body, number, granule, carried, key = bytearray(), bytearray(), 0, NO_GRANULE, False, 0

    def close(last: bool) -> tuple[int, bytes]:
        nonlocal lacing, body, number, granule
        flags = CONTINUED * carried | FIRST * (number == 0) | LAST * last
        page = _page(flags, granule, serial, number, bytes(lacing), bytes(body))
        lacing, body, number, granule = bytearray(), bytearray(), number + 1, NO_GRANULE
        return key, page

    for n, (end, data) in enumerate(packets):
        sizes = [255] * (len(data) // 255) + [len(data) % 255]
        at = 0
        for i, size in enumerate(sizes):
            if len(lacing) == PAGE_SEGMENTS:
                yield close(False)
                carried = i > 0
            lacing.append(size)
            body += data[at : at + size]
            at += size
        granule, key = end, end
    yield close(True)


def mux(payload: bytes, streams: int = STREAMS, block: int = BLOCK) -> bytes:
    """One physical stream with the payload's blocks dealt in turn to the logical streams; a stream's granule
    position counts its own samples."""
    seed = int.from_bytes(hashlib.sha256(payload).digest()[:4], "little")
    dealt: list[list[tuple[int, bytes]]] = [[] for _ in range(streams)]
    ends = [0] * streams
    for n, at in enumerate(range(0, len(payload), block)):
        data = payload[at : at + block]
        ends[n % streams] += len(data)
        dealt[n % streams].append((ends[n % streams], data))
    pages = [(k, s, p) for s, packets in enumerate(dealt) if packets for k, p in _pages(packets, (seed + s) & 0xFFFFFFFF)]
    firsts, rest, seen = [], [], set()
    for k, s, p in pages:
        (rest if s in seen else firsts).append((k, s, p))
        seen.add(s)
    rest.sort(key=lambda x: x[:2])  # stable: pages of a stream stay in order
    return b"".join(p for _, _, p in firsts + rest)


def read_pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(flags, granule, serial, sequence number, lacing, body) of each page, checksums verified."""
    at = 0
    while at < len(data):
        if len(data) - at < HEADER.size:
            raise OggError(f"cut off in a page header at byte {at}")
        magic, version, flags, granule, serial, number, check, segments = HEADER.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        body_at = at + HEADER.size + segments
        lacing = data[at + HEADER.size : body_at]
        end = body_at + sum(lacing)
        if len(lacing) < segments or end > len(data):
            raise OggError(f"cut off in a page at byte {at}")
        if page_checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != check:
            raise OggError(f"checksum of the page at byte {at}")
        yield flags, granule, serial, number, lacing, data[body_at:end]
        at = end


class LogicalStream:
    """Packets of one serial number with the times they start at, in samples."""

    def __init__(self) -> None:
        self.packets: list[tuple[int, bytes]] = []
        self.pages, self.granule, self.ended = 0, 0, False
        self._part, self._open = bytearray(), False

    def add(self, flags: int, granule: int, number: int, lacing: bytes, body: bytes) -> None:
        if self.ended or number != self.pages or bool(flags & FIRST) != (number == 0):
            raise OggError("a page is out of order")
        if bool(flags & CONTINUED) != self._open:
            raise OggError("a continued packet lacks its other part")
        self.pages, self.ended, at, done = number + 1, bool(flags & LAST), 0, []
        for size in lacing:
            self._part += body[at : at + size]
            at += size
            self._open = size == 255
            if not self._open:
                done.append(bytes(self._part))
                self._part = bytearray()
        if bool(done) == (granule == NO_GRANULE):
            raise OggError("granule position and packet ends disagree")
        if done:  # the position is the time at the last packet's end; a packet lasts a sample a byte
            start = granule - sum(map(len, done))
            if start != self.granule:
                raise OggError("granule positions leave a gap")
            for packet in done:
                self.packets.append((start, packet))
                start += len(packet)
            self.granule = granule

    def close(self) -> None:
        if self._open or not self.ended:
            raise OggError("a logical stream does not end")


def demux(data: bytes) -> dict[int, LogicalStream]:
    """The logical streams by serial number, in the order of their first pages."""
    streams: dict[int, LogicalStream] = {}
    for flags, granule, serial, number, lacing, body in read_pages(data):
        streams.setdefault(serial, LogicalStream()).add(flags, granule, number, lacing, body)
    for s in streams.values():
        s.close()
    return streams


def payload_of(streams: dict[int, LogicalStream]) -> bytes:
    """Packets of all streams by time; at one time, by the order of the streams."""
    timed = [(t, n, p) for n, s in enumerate(streams.values()) for t, p in s.packets]
    timed.sort(key=lambda x: x[:2])
    return b"".join(p for _, _, p in timed)


def padded(utf8: bytes, unit: int = UNIT) -> bytes:
    return utf8 + b"\xff" * (-len(utf8) % unit if utf8 else unit)


def features(streams: dict[int, LogicalStream], payload: bytes) -> str:
    total = sum(s.granule for s in streams.values())
    seconds = max((s.granule for s in streams.values()), default=0) / RATE
    return f"codec=pcm8;rate={RATE};streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={sum(len(s.packets) for s in streams.values())};samples={total};seconds={seconds:.6f};mean={sum(payload) / max(1, len(payload)):.6f};low={min(payload, default=0)};high={max(payload, default=0)}"


RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_and_read(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Each text stored as an Ogg file and read back; keep_media adds the stored bytes as ``media``. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for value in b.column("text"):
                utf8 = value.as_py().encode()
                media = mux(padded(utf8))
                streams = demux(media)
                back = payload_of(streams)
                rows.append((len(utf8), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(streams, back), media))
            cols = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
            n = 8 if keep_media else 7
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols[:n], kinds))], names=["doc_id", *names[:n]])

    src = texts(docs)
    return src.select(src.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT + (", media binary" if keep_media else ""))


def op10_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read(read_table(spark, sf_dir, "documents"))
