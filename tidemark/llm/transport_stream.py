"""MPEG transport streams as a media column: write a payload into packets, and parse, check and reassemble it again.

A stream has one program with one private elementary stream. Every access unit is a PES packet with a
presentation time stamp; every eighth one is a random-access point and carries a clock reference. Reading follows the
program tables (with their CRC), checks continuity counters and gathers elementary packets.

Nulls and odd rows: a null text is an empty one, whose payload is one block of spaces. Repeated rows give equal streams, and ties (equal texts
under any ids) too. A very long text is one stream of as many access units as it needs, held in the memory of its task. Rows are independent; empty tables give no rows; other columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches

#: The payload is padded with spaces to a multiple of this.
BLOCK = 192
UNIT = 16 * BLOCK
CLOCK = 90_000
#: Clock ticks from one access unit to the next, and units from one random-access point to the next.
TICKS, GROUP = CLOCK // 25, 8
PMT_PID, STREAM_PID, PRIVATE_PES = 0x100, 0x101, 0x06


@functools.cache
def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


@functools.lru_cache(1024)
def section_crc(section: bytes) -> int:
    """The CRC of program tables: 32 bits, most significant bit first, zero over a section that ends with its own CRC."""
    crc = 0xFFFFFFFF
    for byte in section:
        crc = (crc << 8 & 0xFFFFFFFF) ^ _crc_table()[crc >> 24 ^ byte]
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    length = len(body) + 9
    head = bytes([table, 0xB0 | length >> 8, length & 255, number >> 8, number & 255, 0xC1, 0, 0])
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(188, b"\xff")


def _stamp(mark: int, ticks: int) -> bytes:
    return bytes([mark << 4 | ticks >> 29 & 14 | 1, ticks >> 22 & 255, ticks >> 14 & 254 | 1, ticks >> 7 & 255, ticks << 1 & 254 | 1])


@functools.cache
def _tables() -> bytes:
    association = _section(0x00, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))
    clock = bytes([0xE0 | STREAM_PID >> 8, STREAM_PID & 255, 0xF0, 0])
    streams = bytes([PRIVATE_PES, 0xE0 | STREAM_PID >> 8, STREAM_PID & 255, 0xF0, 0])
    return _table_packet(0, association) + _table_packet(PMT_PID, _section(0x02, 1, clock + streams))


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b" ")


def mux(payload: bytes) -> bytes:
    """The transport stream that carries ``payload``."""
    packets = [_tables()]
    counter = 0
    for unit, at in enumerate(range(0, len(payload), UNIT)):
        data = payload[at : at + UNIT]
        ticks = unit * TICKS & 0x1FFFFFFFF
        # Private stream 1, aligned data, a presentation time stamp.
        pes = b"\x00\x00\x01\xbd" + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, ticks) + data
        access = unit % GROUP == 0
        field = b"\x50" + (ticks << 15 | 0x7E00).to_bytes(6, "big") if access else b""
        place = 0
        while place < len(pes):
            room = 184 - (len(field) + 1 if field else 0)
            part = pes[place : place + room]
            head = bytes([0x47, (0 if place else 0x40) | STREAM_PID >> 8, STREAM_PID & 255])
            if field or len(part) < 184:
                if not field and len(part) < 183:
                    field = b"\x00"
                field = field.ljust(183 - len(part), b"\xff")
                packets.append(head + bytes([0x30 | counter, len(field)]) + field + part)
            else:
                packets.append(head + bytes([0x10 | counter]) + part)
            counter = counter + 1 & 15
            place += len(part)
            field = b""
    return b"".join(packets)


def demux(stream: bytes) -> dict:
    """The payload of the first program's first stream, with what its packets say.

    Packets out of sync, marked as broken or of other PIDs are passed over; a gap in the continuity counter and a table with a wrong CRC
    are counted.
    """
    pmt = pid = None
    counter = None
    gaps = crc_errors = packets = 0
    units: list[list[bytes]] = []
    access: list[bool] = []
    for at in range(0, len(stream) - 187, 188):
        a, b, c, flags = stream[at], stream[at + 1], stream[at + 2], stream[at + 3]
        packets += 1
        if a != 0x47 or b & 0x80:
            continue
        which, begins, place, random = (b & 31) << 8 | c, b & 0x40, at + 4, False
        if flags & 0x20:
            random = stream[place] > 0 and bool(stream[place + 1] & 0x40)
            place += stream[place] + 1
        if not flags & 0x10:
            continue
        if which == pid:
            if counter is not None and flags & 15 != counter + 1 & 15:
                if flags & 15 == counter:  # sent twice
                    continue
                gaps += 1
            counter = flags & 15
            if begins:
                units.append([])
                access.append(random)
            if units:
                units[-1].append(stream[place : at + 188])
        elif begins and (which == 0 or which == pmt):
            start = place + 1 + stream[place]
            section = stream[start : start + 3 + ((stream[start + 1] & 15) << 8 | stream[start + 2])]
            if section_crc(section):
                crc_errors += 1
            elif which == 0:
                pmt = (section[10] & 31) << 8 | section[11]
            else:
                first = 12 + ((section[10] & 15) << 8 | section[11])
                pid = (section[first + 1] & 31) << 8 | section[first + 2]
    payload, stamps = [], []
    for parts in units:
        pes = b"".join(parts)
        s = pes[9:14]
        stamps.append((s[0] >> 1 & 7) << 30 | s[1] << 22 | s[2] >> 1 << 15 | s[3] << 7 | s[4] >> 1)
        payload.append(pes[9 + pes[8] : 6 + int.from_bytes(pes[4:6], "big")])
    return {
        "payload": b"".join(payload),
        "stream_pid": pid,
        "packets": packets,
        "continuity_gaps": gaps,
        "crc_errors": crc_errors,
        "timestamps": stamps,
        "random_access": [stamp for stamp, random in zip(stamps, access, strict=True) if random],
    }


STREAM = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, media binary, payload binary, stream_pid int, packets int, continuity_gaps int, crc_errors int, timestamps array<long>, random_access array<long>"


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        sizes = [len(t.encode()) if t else 0 for t in texts]
        media = pa.array([mux(padded(t)) for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), media], names=["doc_id", "n_bytes", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"payload": pa.binary(), "timestamps": pa.list_(pa.int64()), "random_access": pa.list_(pa.int64())}
    names = ["payload", "stream_pid", "packets", "continuity_gaps", "crc_errors", "timestamps", "random_access"]
    for batch in batches:
        rows = [demux(x) for x in batch.column(2).to_pylist()]
        columns = [pa.array([r[n] for r in rows], kinds.get(n, pa.int32())) for n in names]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])


def to_transport_streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded, as a transport stream."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_write, STREAM)


def read_transport_streams(streams: DataFrame) -> DataFrame:
    """The rows of ``to_transport_streams`` with what their stored bytes hold: payload, time stamps, random-access points and errors."""
    return streams.mapInArrow(_read, READ)


def stream_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the payload as read back and of the stored stream, and a feature string, for each row."""
    read = read_transport_streams(to_transport_streams(docs, id_col, text_col))
    stamps = F.col("timestamps")
    feature = F.format_string(
        "pid=%d;packets=%d;units=%d;pts=%d-%d;access=%d;gaps=%d;crc=%d",
        "stream_pid", "packets", F.size(stamps), F.element_at(stamps, 1), F.element_at(stamps, -1), F.size("random_access"), "continuity_gaps", "crc_errors",
    )
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
        F.size(stamps).alias("access_units"),
        F.size("random_access").alias("random_access_points"),
    )
