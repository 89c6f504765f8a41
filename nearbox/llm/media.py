"""Media columns in MPEG transport streams.

`mux` stores a payload as one elementary stream of private data in transport packets of 188 bytes: a program
association table, a program map table, then an access unit for each 3,072 bytes (16 units of 192), each in a packetised
elementary stream (PES) packet with a presentation timestamp. Every eighth access unit is a random-access point: its
first packet has the random-access indicator and a program clock reference.

`demux` reads any such stream back: it follows the tables from packet 0 to the stream's packet id, checks the sections'
CRC and the continuity counters, drops repeated packets, reassembles the PES packets, and returns the payload with
timestamps and random-access points. All of it works on arrays of packets; only PES packets are looped over.

Defined cases: a null text is the empty text; texts are padded with spaces to a positive multiple of 192 bytes; equal
texts give equal rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET, UNIT, ACCESS_UNIT = 188, 192, 16 * 192
PMT_PID, ES_PID, PROGRAM, STREAM_TYPE, STREAM_ID = 0x1000, 0x0100, 1, 0x06, 0xBD
CLOCK, FRAME, RAP_EVERY = 90_000, 3_600, 8


def crc32_mpeg(data: bytes) -> int:
    """The CRC of program tables: polynomial 04C11DB7, most significant bit first, no final inversion."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + bytes([0xC1, 0, 0]) + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def table_packet(pid: int, data: bytes) -> bytes:
    return (bytes([0x47]) + (0x4000 | pid).to_bytes(2, "big") + bytes([0x10, 0]) + data).ljust(PACKET, b"\xff")


TABLES = table_packet(0, section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + table_packet(
    PMT_PID, section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (-len(raw) % UNIT if raw else UNIT)


def mux(payload: bytes) -> bytes:
    parts, counter = [TABLES], 0
    for n, at in enumerate(range(0, len(payload), ACCESS_UNIT)):
        data, pts = payload[at : at + ACCESS_UNIT], (n * FRAME) & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp(pts) + data
        # Adaptation of the first packet (clock and random access) and of the last one (stuffing).
        first = b"\x07\x50" + (pts << 15 | 0x7E00).to_bytes(6, "big") if n % RAP_EVERY == 0 else b""
        packets = -(-(len(pes) + len(first)) // 184)
        room = packets * 184 - len(pes) - len(first)
        out = np.empty((packets, PACKET), np.uint8)
        out[:, 0], out[:, 1], out[:, 2] = 0x47, ES_PID >> 8, ES_PID & 0xFF
        out[0, 1] |= 0x40
        out[:, 3] = 0x10 | (counter + np.arange(packets)) & 15
        body = bytearray(pes)
        if room:
            last = bytes([room - 1]) + (b"\x00" + b"\xff" * (room - 2) if room > 1 else b"")
            if packets == 1 and first:
                first = bytes([7 + room]) + first[1:] + b"\xff" * room
            elif packets == 1:
                first = last
            else:
                body[(packets - 1) * 184 - len(first) : (packets - 1) * 184 - len(first)] = last
                out[-1, 3] |= 0x20
        if first:
            out[0, 3] |= 0x20
        out[:, 4:] = np.frombuffer(bytes(first + body), np.uint8).reshape(packets, 184)
        counter = (counter + packets) & 15
        parts.append(out.tobytes())
    return b"".join(parts)


@dataclass
class Demuxed:
    payload: bytes
    program_map: int = 0
    pid: int = 0
    stream_type: int = 0
    packets: int = 0
    continuity_errors: int = 0
    bad_sections: int = 0
    pts: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)

    def feature(self) -> str:
        return (
            f"pmt={self.program_map};pid={self.pid};type={self.stream_type};packets={self.packets};cc_errors={self.continuity_errors};bad_sections={self.bad_sections};"
            f"pes={len(self.pts)};pts={self.pts[0] if self.pts else -1}-{self.pts[-1] if self.pts else -1};rap={'/'.join(map(str, self.random_access))}"
        )


def read_section(rows: np.ndarray, offsets: np.ndarray, pid: np.ndarray, wanted: int, table_id: int) -> tuple[bytes, int]:
    """The body of the first good section with this packet id and table, and how many bad ones came before.

    A section may go over any number of packets; where the next one begins, it ends with the bytes before the pointer.
    """
    bad = 0
    own = np.flatnonzero((pid == wanted) & (offsets < PACKET))
    starting = rows[own, 1] & 0x40 > 0
    for n in np.flatnonzero(starting):
        data = rows[own[n], offsets[own[n]] :].tobytes()
        data = data[1 + data[0] :]
        for m in range(n + 1, len(own)):
            if len(data) >= 3 and len(data) >= 3 + (int.from_bytes(data[1:3], "big") & 0x0FFF):
                break
            more = rows[own[m], offsets[own[m]] :].tobytes()
            data += more[1 : 1 + more[0]] if starting[m] else more
            if starting[m]:
                break
        whole = data[: 3 + (int.from_bytes(data[1:3], "big") & 0x0FFF)]
        if len(whole) >= 12 and whole[0] == table_id and crc32_mpeg(whole) == 0:
            return whole[8:-4], bad
        bad += 1
    return b"", bad


def demux(media: bytes) -> Demuxed:
    if len(media) % PACKET:
        raise ValueError("a transport stream is a whole number of packets")
    rows = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != 0x47).any():
        raise ValueError("a packet doesn't begin with the sync byte")
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    control = rows[:, 3] >> 4 & 3
    offsets = np.where(control & 2, 5 + rows[:, 4].astype(np.int32), 4)
    offsets = np.where(control & 1, np.minimum(offsets, PACKET), PACKET)

    pat, bad = read_section(rows, offsets, pid, 0, 0)
    programs = [(int.from_bytes(pat[i : i + 2], "big"), int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF) for i in range(0, len(pat), 4)]
    program_map = next((p for number, p in programs if number), 0)
    pmt, worse = read_section(rows, offsets, pid, program_map, 2)
    out = Demuxed(b"", program_map, packets=len(rows), bad_sections=bad + worse)
    if not pmt:
        return out
    at = 4 + (int.from_bytes(pmt[2:4], "big") & 0x0FFF)
    out.stream_type, out.pid = pmt[at], int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF

    own = np.flatnonzero((pid == out.pid) & (control & 1 > 0))
    counters = rows[own, 3] & 15
    step = (counters[1:].astype(np.int16) - counters[:-1]) % 16
    out.continuity_errors = int(((step != 1) & (step != 0)).sum())
    own = own[np.concatenate([[True], step != 0])] if len(own) else own
    rows, offsets, control = rows[own], offsets[own], control[own]
    starts = np.flatnonzero(rows[:, 1] & 0x40)
    stream = rows[np.arange(PACKET)[None, :] >= offsets[:, None]].tobytes()
    bounds = np.concatenate([[0], np.cumsum(PACKET - offsets)])[np.concatenate([starts, [len(rows)]])] if len(rows) else np.zeros(1, int)
    rap = (control[starts] & 2 > 0) & (rows[starts, 4] > 0) & (rows[starts, 5] & 0x40 > 0)
    units = []
    for k in range(len(starts)):
        pes = stream[bounds[k] : bounds[k + 1]]
        if pes[:3] != b"\x00\x00\x01":
            raise ValueError("a PES packet doesn't begin with its prefix")
        p = pes[9:14]
        pts = (p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1
        out.pts.append(pts)
        if rap[k]:
            out.random_access.append(pts)
        size = int.from_bytes(pes[4:6], "big")
        units.append(pes[9 + pes[8] : 6 + size])
    out.payload = b"".join(units)
    return out


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
TYPES = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def media_row(text: str | None) -> tuple:
    n, payload = padded(text)
    media = mux(payload)
    back = demux(media)
    return n, len(back.payload), hashlib.sha256(back.payload).hexdigest(), zlib.crc32(back.payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), back.feature()


def media_features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(doc_id, *media_row(text.as_py())) for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, media: the streams themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([mux(padded(t.as_py())[1]) for t in b.column(1)], pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, media binary")


def access_units(media: DataFrame) -> DataFrame:
    """doc_id, unit, pts, random_access for each access unit of (doc_id, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, m in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                d = demux(m.as_py() or b"")
                points = set(d.random_access)
                rows += [(doc_id, n, pts, pts in points) for n, pts in enumerate(d.pts)]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int64(), pa.bool_()], strict=True)], names=["doc_id", "unit", "pts", "random_access"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, unit long, pts long, random_access boolean")
