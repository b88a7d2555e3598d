"""MPEG transport streams as a binary column: multiplexing, and reading back.

A stream has one program: an association table (PID 0), a map table and one elementary stream of private
data in PES packets, one for each access unit. Every unit has a presentation time; every RAP_EVERY-th is a
random-access point, which carries a clock reference and has the tables before it. The reader parses the
tables with their checksums, checks continuity counters by PID, reassembles the elementary packets and
returns the payload with the timestamps and random-access points as arrays.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, table

# Fixed values of the format (ISO/IEC 13818-1).
PACKET, SYNC, PAT_PID, STREAM_TYPE, STREAM_ID = 188, 0x47, 0, 0x06, 0xBD
#: Ours: the PIDs, the bytes of an access unit, 90 kHz ticks between units, and units between random-access points.
PMT_PID, DATA_PID, UNIT, TICKS, RAP_EVERY = 0x100, 0x101, 8192, 3600, 8
PAD = 64


def _crc_table() -> list[int]:
    rows = []
    for byte in range(256):
        value = byte << 24
        for _ in range(8):
            value = (value << 1) ^ (0x04C11DB7 if value & 0x80000000 else 0)
        rows.append(value & 0xFFFFFFFF)
    return rows


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32 of the tables' kind: most significant bit first, no final inversion."""
    value = 0xFFFFFFFF
    for byte in data:
        value = ((value << 8) & 0xFFFFFFFF) ^ _CRC[(value >> 24) ^ byte]
    return value


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (5 + len(body) + 4)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return b"\x00" + head + section_crc(head).to_bytes(4, "big")


_PAT = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = _section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")


def _stamp(ticks: int) -> bytes:
    """A 33-bit presentation time with its marker bits."""
    return bytes([0x21 | (ticks >> 29 & 0x0E), ticks >> 22 & 0xFF, 0x01 | (ticks >> 14 & 0xFE), ticks >> 7 & 0xFF, 0x01 | (ticks << 1 & 0xFE)])


def _pes(unit: bytes, ticks: int) -> bytes:
    return b"\x00\x00\x01" + bytes([STREAM_ID]) + (8 + len(unit)).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(ticks) + unit


def _clock(ticks: int) -> bytes:
    """The adaptation field of a random-access point."""
    return b"\x07\x50" + (ticks << 15 | 0x7E00).to_bytes(6, "big")


def mux(payload: bytes) -> bytes:
    out: list[bytes] = []
    counters = {PAT_PID: 0, PMT_PID: 0, DATA_PID: 0}

    def put(pid: int, start: bool, adaptation: bytes, body: bytes) -> None:
        room = 184 - len(adaptation) - len(body)
        if room == 1 and not adaptation:
            adaptation = b"\x00"
        elif room:
            grown = (adaptation or b"\x00\x00")[1:] + b"\xff" * (room if adaptation else room - 2)
            adaptation = bytes([len(grown)]) + grown
        count = counters[pid]
        counters[pid] = (count + 1) & 15
        out.append(bytes([SYNC, 0x40 * start | pid >> 8, pid & 255, (0x30 if adaptation else 0x10) | count]))
        out.append(adaptation)
        out.append(body)

    for k, at in enumerate(range(0, len(payload), UNIT)):
        ticks, first = k * TICKS, k % RAP_EVERY == 0
        if first:
            put(PAT_PID, True, b"", _PAT + b"\xff" * (184 - len(_PAT)))
            put(PMT_PID, True, b"", _PMT + b"\xff" * (184 - len(_PMT)))
        body, adaptation, start = _pes(payload[at : at + UNIT], ticks), _clock(ticks) if first else b"", True
        done = 0
        while done < len(body):
            some = min(184 - len(adaptation), len(body) - done)
            put(DATA_PID, start, adaptation, body[done : done + some])
            done, adaptation, start = done + some, b"", False
    return b"".join(out)


@dataclass
class Stream:
    """What a stream holds; errors name what is broken, and a reader goes on after them."""

    payload: bytes = b""
    programs: dict[int, int] = field(default_factory=dict)
    types: dict[int, int] = field(default_factory=dict)
    times: list[int] = field(default_factory=list)
    units: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)
    packets: int = 0
    gaps: int = 0
    duplicates: int = 0
    errors: list[str] = field(default_factory=list)


def _tables(s: Stream, pid: int, body: bytes) -> None:
    at = 1 + (body[0] if body else 0)
    size = 3 + (int.from_bytes(body[at + 1 : at + 3], "big") & 0xFFF)
    section = body[at : at + size]
    if len(section) < size or section_crc(section):
        s.errors.append(f"table checksum, PID {pid}")
        return
    if section[0] == 0:
        for x in range(8, size - 4, 4):
            s.programs[int.from_bytes(section[x : x + 2], "big")] = int.from_bytes(section[x + 2 : x + 4], "big") & 0x1FFF
    elif section[0] == 2:
        x = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
        while x < size - 4:
            s.types[int.from_bytes(section[x + 1 : x + 3], "big") & 0x1FFF] = section[x]
            x += 5 + (int.from_bytes(section[x + 3 : x + 5], "big") & 0xFFF)


def demux(media: bytes) -> Stream:
    """What a stream holds; it may be cut, damaged or empty.

    A counter that is not the next one is a gap; a packet that repeats the one before it on its PID, counter and
    content, is a duplicate, which the format allows once and whose content counts once. An elementary packet of
    length 0 goes on to the next one's start.
    """
    s, last, parts, payload = Stream(packets=len(media) // PACKET), {}, [], []
    if len(media) % PACKET:
        s.errors.append("length")

    def close() -> None:
        if not parts:
            return
        pes = b"".join(parts)
        parts.clear()
        size = int.from_bytes(pes[4:6], "big")
        end = 6 + size if size else len(pes)
        if pes[:3] != b"\x00\x00\x01" or len(pes) < max(9, end) or end < 9 + pes[8]:
            s.errors.append(f"elementary packet {len(s.times)}")
            return
        if pes[7] & 0x80 and pes[8] >= 5:
            t = pes[9:14]
            s.times.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1)
        unit = pes[9 + pes[8] : end]
        s.units.append(len(unit))
        payload.append(unit)

    for at in range(0, s.packets * PACKET, PACKET):
        if media[at] != SYNC:
            s.errors.append(f"sync byte at {at}")
            continue
        pid, control = (media[at + 1] & 0x1F) << 8 | media[at + 2], media[at + 3]
        body, count = at + 4, control & 15
        random_access = False
        if control & 0x20:
            random_access = bool(media[body] and media[body + 1] & 0x40)
            body += 1 + media[body]
        content = media[body : at + PACKET] if control & 0x10 else b""
        if control & 0x10:
            if pid in last:
                expected, before, again = last[pid]
                if count == (expected - 1) & 15 and content == before and not again:
                    last[pid] = (expected, before, True)
                    s.duplicates += 1
                    continue
                s.gaps += count != expected
            last[pid] = ((count + 1) & 15, content, False)
        if random_access:
            s.random_access.append(len(s.units) + bool(parts))
        if not control & 0x10:
            continue
        start = media[at + 1] & 0x40
        if pid == PAT_PID or pid in s.programs.values():
            if start:
                _tables(s, pid, content)
        elif pid in s.types:
            if start:
                close()
            parts.append(content)
    close()
    s.payload = b"".join(payload)
    return s


def pad(data: bytes, to: int = PAD) -> bytes:
    """data with zero bytes up to a positive multiple of `to`."""
    return data + b"\x00" * (max(to, -(-len(data) // to) * to) - len(data))


PARSED = "payload binary, pts array<long>, unit_bytes array<long>, random_access array<long>, programs map<int,int>, stream_types map<int,int>, packets long, continuity_errors long, errors array<string>"
DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _mux(data: pd.Series) -> pd.Series:
    return data.map(lambda x: mux(pad(x or b"")))


def _read(media: pd.Series) -> pd.DataFrame:
    found = [demux(x or b"") for x in media]
    return pd.DataFrame({"payload": [s.payload for s in found], "pts": [s.times for s in found], "unit_bytes": [s.units for s in found], "random_access": [s.random_access for s in found], "programs": [s.programs for s in found], "stream_types": [s.types for s in found], "packets": [s.packets for s in found], "continuity_errors": [s.gaps for s in found], "errors": [s.errors for s in found]})


def feature_of(s: Stream) -> str:
    """Programs, stream types, packets, units, times (first, last and step; none are dashes), random-access points and faults."""
    pairs = lambda x: ",".join(f"{k}:{v}" for k, v in sorted(x.items()))
    times = f"{s.times[0]}-{s.times[-1]}/{s.times[1] - s.times[0] if len(s.times) > 1 else 0}" if s.times else "-"
    return f"programs={pairs(s.programs)};types={pairs(s.types)};packets={s.packets};units={len(s.units)};pts={times};rap={','.join(map(str, s.random_access))};gaps={s.gaps};errors={len(s.errors)}"


def _digest(media: pd.Series) -> pd.DataFrame:
    rows = []
    for x in media:
        x = x or b""
        s = demux(x)
        rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-PAD:]), len(x), hashlib.sha256(x).hexdigest(), feature_of(s)))
    return pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def to_stream(data: Column) -> Column:
    """The transport stream of padded bytes; null is empty."""
    return F.pandas_udf(_mux, "binary")(data)


def read_stream(media: Column) -> Column:
    """The parsed stream: payload, a presentation time and size for each unit, and the units that start at a random-access point.

    A null or empty stream holds nothing; what is broken in a damaged one is named in errors, and the rest is read.
    """
    return F.pandas_udf(_read, PARSED)(media)


def digest(media: Column) -> Column:
    """Digests of a stored stream and of the payload read back from it; a null stream is an empty one, a damaged one has what can be read."""
    return F.pandas_udf(_digest, DIGEST)(media)


def with_stream(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with a binary column that stores the text's UTF-8 bytes as a transport stream.

    Null and empty texts are one unit of 64 zero bytes; repeated rows and equal texts give equal streams; a
    text of any length is stored whole; a column that is named like the new one is replaced.
    """
    return docs.withColumn(media, to_stream(F.col(text).cast("binary")))


def op2_transport_stream(spark, sf_dir):
    """Every document's stored stream and what is read back from it.

    A null text is empty, so one unit of 64 zero bytes; texts of any length are whole; repeated rows have equal
    values, null ids are kept, and an empty table gives no rows.
    """
    docs = with_stream(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    stored = stage(docs.select("doc_id", size, "media"), "media")
    return stored.select("doc_id", "n_bytes", digest("media").alias("d")).select("doc_id", "n_bytes", "d.*")


QUERIES = {"op2_transport_stream": op2_transport_stream}
