"""Documents as MPEG transport streams: writing, demultiplexing, timestamps and random-access points.

A payload becomes one program with one private elementary stream: 188-byte packets with continuity counters, a
program association table (PID 0) and a program map table ahead of every random-access point, and the payload in
packetised elementary packets (access units) with presentation timestamps. Access units that start a
random-access group carry the random-access flag and a program clock in the adaptation field; the last packet of a
unit is filled by stuffing in the adaptation field, so that nothing but the payload's bytes comes back.

Reading finds the tables (sections may span packets), checks their CRC, follows the PIDs they name, checks the continuity counters of every
PID (a packet sent twice and a discontinuity that the stream announces are no jump), reassembles each PID's elementary packets up to the length
that they tell, and takes note of timestamps, clocks and random-access points. What goes wrong is counted in the features, and an elementary
stream is still what arrived: counters that jump, tables that fail their CRC, elementary packets shorter than they tell, and faults: bytes passed over to the
next sync byte, packets marked as damaged, a last packet that is cut off. demux() raises at a lost sync unless told otherwise; read() never does.

Defined cases: null text is an empty text; an empty text stores 64 zero bytes; equal payloads give equal streams; null media hold nothing
(null payload, null feature, no units); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Fixed values of the format: packet size, sync byte, table PIDs and ids, stream type and id for private data, clock rate.
PACKET, SYNC = 188, 0x47
PAT_PID, PAT_TABLE, PMT_TABLE = 0, 0x00, 0x02
PRIVATE_TYPE, PRIVATE_STREAM = 0x06, 0xBD
CLOCK = 90_000
#: This writer's own choices: PIDs, bytes of an access unit, units from one random-access point to the next, ticks of a unit.
PMT_PID, DATA_PID, PROGRAM = 0x1000, 0x0100, 1
UNIT_BYTES, UNITS_TO_ACCESS, UNIT_TICKS = 8192, 8, CLOCK // 25
BLOCK = 64


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


CRC_TABLE = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ CRC_TABLE[(c >> 24) ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    length = len(body) + 9
    head = bytes([table, 0xB0 | length >> 8, length & 0xFF]) + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, counter: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | counter]) + b"\x00" + section).ljust(PACKET, b"\xff")


PAT = _section(PAT_TABLE, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
PMT = _section(PMT_TABLE, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")


def _stamp(ticks: int) -> bytes:
    """A 33-bit presentation timestamp with its marker bits."""
    t = ticks & (1 << 33) - 1
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, 0x01 | t >> 14 & 0xFE, t >> 7 & 0xFF, 0x01 | t << 1 & 0xFE])


def _clock(ticks: int) -> bytes:
    """A program clock reference: 33 bits, six reserved ones, nine bits of extension."""
    return ((ticks & (1 << 33) - 1) << 15 | 0x3F << 9).to_bytes(6, "big")


def mux(payload: bytes) -> bytes:
    """A transport stream that holds payload losslessly."""
    out: list[bytes] = []
    counter = tables = 0
    later, first = (bytes([SYNC, start | DATA_PID >> 8, DATA_PID & 0xFF]) for start in (0, 0x40))
    plain = [later + bytes([0x10 | c]) for c in range(16)]
    for unit, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        data, ticks = payload[at : at + UNIT_BYTES], unit * UNIT_TICKS
        access = unit % UNITS_TO_ACCESS == 0
        if access:
            out += [_table_packet(PAT_PID, tables, PAT), _table_packet(PMT_PID, tables, PMT)]
            tables = (tables + 1) & 15
        body = b"\x80\x80\x05" + _stamp(ticks) + data
        body = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + len(body).to_bytes(2, "big") + body
        field = (b"\x50" + _clock(ticks)) if access else b""
        room = PACKET - 4 - (len(field) + 1 if field else 0)
        here, i = body[:room], min(room, len(body))
        out.append(_filled(first, counter, field, here))
        counter = (counter + 1) & 15
        while len(body) - i >= PACKET - 4:
            out += [plain[counter], body[i : i + PACKET - 4]]
            counter = (counter + 1) & 15
            i += PACKET - 4
        if i < len(body):
            out.append(_filled(later, counter, b"", body[i:]))
            counter = (counter + 1) & 15
    return b"".join(out)


def _filled(head: bytes, counter: int, field: bytes, data: bytes) -> bytes:
    """One packet of data behind an adaptation field, which stuffing makes as long as needed."""
    room = PACKET - 4 - len(data)
    if not room:
        return head + bytes([0x10 | counter]) + data
    field = field or b"\x00"[: room - 1]
    return head + bytes([0x30 | counter, room - 1]) + field.ljust(room - 1, b"\xff") + data


class Unit(NamedTuple):
    """An access unit: its offset in the stream of its PID, timestamp (-1: none), random-access flag and clock of its first packet (-1: none)."""

    at: int
    pts: int
    access: bool
    clock: int = -1


class Stream(NamedTuple):
    """What a transport stream holds: for each elementary PID its bytes and units; programs as (number, PID, type); and counts."""

    payloads: dict[int, bytes]
    packets: int
    programs: tuple[tuple[int, int, int], ...]
    units_of: dict[int, tuple[Unit, ...]]
    jumps: int
    bad_tables: int
    short: int
    faults: int

    @property
    def payload(self) -> bytes:
        """The stream of the first program's first PID."""
        return self.payloads.get(self.programs[0][1], b"") if self.programs else b""

    @property
    def units(self) -> tuple[Unit, ...]:
        return self.units_of.get(self.programs[0][1], ()) if self.programs else ()

    @property
    def feature(self) -> str:
        units, stamps = self.units, [u.pts for u in self.units if u.pts >= 0]
        access = ".".join(str(u.pts) for u in units if u.access)
        clock = max((u.clock for u in units), default=-1)
        return f"packets={self.packets};programs={'.'.join(f'{p}-{pid}-{kind}' for p, pid, kind in self.programs)};units={len(units)};first={stamps[0] if stamps else -1};last={stamps[-1] if stamps else -1};access={access};clock={clock};jumps={self.jumps};bad_tables={self.bad_tables};short={self.short};faults={self.faults}"


@lru_cache(maxsize=256)
def _pat(section: bytes) -> tuple[tuple[int, int], ...] | None:
    body = _checked(section, PAT_TABLE)
    return None if body is None else tuple((int.from_bytes(body[i : i + 2], "big"), int.from_bytes(body[i + 2 : i + 4], "big") & 0x1FFF) for i in range(0, len(body) - 3, 4) if body[i : i + 2] != b"\0\0")


@lru_cache(maxsize=256)
def _pmt(section: bytes) -> tuple[int, tuple[tuple[int, int], ...]] | None:
    body = _checked(section, PMT_TABLE)
    if body is None or len(body) < 4:
        return None
    i, found = 4 + (int.from_bytes(body[2:4], "big") & 0x0FFF), []
    while i + 5 <= len(body):
        found.append((int.from_bytes(body[i + 1 : i + 3], "big") & 0x1FFF, body[i]))
        i += 5 + (int.from_bytes(body[i + 3 : i + 5], "big") & 0x0FFF)
    return int.from_bytes(section[3:5], "big"), tuple(found)


def _checked(section: bytes, table: int) -> bytes | None:
    """The body of a section that has the right table id, length and CRC."""
    end = 3 + ((section[1] & 0x0F) << 8 | section[2]) if len(section) >= 12 else 0
    if end < 12 or end > len(section) or section[0] != table or crc32_mpeg(section[:end]):
        return None
    return section[8 : end - 4]


class _Elementary:
    """The elementary stream of one PID while it is read."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.units: list[Unit] = []
        self.size, self.left, self.short = 0, -1, 0  # left: bytes that the open unit still has (-1: until the next one begins)

    def begin(self, s: bytes, i: int, end: int, clock: int, access: bool) -> None:
        self.end()
        if end - i < 9 or s[i : i + 3] != b"\x00\x00\x01" or end - i < 9 + s[i + 8]:
            self.short += 1
            self.left = 0
            return
        told, head = int.from_bytes(s[i + 4 : i + 6], "big"), 9 + s[i + 8]
        self.units.append(Unit(self.size, _read_stamp(s, i) if s[i + 8] >= 5 else -1, access, clock))
        self.left = told - head + 6 if told else -1
        self.go_on(s, i + head, end)

    def go_on(self, s: bytes, i: int, end: int) -> None:
        n = end - i if self.left < 0 else min(end - i, self.left)
        if n > 0:
            self.parts.append(s[i : i + n])
            self.size += n
            if self.left > 0:
                self.left -= n

    def end(self) -> None:
        self.short += self.left > 0
        self.left = 0


class _Sections:
    """The sections of one table PID, which may span packets, or share one."""

    def __init__(self) -> None:
        self.held: bytes | None = None

    def push(self, data: bytes, start: bool) -> Iterator[bytes]:
        if start:
            pointer = data[0] if data else 0
            if self.held is not None:
                self.held += data[1 : 1 + pointer]
                yield from self.whole()
            self.held = data[1 + pointer :]
        elif self.held is not None:
            self.held += data
        yield from self.whole()

    def whole(self) -> Iterator[bytes]:
        while self.held and self.held[0] != 0xFF and len(self.held) >= 3 and len(self.held) >= (n := 3 + ((self.held[1] & 0x0F) << 8 | self.held[2])):
            yield self.held[:n]
            self.held = self.held[n:]
        if self.held is not None and (not self.held or self.held[0] == 0xFF):
            self.held = None  # the rest is stuffing


def demux(stream: bytes, strict: bool = True) -> Stream:
    """Reads a transport stream; PIDs that no program map names are passed over. strict: a lost sync or cut packet raises instead of counting as a fault."""
    if strict and len(stream) % PACKET:
        raise ValueError("the stream isn't a whole number of packets")
    maps: dict[int, int] = {}
    kinds: dict[int, tuple[int, int]] = {}
    last: dict[int, tuple[int, bytes]] = {}
    open_: dict[int, _Elementary] = {}
    tables: dict[int, _Sections] = {}
    jumps = bad = faults = packets = at = 0
    size = len(stream)
    while at + PACKET <= size:
        if stream[at] != SYNC:
            if strict:
                raise ValueError(f"no sync byte at {at}")
            faults += 1
            at = stream.find(SYNC, at + 1)
            while 0 <= at < size - PACKET and stream[at + PACKET] != SYNC:
                at = stream.find(SYNC, at + 1)
            if at < 0:
                at = size
            continue
        begin, stop = at, at + PACKET
        at = stop
        packets += 1
        b1, b3 = stream[begin + 1], stream[begin + 3]
        pid = (b1 & 0x1F) << 8 | stream[begin + 2]
        if b1 & 0x80:
            faults += 1
            continue
        i, access, told, clock = begin + 4, False, False, -1
        if b3 & 0x20:
            n = stream[i]
            if n > PACKET - 5:
                faults += 1
                continue
            if n:
                flags = stream[i + 1]
                access, told = bool(flags & 0x40), bool(flags & 0x80)
                if flags & 0x10 and n >= 7:
                    clock = int.from_bytes(stream[i + 2 : i + 8], "big") >> 15
            i += 1 + n
        if not b3 & 0x10 or i >= stop:
            continue
        counter, known = b3 & 15, last.get(pid)
        if known is not None and not told and counter != (known[0] + 1 & 15):
            if counter == known[0] and stream[i:stop] == known[1]:
                continue  # sent twice, as the format allows
            jumps += 1
        last[pid] = counter, stream[i:stop]
        if pid in kinds:
            if (e := open_.get(pid)) is None:
                e = open_[pid] = _Elementary()
            if b1 & 0x40:
                e.begin(stream, i, stop, clock, access)
            else:
                e.go_on(stream, i, stop)
        elif pid == PAT_PID or pid in maps:
            if (t := tables.get(pid)) is None:
                t = tables[pid] = _Sections()
            for section in t.push(stream[i:stop], bool(b1 & 0x40)):
                if pid == PAT_PID:
                    if (programs := _pat(section)) is None:
                        bad += 1
                    else:
                        maps |= {p: program for program, p in programs}
                elif (found := _pmt(section)) is None:
                    bad += 1
                else:
                    kinds |= {p: (found[0], kind) for p, kind in found[1]}
    faults += at < size
    for e in open_.values():
        e.end()
    programs = tuple(sorted((program, p, kind) for p, (program, kind) in kinds.items()))
    return Stream({p: b"".join(e.parts) for p, e in open_.items()}, packets, programs, {p: tuple(e.units) for p, e in open_.items()}, jumps, bad, sum(e.short for e in open_.values()), faults)


def _read_stamp(s: bytes, i: int) -> int:
    if not s[i + 7] & 0x80:
        return -1
    return (s[i + 9] >> 1 & 7) << 30 | s[i + 10] << 22 | s[i + 11] >> 1 << 15 | s[i + 12] << 7 | s[i + 13] >> 1


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text's UTF-8 form, and that form filled with zero bytes to a positive multiple of 64."""
    data = (text or "").encode("utf-8")
    return len(data), data.ljust(max(1, -(-len(data) // BLOCK)) * BLOCK, b"\0")


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the transport stream of each row's whole text."""

    def row(doc_id: int, text: str | None) -> Iterator[tuple]:
        n, payload = padded(text)
        yield doc_id, n, mux(payload)

    return map_batches(docs.select("doc_id", F.col("text").cast("string")), "doc_id bigint, n_bytes bigint, media binary", lambda: row, lambda r: len(r[-1]))


def read(stored: DataFrame) -> DataFrame:
    """The columns of stored, of which media is replaced by what it holds: payload, feature and units (offset, timestamp, random access, clock)."""
    others = [c for c in stored.columns if c != "media"]
    kept = ", ".join(f"`{c}` {stored.schema[c].dataType.simpleString()}" for c in others)

    def row(*values: object) -> Iterator[tuple]:
        if values[-1] is None:
            yield (*values[:-1], None, None, [])
            return
        s = demux(values[-1], strict=False)
        yield (*values[:-1], s.payload, s.feature, [u._asdict() for u in s.units])

    schema = f"{kept}, payload binary, feature string, units array<struct<at: bigint, pts: bigint, access: boolean, clock: bigint>>"
    return map_batches(stored.select(*others, "media"), schema, lambda: row, lambda r: len(r[-3] or b"") + 64)
