"""Activities in the FIT format: one row a record message; CRC-checked, bounded."""

from __future__ import annotations

import datetime
import struct
from collections.abc import Iterator

RECORDS = "time timestamp_ntz, longitude double, latitude double, elevation double, heart_rate int, cadence int, power int, speed double, distance double"
MAX_BYTES, MAX_RECORDS = 64 << 20, 2_000_000
EPOCH = datetime.datetime(1989, 12, 31)

#: Struct codes and invalid values by base type.
BASE = {0: ("B", 0xFF), 1: ("b", 0x7F), 2: ("B", 0xFF), 0x83: ("h", 0x7FFF), 0x84: ("H", 0xFFFF), 0x85: ("i", 0x7FFFFFFF), 0x86: ("I", 0xFFFFFFFF), 0x88: ("f", None), 0x89: ("d", None), 10: ("B", 0), 0x8B: ("H", 0), 0x8C: ("I", 0)}
#: The record message and its fields (number: name, scale, offset).
RECORD = 20
FIELDS = {0: ("latitude", None, 0), 1: ("longitude", None, 0), 2: ("elevation", 5, 500), 3: ("heart_rate", 1, 0), 4: ("cadence", 1, 0), 5: ("distance", 100, 0), 6: ("speed", 1000, 0), 7: ("power", 1, 0), 73: ("speed", 1000, 0), 78: ("elevation", 5, 500)}


def crc16(data: bytes) -> int:
    """CRC-16 with the reflected polynomial 0xA001, by a table of bytes."""
    out = 0
    for b in data:
        out = (out >> 8) ^ _TABLE[(out ^ b) & 0xFF]
    return out


def _table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xA001 if n & 1 else 0)
        out.append(n)
    return out


_TABLE = _table()


def records(data: bytes) -> Iterator[tuple]:
    """The record messages in order; missing and invalid values are null."""
    if len(data) > MAX_BYTES or len(data) < 14 or data[8:12] != b".FIT":
        raise ValueError("not a FIT file, or too large")
    at, end = data[0], data[0] + struct.unpack("<I", data[4:8])[0]
    if len(data) < end + 2 or crc16(data[: end + 2]) != 0:
        raise ValueError("the checksum does not match")
    kinds: dict[int, tuple] = {}
    last, count = None, 0
    while at < end:
        head = data[at]
        at += 1
        if head & 0x40 and not head & 0x80:  # a definition
            order = ">" if data[at + 1] else "<"
            number, n = struct.unpack(order + "HB", data[at + 2 : at + 5])
            fields = [tuple(data[at + 5 + 3 * i : at + 8 + 3 * i]) for i in range(n)]
            at += 5 + 3 * n
            extra = 0
            if head & 0x20:
                extra = sum(data[at + 1 + 3 * i + 1] for i in range(data[at]))
                at += 1 + 3 * data[at]
            kinds[head & 0x0F] = (order, number, fields, extra)
            continue
        order, number, fields, extra = kinds[(head >> 5) & 3 if head & 0x80 else head & 0x0F]
        values: dict[int, float] = {}
        for field, size, base in fields:
            code, invalid = BASE.get(base, ("", None))
            if code and struct.calcsize(code) == size:
                v = struct.unpack(order + code, data[at : at + size])[0]
                if v != invalid:
                    values[field] = v
            at += size
        at += extra
        if 253 in values:
            last = int(values[253])
        elif head & 0x80 and last is not None:
            last += ((head & 0x1F) - last) & 0x1F
        if number == RECORD:
            count += 1
            if count > MAX_RECORDS:
                raise ValueError("too many records")
            out: dict[str, float] = {}
            for field, (name, scale, offset) in FIELDS.items():
                if field in values:
                    v = values[field]
                    out[name] = v * 180 / 2**31 if scale is None else v / scale - offset if scale > 1 else v
            time = EPOCH + datetime.timedelta(seconds=last) if last is not None else None
            yield time, out.get("longitude"), out.get("latitude"), out.get("elevation"), out.get("heart_rate"), out.get("cadence"), out.get("power"), out.get("speed"), out.get("distance")
