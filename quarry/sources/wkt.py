"""Well-known text: a small recursive reader and printer."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"[A-Za-z]+|[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?|[(),]")
#: Kinds, and how many lists enclose their positions.
DEPTH = {"POINT": 0, "LINESTRING": 1, "MULTIPOINT": 1, "POLYGON": 2, "MULTILINESTRING": 2, "MULTIPOLYGON": 3}
MAX_DEPTH = 16

Geometry = tuple[str, object]


def parse(wkt: str | None) -> Geometry | None:
    """(kind, nested lists of coordinates), or null if the text is none."""
    if not wkt:
        return None
    body = re.sub(r"^\s*SRID=\d+;", "", wkt, flags=re.IGNORECASE)
    tokens = _TOKEN.findall(body)
    if "".join(tokens) != re.sub(r"\s+", "", body):
        return None
    try:
        out, at = _geometry(tokens, 0, 0)
    except (IndexError, ValueError, KeyError):
        return None
    return out if at == len(tokens) else None


def _geometry(t: list[str], at: int, depth: int) -> tuple[Geometry, int]:
    if depth > MAX_DEPTH:
        raise ValueError("nested too deeply")
    kind, dims = t[at].upper(), ""
    at += 1
    for suffix in ("ZM", "Z", "M"):
        if kind not in DEPTH and kind != "GEOMETRYCOLLECTION" and kind.endswith(suffix):
            kind, dims = kind.removesuffix(suffix), suffix
    if t[at].upper() in ("Z", "M", "ZM"):
        dims, at = t[at].upper(), at + 1
    if t[at].upper() == "EMPTY":
        return (kind, []), at + 1
    if kind == "GEOMETRYCOLLECTION":
        parts = []
        _expect(t[at], "(")
        while t[at] in "(,":
            part, at = _geometry(t, at + 1, depth + 1)
            parts.append(part)
        _expect(t[at], ")")
        return (kind, parts), at + 1
    if kind == "POINT":
        _expect(t[at], "(")
        p, at = _position(t, at + 1, dims)
        _expect(t[at], ")")
        return (kind, p), at + 1
    coords, at = _lists(t, at, DEPTH[kind], dims, kind == "MULTIPOINT")
    return (kind, coords), at


def _lists(t: list[str], at: int, depth: int, dims: str, bare: bool) -> tuple[list, int]:
    out: list = []
    _expect(t[at], "(")
    while t[at] in "(," and (not out or t[at] == ","):
        at += 1
        if depth == 1:
            wrapped = bare and t[at] == "("
            item, at = _position(t, at + wrapped, dims)
            if wrapped:
                _expect(t[at], ")")
                at += 1
        else:
            item, at = _lists(t, at, depth - 1, dims, bare)
        out.append(item)
    _expect(t[at], ")")
    return out, at + 1


def _position(t: list[str], at: int, dims: str) -> tuple[list[float], int]:
    end = at
    while t[end] not in "(),":
        end += 1
    v = [float(x) for x in t[at:end]]
    if not 2 <= len(v) <= 4:
        raise ValueError("a position has two to four numbers")
    return v[:3] if len(v) >= 3 and dims != "M" else v[:2], end


def _expect(got: str, want: str) -> None:
    if got != want:
        raise ValueError(f"{want} is missing")


def text(g: Geometry) -> str:
    kind, c = g
    if not c:
        return f"{kind} EMPTY"
    if kind == "GEOMETRYCOLLECTION":
        return f"{kind} ({', '.join(map(text, c))})"
    first = c
    while isinstance(first[0], list):
        first = first[0]
    z = " Z" if len(first) == 3 else ""
    number = lambda v: f"{v:.10f}".rstrip("0").rstrip(".").replace("-0", "0") if abs(v) < 1e-11 else f"{v:.10f}".rstrip("0").rstrip(".")
    show = lambda x: " ".join(map(number, x)) if not isinstance(x[0], list) else f"({', '.join(map(show, x))})"
    return f"{kind}{z} ({show(c)})" if kind == "POINT" else f"{kind}{z} {show(c)}"
