"""Geographic files as features: (feature, kind, wkt, properties): GeoJSON, KML, KMZ, GPX, dBASE and Shapefile, OSM XML."""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from .files import decode
from .wkt import text as wkt_text

FEATURES = "feature int, kind string, wkt string, properties map<string,string>"


def _feature(n: int, g: tuple | None, properties: dict) -> tuple:
    return n, g and g[0], g and wkt_text(g), {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in properties.items() if v is not None}


def _closed(ring: list) -> list:
    return ring if ring and ring[0] == ring[-1] else [*ring, ring[0]] if ring else ring


def geojson(data: bytes) -> Iterator[tuple]:
    """Feature collections, features and bare geometries; short lines and rings are dropped, rings closed."""
    root = json.loads(decode(data))
    items = root["features"] if root.get("type") == "FeatureCollection" else [root] if root.get("type") == "Feature" else [{"geometry": root, "properties": {}}]
    for n, f in enumerate(items):
        properties = dict(f.get("properties") or {})
        if "id" in f and "id" not in properties:
            properties["id"] = f["id"]
        yield _feature(n, _json_geometry(f.get("geometry")), properties)


def _json_geometry(g: dict | None) -> tuple | None:
    if not g:
        return None
    kind = g["type"].upper()
    if kind == "GEOMETRYCOLLECTION":
        parts = [p for x in g["geometries"] if (p := _json_geometry(x))]
        return (kind, parts) if parts else None
    c = g["coordinates"]
    cut = lambda x: [float(v) for v in x[:3]] if not isinstance(x[0], list) else [cut(y) for y in x]
    c = cut(c) if c else []
    rings = lambda p: [r for r in map(_closed, p) if len(r) >= 4]
    if kind == "LINESTRING":
        c = c if len(c) >= 2 else []
    elif kind == "MULTILINESTRING":
        c = [x for x in c if len(x) >= 2]
    elif kind == "POLYGON":
        c = rings(c)
    elif kind == "MULTIPOLYGON":
        c = [p for x in c if (p := rings(x))]
    return (kind, c) if c else None


def _name(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _find(e: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (x for x in e.iter() if _name(x) == name)


def _coordinates(e: ElementTree.Element) -> list[list[float]]:
    return [[float(v) for v in p.split(",")[:3]] for p in ((next(_find(e, "coordinates"), None) is not None and next(_find(e, "coordinates")).text) or "").split()]


def kml(data: bytes) -> Iterator[tuple]:
    """Placemarks at any depth: name and description first, then extended data."""
    for n, mark in enumerate(_find(ElementTree.fromstring(data), "Placemark")):
        properties: dict[str, str] = {}
        for e in mark:
            if _name(e) in ("name", "description") and e.text:
                properties.setdefault(_name(e), e.text.strip())
        for d in _find(mark, "Data"):
            properties.setdefault(d.get("name", ""), (next(_find(d, "value")).text or "").strip())
        for d in _find(mark, "SimpleData"):
            properties.setdefault(d.get("name", ""), (d.text or "").strip())
        parts = [g for e in mark if (g := _kml_geometry(e))]
        yield _feature(n, parts[0] if len(parts) == 1 else ("GEOMETRYCOLLECTION", parts) if parts else None, properties)


def _kml_geometry(e: ElementTree.Element) -> tuple | None:
    kind = _name(e)
    if kind == "Point" and (c := _coordinates(e)):
        return "POINT", c[0]
    if kind == "LineString" and len(c := _coordinates(e)) >= 2:
        return "LINESTRING", c
    if kind == "Polygon":
        rings = [r for b in ("outerBoundaryIs", "innerBoundaryIs") for x in _find(e, b) if len(r := _closed(_coordinates(x))) >= 4]
        return ("POLYGON", rings) if rings else None
    if kind == "MultiGeometry":
        parts = [g for x in e if (g := _kml_geometry(x))]
        kinds = {g[0] for g in parts}
        if len(parts) == 1:
            return parts[0]
        return (f"MULTI{kinds.pop()}", [g[1] for g in parts]) if len(kinds) == 1 and parts[0][0] in ("POINT", "LINESTRING", "POLYGON") else ("GEOMETRYCOLLECTION", parts) if parts else None
    return None


def kmz(data: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        yield from kml(z.read(next(n for n in z.namelist() if n.lower().endswith(".kml"))))


def gpx(data: bytes) -> Iterator[tuple]:
    """Waypoints as points, routes as lines, tracks as (multi) lines; ``gpx_type`` tells which."""
    n = 0
    for e in ElementTree.fromstring(data):
        kind = _name(e)
        if kind not in ("wpt", "rte", "trk"):
            continue
        at = lambda p: [float(p.get("lon")), float(p.get("lat")), *(float(x.text) for x in p if _name(x) == "ele")]
        properties = {"gpx_type": kind} | {_name(x): (x.text or "").strip() for x in e if _name(x) in ("name", "cmt", "desc", "src", "sym", "type", "number", "time")}
        lines = [[at(e)]] if kind == "wpt" else [[at(p) for p in _find(e, "rtept")]] if kind == "rte" else [[at(p) for p in _find(s, "trkpt")] for s in _find(e, "trkseg")]
        if kind == "wpt":
            g: tuple | None = ("POINT", lines[0][0])
        else:
            lines = [x for x in lines if len(x) >= 2]
            g = None if not lines else ("LINESTRING", lines[0]) if len(lines) == 1 else ("MULTILINESTRING", lines)
        yield _feature(n, g, properties)
        n += 1


def dbf(data: bytes, encoding: str = "utf-8") -> Iterator[tuple]:
    """(row, properties): text right-trimmed, blank or starred numbers left out, dates as ISO text, deleted rows empty."""
    rows, head, size = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding, "replace"), chr(data[at + 11]), data[at + 16]))
        at += 32
    for n in range(rows):
        row, k, out = data[head + n * size : head + (n + 1) * size], 1, {}
        for name, kind, width in fields:
            v = row[k : k + width].decode(encoding, "replace").rstrip(" \0")
            k += width
            if kind in "NF":
                v = "" if "*" in v else v.strip()
            elif kind == "L":
                v = "true" if v[:1] in "TtYy" and v else "false" if v[:1] in "FfNn" and v else ""
            elif kind == "D":
                v = f"{v[:4]}-{v[4:6]}-{v[6:]}" if len(v) == 8 and v.isdigit() else ""
            elif kind not in "C":
                v = ""
            if v and row[:1] != b"*":
                out[name] = v
        yield n, out


ROWS = "row int, properties map<string,string>"


def shp(data: bytes) -> Iterator[tuple]:
    """Shapes: points, multipoints, lines, polygons (clockwise rings are shells, others their holes)."""
    at, n = 100, 0
    while at + 12 <= len(data):
        length = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
        body = data[at + 8 : at + 8 + length]
        yield _feature(n, _shape(body), {})
        at, n = at + 8 + length, n + 1


def _shape(b: bytes) -> tuple | None:
    kind = struct.unpack("<i", b[:4])[0] % 10
    if kind == 1:
        return "POINT", list(struct.unpack("<2d", b[4:20]))
    if kind == 8:
        k = struct.unpack("<i", b[36:40])[0]
        return "MULTIPOINT", [list(struct.unpack("<2d", b[40 + 16 * i : 56 + 16 * i])) for i in range(k)]
    if kind not in (3, 5):
        return None
    parts, k = struct.unpack("<2i", b[36:44])
    starts = [*struct.unpack(f"<{parts}i", b[44 : 44 + 4 * parts]), k]
    xy = [list(struct.unpack("<2d", b[44 + 4 * parts + 16 * i : 60 + 4 * parts + 16 * i])) for i in range(k)]
    lines = [xy[i:j] for i, j in zip(starts, starts[1:], strict=False)]
    if kind == 3:
        return ("LINESTRING", lines[0]) if len(lines) == 1 else ("MULTILINESTRING", lines)
    area = lambda r: sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:], strict=False))
    shells, holes = [[r] for r in lines if area(r) <= 0], [r for r in lines if area(r) > 0]
    for h in holes:
        around = [s for s in shells if _inside(s[0], h[0])]
        (min(around, key=lambda s: abs(area(s[0]))) if around else shells.append([h]) or shells[-1][:0]).append(h)
    return ("POLYGON", shells[0]) if len(shells) == 1 else ("MULTIPOLYGON", shells)


def _inside(ring: list, p: list) -> bool:
    out = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
        if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
            out = not out
    return out


def osm(data: bytes) -> Iterator[tuple]:
    """(kind, id, lat, lon, refs, tags) of nodes, ways and relations, read as a stream; deleted and invisible ones are skipped."""
    for _, e in ElementTree.iterparse(io.BytesIO(data)):
        if _name(e) in ("node", "way", "relation"):
            if e.get("visible") != "false" and e.get("action") != "delete":
                tags = {t.get("k"): t.get("v") for t in e if _name(t) == "tag"}
                refs = [int(r.get("ref")) for r in e if _name(r) in ("nd", "member")]
                yield _name(e), int(e.get("id")), float(e.get("lat")) if e.get("lat") else None, float(e.get("lon")) if e.get("lon") else None, refs, tags
            e.clear()


OSM = "kind string, id bigint, lat double, lon double, refs array<bigint>, tags map<string,string>"
