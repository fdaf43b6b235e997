"""Vector geometry on arrays of (x, y) and inverse projections, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The WGS 84 ellipsoid.
A, INVERSE_FLATTENING = 6378137.0, 298.257223563


def same(p: Column, q: Column) -> Column:
    return (p["x"] == q["x"]) & (p["y"] == q["y"])


def closed(ring: Column) -> Column:
    """The ring with its first position repeated at the end; null below three distinct positions."""
    shut = same(ring[0], F.element_at(ring, -1))
    out = F.when(shut, ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    return F.when((F.size(ring) >= 3) & (F.size(out) >= 4), out)


def signed_area(ring: Column) -> Column:
    """Twice the area of a closed ring; positive if it runs counter-clockwise."""
    pairs = F.zip_with(ring, F.slice(ring, 2, 1 << 30), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(F.filter(pairs, lambda v: v.isNotNull()), F.lit(0.0), lambda acc, v: acc + v)


def oriented(ring: Column, counter_clockwise: bool = True) -> Column:
    area = signed_area(ring)
    return F.when((area == 0) | ((area > 0) == F.lit(counter_clockwise)), ring).otherwise(F.reverse(ring))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a closed ring holds the point (even-odd rule)."""
    edges = F.zip_with(ring, F.slice(ring, 2, 1 << 30), lambda p, q: F.when((q["y"] > y) != (p["y"] > y), (x < (p["x"] - q["x"]) * (y - q["y"]) / (p["y"] - q["y"]) + q["x"]).cast("int")))
    return F.aggregate(edges, F.lit(0), lambda acc, v: acc + F.coalesce(v, F.lit(0))) % 2 == 1


def bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def shifted(ring: Column, dx: Column, dy: Column) -> Column:
    """Every coordinate mapped."""
    return F.transform(ring, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def degrees_text(value: Column) -> Column:
    """Up to ten decimals without exponent or trailing zeros; -0 is 0."""
    t = F.regexp_replace(F.regexp_replace(F.round(value, 10).cast("decimal(20,10)").cast("string"), r"0+$", ""), r"\.$", "")
    return F.when(t == "-0", "0").otherwise(t)


def coordinate(text: Column) -> Column:
    """A number with a decimal point or, alone, a decimal comma."""
    t = F.trim(text)
    t = F.when(~t.contains(".") & t.rlike("^[^,]*,[^,]*$"), F.replace(t, F.lit(","), F.lit("."))).otherwise(t)
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))


def plausible(lon: Column, lat: Column) -> Column:
    fine = lambda v, most: ~F.isnan(v) & (F.abs(v) <= most)
    return fine(lat, 90.000001) & fine(lon, 360.0)


def web_mercator_inverse(x: Column, y: Column) -> Column:
    """struct(lon, lat) in degrees from spherical Mercator metres."""
    return F.struct(F.degrees(x / A).alias("lon"), F.degrees(math.pi / 2 - 2 * F.atan(F.exp(-y / A))).alias("lat"))


def transverse_mercator_inverse(x: Column, y: Column, lon0: float, scale: float = 0.9996, false_east: float = 500_000.0, false_north: float = 0.0, a: float = A, inverse_flattening: float = INVERSE_FLATTENING) -> Column:
    """struct(lon, lat) in degrees, by Krueger's series in the third flattening n to the sixth order."""
    f = 1 / inverse_flattening
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    # Krueger's beta coefficients, by power of n.
    beta = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360 - 81 * n**5 / 512 + 96199 * n**6 / 604800,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440 + 46 * n**5 / 105 - 1118711 * n**6 / 3870720,
        17 * n**3 / 480 - 37 * n**4 / 840 - 209 * n**5 / 4480 + 5569 * n**6 / 90720,
        4397 * n**4 / 161280 - 11 * n**5 / 504 - 830251 * n**6 / 7257600,
        4583 * n**5 / 161280 - 108847 * n**6 / 3991680,
        20648693 * n**6 / 638668800,
    ]
    xi, eta = (y - false_north) / (scale * radius), (x - false_east) / (scale * radius)
    u, v = xi, eta
    for k, b in enumerate(beta, 1):
        u = u - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        v = v - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    # Krueger's delta coefficients, from the conformal to the geographic latitude.
    delta = [
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45 + 26 * n**5 / 45 - 2854 * n**6 / 675,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45 + 2704 * n**5 / 315 + 2323 * n**6 / 945,
        56 * n**3 / 15 - 136 * n**4 / 35 - 1262 * n**5 / 105 + 73814 * n**6 / 2835,
        4279 * n**4 / 630 - 332 * n**5 / 35 - 399572 * n**6 / 14175,
        4174 * n**5 / 315 - 144838 * n**6 / 6237,
        601676 * n**6 / 22275,
    ]
    conformal = F.asin(F.sin(u) / F.cosh(v))
    lat = conformal
    for k, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * k * conformal)
    return F.struct((lon0 + F.degrees(F.atan2(F.sinh(v), F.cos(u)))).alias("lon"), F.degrees(lat).alias("lat"))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6_371_008.8) -> Column:
    """Metres between two positions in degrees, on a sphere."""
    d = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(d))


def multi_kind(kinds: Column) -> Column:
    """The kind that parts make together: null, the one kind, its Multi form, or a collection."""
    distinct = F.array_distinct(kinds)
    return F.when(F.size(kinds) == 0, None).when(F.size(kinds) == 1, kinds[0]).when((F.size(distinct) == 1) & distinct[0].isin("Point", "LineString", "Polygon"), F.concat(F.lit("Multi"), distinct[0])).otherwise("GeometryCollection")


#: Tags that make a closed way an area, with the values that don't.
AREA_TAGS = {"building": (), "landuse": (), "natural": ("coastline", "cliff", "ridge", "arete", "tree_row"), "leisure": ("track", "slipway"), "amenity": (), "boundary": (), "place": (), "tourism": (), "waterway": ("river", "stream", "canal", "drain", "ditch", "weir", "dam")}


def is_area(tags: Column) -> Column:
    """Whether a closed way's tags (a map) make it an area; area=yes and area=no decide first."""
    out = F.when(tags["area"] == "yes", True).when(tags["area"] == "no", False)
    some = F.lit(False)
    for key, but in AREA_TAGS.items():
        hit = tags[key].isNotNull() & (tags[key] != "no")
        some = some | (hit & ~tags[key].isin(*but) if but else hit)
    return out.otherwise(F.coalesce(some, F.lit(False)))
