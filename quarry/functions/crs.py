"""Coordinate reference systems: definitions read on the driver into constants, positions computed by column expressions.

A system comes from an EPSG code, a name or a definition in well-known text of the first version; what is not known is refused, never
guessed. ``Crs.lon_lat`` gives degrees from Greenwich, ``Crs.xy`` goes the other way. Latitudes on the ellipsoid have no closed form:
they are a fold of a few rounds over a short array, which keeps one expression instead of one that doubles with every round.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geo import transverse_mercator_inverse

#: Rounds until a latitude moves by less than a double can tell.
ROUNDS = 9

#: Codes of systems in degrees whose datum agrees with WGS 84, of spherical web maps, and the zones of UTM.
DEGREES = (4326, 4269, 4258, 4283, 7844, 4490, 6318, 4167, 4612, 6668, 4674, 4171, 9777)
WEB = (3857, 900913, 3785, 102100, 102113)
GRS80 = 298.257222101
UTM = ((32600, 1, 60, False, 298.257223563), (32700, 1, 60, True, 298.257223563), (26900, 1, 23, False, GRS80), (25800, 28, 38, False, GRS80))
#: Parts of the names of datums that agree with WGS 84 within some metres.
AGREEING = """WGS1984 WGS84 NORTHAMERICAN1983 NAD83 ETRS89 ETRS1989 EUROPEANTERRESTRIALREFERENCESYSTEM1989 GRS1980 KOREA2000 CHINA2000 CGCS2000
CHINAGEODETICCOORDINATESYSTEM2000 JGD2011 JGD2000 JAPANGEODETICDATUM GDA94 GDA2020 GEOCENTRICDATUMOFAUSTRALIA NZGD2000 NEWZEALANDGEODETICDATUM2000
SIRGAS2000 SIRGAS RGF93 RESEAUGEODESIQUEFRANCAIS1993 ITRF HARN NSRS2007""".split()
#: Names of projections, without case and punctuation.
PROJECTIONS = {
    "tmerc": "transversemercator gausskruger gausskrugerzone tmerc",
    "web": "mercatorauxiliarysphere popularvisualisationpseudomercator popularvisualizationpseudomercator",
    "merc": "mercator mercator1sp mercator2sp",
    "lcc": "lambertconformalconic lambertconformalconic2sp lambertconformalconic1sp lambertconformalconicbelgium",
    "albers": "albersconicequalarea albers albersequalareaconic",
}


class UnknownCrs(ValueError):
    """A system that is not known or not supported."""


def plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def _folded(start: Column, step) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda at, _: step(at))


@dataclass(frozen=True)
class Crs:
    """Angles in degrees, lengths in metres; ``unit`` metres, or for ``kind`` "degrees" degrees, are one of the system's own units."""

    name: str
    kind: str
    a: float = 6378137.0
    flattening: float = 1 / 298.257223563
    lat0: float = 0.0
    lon0: float = 0.0
    parallels: tuple[float, float] = (0.0, 0.0)
    scale: float = 1.0
    east: float = 0.0
    north: float = 0.0
    unit: float = 1.0
    approximate: bool = False

    # Constants of the ellipsoid and of the cones.

    @property
    def e2(self) -> float:
        return self.flattening * (2 - self.flattening)

    @property
    def e(self) -> float:
        return math.sqrt(self.e2)

    def isometric(self, lat: float) -> float:
        s = math.sin(math.radians(lat))
        return math.atanh(s) - self.e * math.atanh(self.e * s)

    def authalic(self, lat: float) -> float:
        s = math.sin(math.radians(lat))
        return (1 - self.e2) * (s / (1 - self.e2 * s * s) + (math.atanh(self.e * s) / self.e if self.e else s))

    def breadth(self, lat: float) -> float:
        """Radius of a parallel, the axis being 1."""
        s = math.sin(math.radians(lat))
        return math.cos(math.radians(lat)) / math.sqrt(1 - self.e2 * s * s)

    def cone(self) -> tuple[float, float, float]:
        """The cone's constant, the factor of its radii, and the radius at the origin."""
        p, q = self.parallels
        if self.kind == "lcc":
            n = math.sin(math.radians(p)) if p == q else (math.log(self.breadth(p)) - math.log(self.breadth(q))) / (self.isometric(q) - self.isometric(p))
            factor = self.a * self.scale * self.breadth(p) * math.exp(n * self.isometric(p)) / n
            return n, factor, factor * math.exp(-n * self.isometric(self.lat0))
        n = math.sin(math.radians(p)) if p == q else (self.breadth(p) ** 2 - self.breadth(q) ** 2) / (self.authalic(q) - self.authalic(p))
        c = self.breadth(p) ** 2 + n * self.authalic(p)
        return n, c, self.a * math.sqrt(c - n * self.authalic(self.lat0)) / n

    def kruger(self) -> tuple[float, list[float]]:
        """The radius of the rectifying sphere and the forward series of the transverse projection."""
        n = self.flattening / (2 - self.flattening)
        # Krueger's alpha coefficients, by power of n.
        alpha = [
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
            13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
            61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
            49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
            34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
            212378941 * n**6 / 319334400,
        ]
        return self.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256), alpha

    def arc(self) -> float:
        """The length of the meridian from the equator to the latitude of the origin."""
        radius, alpha = self.kruger()
        xi = math.atan(math.sinh(self.isometric(self.lat0)))
        return radius * (xi + sum(c * math.sin(2 * k * xi) for k, c in enumerate(alpha, 1)))

    # Expressions.

    def _isometric(self, lat: Column) -> Column:
        s = F.sin(lat)
        return F.atanh(s) - self.e * F.atanh(self.e * s)

    def _lat_of_isometric(self, q: Column) -> Column:
        """Latitude in radians; atan(sinh) keeps its digits up to the poles."""
        start = F.atan(F.sinh(q))
        return _folded(start, lambda lat: F.atan(F.sinh(q + self.e * F.atanh(self.e * F.sin(lat))))) if self.e else start

    def _lat_of_authalic(self, q: Column) -> Column:
        pole = self.authalic(90)
        start = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / pole)))
        if not self.e:
            return start

        def step(lat: Column) -> Column:
            s = F.sin(lat)
            w = 1 - self.e2 * s * s
            return lat + w * w / (2 * F.cos(lat)) * (q / (1 - self.e2) - s / w - F.atanh(self.e * s) / self.e)

        return F.when(F.abs(q) >= pole * (1 - 1e-15), start).otherwise(_folded(start, step))

    def lon_lat(self, x: Column, y: Column) -> Column:
        """struct(lon, lat) in degrees."""
        x, y = x.cast("double"), y.cast("double")
        if self.kind == "degrees":
            return F.struct((x * self.unit + self.lon0).alias("lon"), (y * self.unit).alias("lat"))
        x, y = x * self.unit - self.east, y * self.unit - self.north
        if self.kind == "tmerc":
            return transverse_mercator_inverse(x, y, self.lon0, self.scale, 0.0, -self.scale * self.arc(), self.a, 1 / self.flattening if self.flattening else math.inf)
        if self.kind == "merc":
            r = self.a * self.scale
            return F.struct((self.lon0 + F.degrees(x / r)).alias("lon"), F.degrees(self._lat_of_isometric(y / r)).alias("lat"))
        n, factor, rho0 = self.cone()
        sign = math.copysign(1, n)
        dx, dy = sign * x, sign * (rho0 - y)
        lon = self.lon0 + F.degrees(F.atan2(dx, dy) / n)
        rho2 = dx * dx + dy * dy
        if self.kind == "lcc":
            # At the tip of the cone, a pole, there is no logarithm.
            q = F.when(rho2 == 0, F.lit(math.copysign(math.inf, n))).otherwise(-F.log(F.sqrt(rho2) * sign / factor) / n)
            lat = self._lat_of_isometric(q)
        else:
            lat = self._lat_of_authalic((factor - rho2 * n * n / self.a**2) / n)
        return F.struct(lon.alias("lon"), F.degrees(lat).alias("lat"))

    def xy(self, lon: Column, lat: Column) -> Column:
        """struct(x, y) in the system's own units."""
        lon, lat = lon.cast("double"), lat.cast("double")
        if self.kind == "degrees":
            return F.struct(((lon - self.lon0) / self.unit).alias("x"), (lat / self.unit).alias("y"))
        d, phi = F.radians(lon - self.lon0), F.radians(lat)
        if self.kind == "tmerc":
            radius, alpha = self.kruger()
            t = F.sinh(self._isometric(phi))
            xi, eta = F.atan2(t, F.cos(d)), F.asinh(F.sin(d) / F.sqrt(t * t + F.cos(d) * F.cos(d)))
            u, v = xi, eta
            for k, c in enumerate(alpha, 1):
                u = u + c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
                v = v + c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
            x, y = self.scale * radius * v, self.scale * (radius * u - self.arc())
        elif self.kind == "merc":
            x, y = self.a * self.scale * d, self.a * self.scale * self._isometric(phi)
        else:
            n, factor, rho0 = self.cone()
            if self.kind == "lcc":
                rho = factor * F.exp(-n * self._isometric(phi))
            else:
                s = F.sin(phi)
                q = (1 - self.e2) * (s / (1 - self.e2 * s * s) + (F.atanh(self.e * s) / self.e if self.e else s))
                rho = self.a * F.sqrt(factor - n * q) / n
            x, y = rho * F.sin(n * d), rho0 - rho * F.cos(n * d)
        return F.struct(((x + self.east) / self.unit).alias("x"), ((y + self.north) / self.unit).alias("y"))


def of_epsg(code: int) -> Crs:
    """The system of an EPSG code."""
    if code in DEGREES:
        return Crs(f"EPSG:{code}", "degrees")
    if code in WEB:
        return Crs("WGS 84 / Pseudo-Mercator", "merc", flattening=0.0)
    for base, first, last, south, inverse in UTM:
        if first <= code - base <= last:
            zone = code - base
            return Crs(f"EPSG:{code}", "tmerc", flattening=1 / inverse, lon0=zone * 6.0 - 183, scale=0.9996, east=500_000.0, north=10_000_000.0 if south else 0.0)
    raise UnknownCrs(f"EPSG:{code}")


def of_name(name: str) -> Crs:
    """The system of a name such as EPSG:4326, urn:ogc:def:crs:EPSG::3857 or CRS84."""
    if re.search(r"CRS:?84", name, re.IGNORECASE):
        return of_epsg(4326)
    if m := re.search(r"EPSG\D*.*?(\d{1,9})\s*$", name, re.IGNORECASE):
        return of_epsg(int(m[1]))
    raise UnknownCrs(name)


Node = tuple[str, list]


def nodes(text: str) -> Node:
    """Well-known text as (keyword, values and nodes); 32 levels at most."""
    tokens = re.findall(r'\s*("(?:[^"]|"")*"|[\[\](),]|[^\s\[\](),"]+)', text)
    at, stack = 0, []
    root: Node | None = None
    while at < len(tokens):
        t = tokens[at]
        if at + 1 < len(tokens) and tokens[at + 1] in ("[", "(") and t[0] not in '"[](),':
            node: Node = (t.upper(), [])
            if stack:
                stack[-1][1].append(node)
            elif root is not None:
                raise UnknownCrs("more than one definition")
            else:
                root = node
            stack.append(node)
            at += 1
        elif t in ("]", ")"):
            if not stack:
                raise UnknownCrs("brackets")
            stack.pop()
        elif t != ",":
            if not stack:
                raise UnknownCrs(text[:80])
            stack[-1][1].append(t[1:-1].replace('""', '"') if t[0] == '"' else t)
        if len(stack) > 32:
            raise UnknownCrs("too many levels")
        at += 1
    if root is None or stack:
        raise UnknownCrs("brackets")
    return root


def _child(node: Node | None, name: str, last: bool = False) -> Node | None:
    found = [c for c in node[1] if isinstance(c, tuple) and c[0] == name] if node else []
    return found[-1 if last else 0] if found else None


def _text(node: Node | None) -> str | None:
    return node[1][0] if node and node[1] and isinstance(node[1][0], str) else None


def _number(node: Node | None) -> float | None:
    try:
        return float(node[1][1]) if node else None
    except (IndexError, TypeError, ValueError):
        return None


def agrees(datum: str, a: float | None, inverse: float | None) -> bool:
    """Does a datum agree with WGS 84 within some metres, by its ellipsoid or its name?"""
    if a is not None and inverse is not None and abs(a - 6378137) < 0.01 and abs(inverse - 298.2572) < 0.001:
        return True
    key = plain(datum.removeprefix("D_")).upper()
    return any(name in key for name in AGREEING)


def of_wkt(text: str) -> Crs:
    """The system of a definition in well-known text, as .prj files have it."""
    if len(text) > 1 << 16:
        raise UnknownCrs("a definition that is too long")
    root = nodes(text)
    if root[0] == "COMPD_CS":
        root = _child(root, "PROJCS") or _child(root, "GEOGCS") or root
    if root[0] not in ("GEOGCS", "PROJCS"):
        raise UnknownCrs(_text(root) or root[0])
    geographic = root if root[0] == "GEOGCS" else _child(root, "GEOGCS")
    name = _text(root) or root[0]
    if geographic is None:
        raise UnknownCrs(name)
    datum = _child(geographic, "DATUM")
    spheroid = _child(datum, "SPHEROID")
    axis = _number(spheroid)
    try:
        inverse = float(spheroid[1][2]) if spheroid else None
    except (IndexError, TypeError, ValueError):
        inverse = None
    approximate = not agrees(_text(datum) or _text(geographic) or name, axis, inverse)
    angle, meridian = _number(_child(geographic, "UNIT")), _number(_child(geographic, "PRIMEM")) or 0.0
    degrees = 1.0 if angle is None or abs(math.degrees(angle) - 1) < 1e-9 else math.degrees(angle)
    if root is geographic:
        return Crs(name, "degrees", lon0=meridian, unit=degrees, approximate=approximate)
    # Longitudes from another meridian, or angles in other units, would move everything: neither is applied, so neither is taken.
    if abs(meridian) > 1e-9 or degrees != 1.0:
        raise UnknownCrs(f"{name} (prime meridian or angular unit)")
    if axis is None or axis <= 0:
        raise UnknownCrs(f"{name} (no ellipsoid)")
    unit = _number(_child(root, "UNIT", last=True))
    unit = 1.0 if unit is None else unit
    if unit <= 0:
        raise UnknownCrs(f"{name} (unit)")
    kinds = {alias: kind for kind, aliases in PROJECTIONS.items() for alias in aliases.split()}
    kind = kinds.get(plain(_text(_child(root, "PROJECTION")) or ""))
    if kind is None:
        raise UnknownCrs(f"{name} ({_text(_child(root, 'PROJECTION'))})")
    given: dict[str, float] = {}
    for c in root[1]:
        if isinstance(c, tuple) and c[0] == "PARAMETER" and _text(c) is not None and _number(c) is not None:
            given.setdefault(plain(_text(c)), _number(c))
    get = lambda key, other=0.0: given.get(key, other)
    lat0 = get("latitudeoforigin")
    out = Crs(name, kind, axis, 1 / inverse if inverse else 0.0, lat0, get("centralmeridian"), scale=get("scalefactor", 1.0), east=get("falseeasting") * unit, north=get("falsenorthing") * unit, unit=unit, approximate=approximate)
    if kind in ("web", "merc"):
        sphere = kind == "web" or re.search(r"Pseudo|Web[ _]Mercator", name, re.IGNORECASE)
        out = replace(out, kind="merc", lat0=0.0, flattening=0.0 if sphere else out.flattening, scale=1.0 if kind == "web" else out.scale)
        if kind == "merc" and "standardparallel1" in given:
            out = replace(out, scale=out.breadth(given["standardparallel1"]))
    elif kind == "lcc":
        first = get("standardparallel1", lat0)
        out = replace(out, parallels=(first, get("standardparallel2", first)))
    elif kind == "albers":
        out = replace(out, parallels=(get("standardparallel1"), get("standardparallel2")), scale=1.0)
    return out


def of(text: str) -> Crs:
    """A definition or a name, by its look."""
    return of_wkt(text) if re.match(r"\s*[A-Za-z_]+\s*[\[(]", text) else of_name(text)


def located(df: DataFrame, x: str, y: str, crs: str) -> DataFrame:
    """``df`` with lon, lat, approximate and crs_error. ``crs`` is a column of names and definitions.

    The systems that occur are read once each, and every one is a branch of an expression; a row whose system is not known has nulls and
    the reason. Rows without a system are taken as degrees.
    """
    found = [r[0] for r in df.select(crs).where(F.col(crs).isNotNull()).distinct().collect()]
    at, rough, error = F.struct(F.col(x).cast("double").alias("lon"), F.col(y).cast("double").alias("lat")), F.lit(False), F.lit(None).cast("string")
    branches = {}
    for text in sorted(found):
        try:
            branches[text] = of(text)
        except UnknownCrs as e:
            branches[text] = str(e)
    nothing = F.lit(None).cast("struct<lon: double, lat: double>")
    for text, c in branches.items():
        own, known = F.col(crs) == text, isinstance(c, Crs)
        at = F.when(own, c.lon_lat(F.col(x), F.col(y)) if known else nothing).otherwise(at)
        rough = F.when(own, F.lit(c.approximate if known else None).cast("boolean")).otherwise(rough)
        error = F.when(own, F.lit(None if known else c).cast("string")).otherwise(error)
    return df.withColumn("_at", at).withColumns({"lon": F.col("_at.lon"), "lat": F.col("_at.lat"), "approximate": rough, "crs_error": error}).drop("_at")
