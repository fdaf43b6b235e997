"""Geometry, projections and their joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import crs
from ..functions import geo as g
from ..functions import mesh
from ..operators import geo as o
from .registry import query


def _ring(*points):
    return F.array(*[o.point(x if hasattr(x, "cast") else F.lit(x), y if hasattr(y, "cast") else F.lit(y)) for x, y in points])


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 2.0 * (n_nationkey + 1) * 10 * CASE WHEN n_nationkey % 3 = 1 THEN 1 ELSE -1 END END AS area, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 2.0 * (n_nationkey + 1) * 10 END AS oriented, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 5 END::INTEGER AS points FROM nation""".replace("2.0 *", "2.0::DOUBLE *"))
def ring_area(spark, table):
    """Closed, measured and turned counter-clockwise; a line with two positions is no ring."""
    w, k = (F.col("n_nationkey") + 1).cast("double"), F.col("n_nationkey") % 3
    ring = F.when(k == 0, _ring((0.0, 0.0), (w, 0.0))).when(k == 1, _ring((0.0, 0.0), (w, 0.0), (w, 10.0), (0.0, 10.0))).otherwise(_ring((0.0, 0.0), (0.0, 10.0), (w, 10.0), (w, 0.0), (0.0, 0.0)))
    r = table("nation").select("n_nationkey", g.closed(ring).alias("r"))
    return r.select("n_nationkey", g.signed_area(F.col("r")).alias("area"), g.signed_area(g.oriented(F.col("r"))).alias("oriented"), F.when(F.col("r").isNotNull(), F.size("r")).alias("points"))


@query("""SELECT c_custkey, x + y < 100 AND NOT (x + y < 50) AS inside FROM (SELECT c_custkey, (c_custkey * 37 % 101)::DOUBLE + 0.25 AS x, (c_custkey * 53 % 103)::DOUBLE + 0.125 AS y FROM customer)""")
def point_in_ring(spark, table):
    """A band between two diagonals."""
    k = F.col("c_custkey")
    c = table("customer").select("c_custkey", ((k * 37 % 101) + 0.25).cast("double").alias("x"), ((k * 53 % 103) + 0.125).cast("double").alias("y"))
    band = _ring((50.0, 0.0), (100.0, 0.0), (0.0, 100.0), (0.0, 50.0), (50.0, 0.0))
    return c.select("c_custkey", g.contains(band, F.col("x"), F.col("y")).alias("inside"))


@query("""SELECT c_custkey, arg_min(s_suppkey, (x1 - x0) * (y1 - y0) * 1000 + s_suppkey) AS s_suppkey FROM (SELECT c_custkey, (c_custkey * 37 % 1009)::DOUBLE AS x, (c_custkey * 53 % 1013)::DOUBLE AS y FROM customer) c
LEFT JOIN (SELECT s_suppkey, (s_suppkey * 71 % 900)::DOUBLE AS x0, (s_suppkey * 91 % 900)::DOUBLE AS y0, x0 + s_suppkey AS x1, y0 + 2 * s_suppkey AS y1 FROM supplier) b ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY c_custkey""")
def smallest_container(spark, table):
    k, b = F.col("c_custkey"), F.col("s_suppkey")
    points = table("customer").select("c_custkey", (k * 37 % 1009).cast("double").alias("x"), (k * 53 % 1013).cast("double").alias("y"))
    boxes = table("supplier").select("s_suppkey", (b * 71 % 900).cast("double").alias("x0"), (b * 91 % 900).cast("double").alias("y0"))
    boxes = boxes.withColumn("x1", F.col("x0") + b).withColumn("y1", F.col("y0") + 2 * b)
    return o.smallest_container(points, boxes, "c_custkey", "s_suppkey", 50.0)


@query("""SELECT s_suppkey AS hole, (SELECT max(n_nationkey) FROM nation WHERE s_suppkey % 200 < 200 - n_nationkey * 5 AND s_suppkey % 200 >= n_nationkey * 2) AS shell FROM supplier""")
def hole_assignment(spark, table):
    """Nested squares: a hole goes to the innermost one around it."""
    k, n = F.col("s_suppkey"), F.col("n_nationkey")
    at = (k % 200).cast("double")
    holes = table("supplier").select(F.col("s_suppkey").alias("hole"), F.array(o.point(at + 0.5, F.lit(100.5)), o.point(at + 0.7, F.lit(100.5)), o.point(at + 0.7, F.lit(100.7))).alias("ring"))
    a, b = (n * 2).cast("double"), (200 - n * 5).cast("double")
    shells = table("nation").select(n.alias("shell"), _ring((a, a), (b, a), (b, 200.0), (a, 200.0), (a, a)).alias("ring"))
    return o.holes_to_shells(holes, shells, "hole", "shell", 64.0)


_BOX = "x - 1000 * (s_suppkey % 9 + 1) AS x0, x + 1000 * (s_suppkey % 9 + 1) AS x1, y - 700 * (s_suppkey % 7 + 1) AS y0, y + 700 * (s_suppkey % 7 + 1) AS y1"


@query(f"""WITH s AS (SELECT s_nationkey % 3 AS record, s_suppkey AS o, {_BOX} FROM (SELECT *, (s_suppkey * 7919 % 20000)::DOUBLE AS x, (s_suppkey * 104729 % 20000)::DOUBLE AS y FROM supplier) UNION ALL SELECT n_nationkey % 3, -n_nationkey - 1, CASE WHEN n_nationkey % 3 = 2 THEN 1e9 ELSE 0 END - 1e6 * (n_nationkey + 1), CASE WHEN n_nationkey % 3 = 2 THEN 1e9 ELSE 0 END + 1e6 * (n_nationkey + 1), -1e6, 1e6 FROM nation),
h AS (SELECT c_nationkey % 3 AS record, c_custkey + 1000000 AS o, (c_custkey * 53 % 30000)::DOUBLE - 4999.5 AS x, (c_custkey * 7907 % 30000)::DOUBLE - 4999.75 AS y FROM customer),
p AS (SELECT h.record, h.o, arg_min(s.o, ((x1 - x0) * (y1 - y0), s.o)) AS shell FROM h JOIN s ON s.record = h.record AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY ALL),
a AS (SELECT record, o AS shell, o, false AS hole FROM s UNION ALL SELECT h.record, coalesce(p.shell, h.o), h.o, p.shell IS NOT NULL FROM h LEFT JOIN p ON p.record = h.record AND p.o = h.o),
n AS (SELECT record, CASE WHEN count(DISTINCT shell) = 1 THEN 'Polygon' ELSE 'MultiPolygon' END AS kind FROM a GROUP BY record)
SELECT record::BIGINT AS record, shell::BIGINT AS shell, kind, count(*) FILTER (hole) AS n_holes, coalesce(string_agg(o::VARCHAR, ',' ORDER BY o) FILTER (hole), '') AS holes FROM a JOIN n USING (record) GROUP BY ALL""")
def ring_polygons(spark, table):
    """Shells of many sizes, the largest of 50,000,000 cells, and triangles as holes, put together into one geometry a record."""
    k, c, n = F.col("s_suppkey"), F.col("c_custkey"), F.col("n_nationkey")
    box = lambda x0, y0, x1, y1: _ring((x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0))  # noqa: E731  clockwise
    x, y, w, h = (k * 7919 % 20_000).cast("double"), (k * 104_729 % 20_000).cast("double"), 1000 * (k % 9 + 1), 700 * (k % 7 + 1)
    shells = table("supplier").select((F.col("s_nationkey") % 3).cast("long").alias("record"), k.cast("long").alias("o"), box(x - w, y - h, x + w, y + h).alias("ring"))
    away = F.when(n % 3 == 2, 1e9).otherwise(0.0)  # the holes of one record are in none of its large shells
    huge = table("nation").select((n % 3).cast("long").alias("record"), (-n - 1).cast("long").alias("o"), box(away - 1e6 * (n + 1), F.lit(-1e6), away + 1e6 * (n + 1), F.lit(1e6)).alias("ring"))
    hx, hy = (c * 53 % 30_000) - 4999.5, (c * 7907 % 30_000) - 4999.75
    holes = table("customer").select((F.col("c_nationkey") % 3).cast("long").alias("record"), (c + 1_000_000).cast("long").alias("o"), _ring((hx, hy), (hx + 0.25, hy), (hx + 0.25, hy + 0.25)).alias("ring"))
    parts = o.polygons(shells.unionAll(huge).unionAll(holes), "record", "o", 200.0)
    whole = o.gathered(parts.withColumn("kind", F.lit("Polygon")), "record", "place", "kind", "holes").select("record", "kind")
    out = parts.join(whole, "record").select("record", F.col("place.shell").alias("shell"), "kind", F.col("holes"))
    return out.select("record", "shell", "kind", F.size("holes").cast("long").alias("n_holes"), F.array_join(F.col("holes").cast("array<string>"), ",").alias("holes"))


@query("""SELECT c_custkey, round(degrees(x / 6378137.0), 6) AS lon, round(degrees(pi() / 2 - 2 * atan(exp(-y / 6378137.0))), 6) AS lat FROM (SELECT c_custkey, (c_custkey * 7919 % 20000000)::DOUBLE - 10000000 AS x, (c_custkey * 104729 % 18000000)::DOUBLE - 9000000 AS y FROM customer)""")
def web_mercator_inverse(spark, table):
    k = F.col("c_custkey")
    p = table("customer").select("c_custkey", g.web_mercator_inverse((k * 7919 % 20_000_000).cast("double") - 10_000_000, (k * 104_729 % 18_000_000).cast("double") - 9_000_000).alias("p"))
    return p.select("c_custkey", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))


@query("""SELECT c_custkey, 9 + (c_custkey % 49 - 24)::DOUBLE / 8 AS lon, (c_custkey % 161)::DOUBLE / 2 AS lat FROM customer""")
def utm_inverse(spark, table):
    """Customers on the map of a zone, back to degrees."""
    k = F.col("c_custkey")
    p = table("customer").select("c_custkey", crs.of_epsg(32632).xy(9 + (k % 49 - 24) / 8, (k % 161) / 2).alias("q"))
    p = p.select("c_custkey", g.transverse_mercator_inverse(F.col("q.x"), F.col("q.y"), 9.0).alias("p"))
    return p.select("c_custkey", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))


@query("""SELECT n_nationkey, (n_nationkey::DECIMAL(20,1) / 2)::DECIMAL(20,1)::VARCHAR AS t FROM nation WHERE n_nationkey % 2 = 1 UNION ALL SELECT n_nationkey, (n_nationkey // 2)::VARCHAR FROM nation WHERE n_nationkey % 2 = 0""")
def degrees_text(spark, table):
    return table("nation").select("n_nationkey", g.degrees_text(F.col("n_nationkey") / 2).alias("t"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'POINT (' || c_custkey || ' 2.5)' WHEN 1 THEN 'LINESTRING (0 0, ' || c_custkey || ' -2)' WHEN 2 THEN 'POLYGON ((0 0, ' || c_custkey || ' 0, ' || c_custkey || ' 1, 0 0))' WHEN 3 THEN 'MULTIPOINT (1 2, ' || c_custkey || ' 4)' END AS text FROM customer""")
def wkt_round_trip(spark, table):
    """Customers' shapes in several spellings, read and printed again; a point of letters is none."""
    k = F.col("c_custkey").cast("string")
    cat = lambda *parts: F.concat(*[p if hasattr(p, "cast") else F.lit(p) for p in parts])
    spelt = [cat("point(", k, " 2.50)"), cat("SRID=4326;LineString (0 0, ", k, " -2)"), cat("POLYGON((0 0,", k, " 0,", k, " 1,0 0))"), cat("MULTIPOINT(1 2,(", k, " 4))"), cat("POINT(x", k, " 1)")]
    wkt = F.coalesce(*[F.when(F.col("c_custkey") % 5 == i, t) for i, t in enumerate(spelt)])
    return o.parse_wkt(table("customer").select("c_custkey", wkt.alias("wkt")), "wkt").select("c_custkey", "text")


@query("""SELECT n_regionkey, 1::BIGINT AS rings, count(*) + 1 AS positions FROM nation GROUP BY n_regionkey""")
def ring_chaining(spark, table):
    """Ways of two nodes each, half of them reversed, joined into one ring a region."""
    from pyspark.sql import Window

    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    n = table("nation").withColumn("next", F.coalesce(F.lead("n_nationkey").over(w), F.first("n_nationkey").over(w)))
    a, b = F.col("n_nationkey").cast("long"), F.col("next").cast("long")
    ways = n.select("n_regionkey", (F.col("n_nationkey") * 7 % 25).alias("at"), F.when(F.col("n_nationkey") % 2 == 0, F.array(a, b)).otherwise(F.array(b, a)).alias("nodes"))
    return o.chained(ways, "n_regionkey", "at", "nodes").groupBy("n_regionkey").agg(F.count("ring").alias("rings"), F.sum(F.size("ring")).alias("positions"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_custkey + 0.5 WHEN 1 THEN -c_custkey WHEN 2 THEN c_custkey * 10.0 WHEN 3 THEN c_custkey + 0.25 END::DOUBLE AS value FROM customer""")
def coordinate_text(spark, table):
    """Numbers with decimal commas and points, signs and exponents; with both marks a text is none."""
    k = F.col("c_custkey").cast("string")
    text = [F.concat(k, F.lit(",5")), F.concat(F.lit(" -"), k, F.lit(" ")), F.concat(k, F.lit("e1")), F.concat(k, F.lit(".25")), F.concat(F.lit("1,"), k, F.lit(".5"))]
    return table("customer").select("c_custkey", g.coordinate(F.coalesce(*[F.when(F.col("c_custkey") % 5 == i, t) for i, t in enumerate(text)])).alias("value"))


@query("""SELECT o_orderkey, o_orderkey % 6 IN (0, 2, 4) AS area FROM orders""")
def area_tags(spark, table):
    """Orders as closed ways with one of six tags."""
    tags = [("building", F.col("o_orderpriority")), ("natural", F.lit("coastline")), ("natural", F.lit("water")), ("highway", F.lit("service")), ("area", F.lit("yes")), ("building", F.lit("no"))]
    own = F.coalesce(*[F.when(F.col("o_orderkey") % 6 == i, F.create_map(F.lit(k), v)) for i, (k, v) in enumerate(tags)])
    return table("orders").select("o_orderkey", g.is_area(own).alias("area"))


@query("""SELECT a.n_nationkey, round(2 * 6371008.8 * asin(sqrt(pow(sin(radians(a.n_nationkey) / 2), 2) + cos(radians(10)) * cos(radians(10 + a.n_nationkey)) * pow(sin(radians(a.n_regionkey) / 2), 2))), 3) AS metres FROM nation a""")
def haversine(spark, table):
    k, r = F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double")
    return table("nation").select("n_nationkey", F.round(g.haversine(F.lit(5.0), F.lit(10.0), 5.0 + r, 10.0 + k), 3).alias("metres"))


def _definition(kind, datum, *parameters, unit="1"):
    return f'PROJCS["own",GEOGCS["own",{datum},PRIMEM["Greenwich",0],UNIT["Degree",0.0174532925199433]],PROJECTION["{kind}"],' + ",".join(f'PARAMETER["{k}",{v}]' for k, v in parameters) + f',UNIT["u",{unit}]]'


_GRS, _BESSEL = 'DATUM["D_ETRS_1989",SPHEROID["GRS_1980",6378137,298.257222101]]', 'DATUM["D_Deutsches_Hauptdreiecksnetz",SPHEROID["Bessel_1841",6377397.155,299.1528128]]'
#: By remainder: a system and the middle of where it is used.
_SYSTEMS = [
    ("EPSG:32632", 9, 48), ("EPSG:3857", 0, 0), (_definition("Mercator", _GRS, ("Central_Meridian", 20), ("Standard_Parallel_1", 30)), 20, 10), (_definition("Lambert_Conformal_Conic", _GRS, ("Standard_Parallel_1", 44), ("Standard_Parallel_2", 49), ("Latitude_Of_Origin", 46.5), ("Central_Meridian", 3), ("False_Easting", 700000), ("False_Northing", 6600000)), 3, 46),
    (_definition("Albers", _BESSEL, ("Standard_Parallel_1", 30), ("Standard_Parallel_2", 45), ("Latitude_Of_Origin", 23), ("Central_Meridian", -96), unit="0.3048"), -96, 38), (_definition("Transverse_Mercator", _BESSEL, ("Central_Meridian", 12), ("Latitude_Of_Origin", 49), ("False_Easting", 4500000)), 12, 50), ("EPSG:2000", 0, 0),
]


@query("""SELECT c_custkey, CASE WHEN k < 6 THEN lon END AS lon, CASE WHEN k < 6 THEN lat END AS lat, CASE WHEN k < 6 THEN k IN (4, 5) END AS approximate, CASE WHEN k = 6 THEN 'EPSG:2000' END AS crs_error
FROM (SELECT c_custkey, c_custkey % 7 AS k, """ + "".join(f"CASE WHEN c_custkey % 7 = {i} THEN {lon} " if not i else f"WHEN c_custkey % 7 = {i} THEN {lon} " for i, (_, lon, _) in enumerate(_SYSTEMS)) + """END + (c_custkey % 25 - 12)::DOUBLE / 8 AS lon, """ + "".join(f"CASE WHEN c_custkey % 7 = {i} THEN {lat} " if not i else f"WHEN c_custkey % 7 = {i} THEN {lat} " for i, (_, _, lat) in enumerate(_SYSTEMS)) + """END + (c_custkey % 33 - 16)::DOUBLE / 8 AS lat FROM customer)""")
def located(spark, table):
    """Customers on the maps of seven systems, one of them unknown, back to degrees within 1e-9."""
    k = F.col("c_custkey") % 7
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    c = table("customer").select("c_custkey", k.alias("k"), pick([s for s, _, _ in _SYSTEMS]).alias("crs"), (pick([lon for _, lon, _ in _SYSTEMS]) + (F.col("c_custkey") % 25 - 12) / 8).alias("lon0"), (pick([lat for _, _, lat in _SYSTEMS]) + (F.col("c_custkey") % 33 - 16) / 8).alias("lat0"))
    at = F.struct(F.col("lon0").alias("x"), F.col("lat0").alias("y"))
    for i, (text, _, _) in enumerate(_SYSTEMS[:6]):
        at = F.when(F.col("k") == i, crs.of(text).xy(F.col("lon0"), F.col("lat0"))).otherwise(at)
    c = c.withColumn("p", at).select("c_custkey", "crs", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    return crs.located(c, "x", "y", "crs").select("c_custkey", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), "approximate", "crs_error")


@query("""SELECT l_orderkey, n + 2 AS corners, n AS triangles, (SELECT sum(2.0 + k % 2 + (k + 1) % 2) FROM range(1, n) r(k))::DOUBLE AS area2 FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) WHERE n > 1""")
def triangulation(spark, table):
    """The lines of an order as a skyline of two heights over a base, cut into triangles whose doubled areas add up to that of its trapezoids."""
    n = F.col("n").cast("int")
    at = lambda k, z: F.struct(k.cast("double").alias("x"), F.lit(3.0).alias("y"), z.cast("double").alias("z"))
    sky = F.transform(F.sequence(F.lit(1), n), lambda k: at(k, 1 + k % 2))
    face = table("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n > 1").select("l_orderkey", F.concat(sky, F.array(at(n, F.lit(0)), at(F.lit(1), F.lit(0)))).alias("face"))
    cut = face.select("l_orderkey", "face", mesh.triangulated(F.col("face")).alias("t"))
    p = lambda k: F.get("face", k)
    double = lambda t: F.abs((p(t["b"])["x"] - p(t["a"])["x"]) * (p(t["c"])["z"] - p(t["a"])["z"]) - (p(t["b"])["z"] - p(t["a"])["z"]) * (p(t["c"])["x"] - p(t["a"])["x"]))
    return cut.select("l_orderkey", F.size("face").cast("long").alias("corners"), F.size("t").cast("long").alias("triangles"), F.aggregate(F.transform("t", double), F.lit(0.0), lambda acc, v: acc + v).alias("area2"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 AND c_custkey % 100 <= 90 THEN 'POINT' END AS kind, CASE WHEN c_custkey % 5 > 0 AND c_custkey % 100 <= 90 THEN 'POINT (' || c_nationkey || CASE WHEN c_custkey % 2 = 0 THEN '.5' ELSE '' END || ' ' || c_custkey % 100 || ')' END AS text FROM customer""")
def placed_rows(spark, table):
    """Places of customers found by their headers, with decimal commas; missing ones and latitudes beyond the poles have no geometry."""
    k = F.col("c_custkey")
    lon = F.when(k % 5 > 0, F.concat(F.col("c_nationkey").cast("string"), F.when(k % 2 == 0, ",5").otherwise("")))
    return o.placed_rows(table("customer").select("c_custkey", lon.alias("Lon."), (k % 100).cast("string").alias("LATITUDE")))
