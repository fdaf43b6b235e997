import pytest
from pyspark.sql import functions as F

from quarry.functions import crs as c

CLARKE = 'GEOGCS["Clarke",DATUM["D_North_American_1927",SPHEROID["Clarke_1866",6378206.4,294.9786982]],PRIMEM["Greenwich",0],UNIT["Degree",0.0174532925199433]]'
GRS = 'GEOGCS["g",DATUM["D_ETRS_1989",SPHEROID["GRS_1980",6378137,298.257222101]],PRIMEM["Greenwich",0],UNIT["Degree",0.0174532925199433]]'


def projected(kind, geographic=CLARKE, unit='UNIT["Meter",1]', **parameters):
    return f'PROJCS["p",{geographic},PROJECTION["{kind}"],' + ",".join(f'PARAMETER["{k}",{v}]' for k, v in parameters.items()) + f",{unit}]"


LCC = projected("Lambert_Conformal_Conic", Standard_Parallel_1=33, Standard_Parallel_2=45, Latitude_Of_Origin=23, Central_Meridian=-96)
ALBERS = projected("Albers", standard_parallel_1=29.5, standard_parallel_2=45.5, latitude_of_origin=23, central_meridian=-96)
MERCATOR = projected("Mercator", Central_Meridian=180)
TM = projected("Transverse_Mercator", Central_Meridian=-75, Scale_Factor=0.9996, Latitude_Of_Origin=0)
FEET = projected("Transverse_Mercator", GRS, 'UNIT["Foot",0.3048]', central_meridian=-90, scale_factor=0.99995, latitude_of_origin=30, false_easting=1_000_000, false_northing=500)
SOUTH = projected("Lambert_Conformal_Conic_1SP", GRS, Latitude_Of_Origin=-40, Central_Meridian=170, Scale_Factor=0.9999, False_Easting=300_000, False_Northing=7_000_000)
SPHERE = projected("Albers", 'GEOGCS["s",DATUM["s",SPHEROID["s",6371000,0]]]', standard_parallel_1=-20, standard_parallel_2=-50)

#: Published examples for the ellipsoid of Clarke, 1866: definition, longitude, latitude, x, y in metres.
PUBLISHED = [(LCC, -75, 35, 1894410.9, 1564649.5), (ALBERS, -75, 35, 1885472.7, 1535925.0), (TM, -73.5, 40.5, 127106.5, 4484124.4)]


def one(spark, column):
    return spark.range(1).select(column.alias("p")).first()["p"]


@pytest.mark.parametrize("wkt, lon, lat, x, y", PUBLISHED)
def test_published_examples(spark, wkt, lon, lat, x, y):
    crs = c.of(wkt)
    p = one(spark, crs.xy(F.lit(lon), F.lit(lat)))
    assert abs(p["x"] - x) < 0.06 and abs(p["y"] - y) < 0.06
    back = one(spark, crs.lon_lat(F.lit(x), F.lit(y)))
    assert abs(back["lon"] - lon) < 1e-6 and abs(back["lat"] - lat) < 1e-6 and crs.approximate


SYSTEMS = [LCC, ALBERS, MERCATOR, TM, FEET, SOUTH, SPHERE, "EPSG:32632", "EPSG:32733", "EPSG:3857", "EPSG:25832", "CRS84", projected("Mercator_2SP", GRS, standard_parallel_1=42, central_meridian=51)]


@pytest.mark.parametrize("text", SYSTEMS)
def test_there_and_back(spark, text):
    crs = c.of(text)
    lat0 = (crs.parallels[0] + crs.parallels[1]) / 2 if crs.kind in ("lcc", "albers") else 0
    k = F.col("id")
    lon = crs.lon0 + ((k % 61) - 30) * (0.1 if crs.kind == "tmerc" else 1.0)
    lat = F.lit(lat0) + ((k % 71) - 35) * (1.0 if crs.kind in ("lcc", "albers") else 2.4)
    p = spark.range(61 * 71).select(lon.alias("lon"), F.greatest(F.lit(-89.0), F.least(F.lit(89.0), lat)).alias("lat")).withColumn("p", crs.xy(F.col("lon"), F.col("lat")))
    back = p.select("lon", "lat", crs.lon_lat(F.col("p.x"), F.col("p.y")).alias("q"))
    worst = back.agg(F.max(F.abs(F.col("q.lon") - F.col("lon"))), F.max(F.abs(F.col("q.lat") - F.col("lat"))), F.count_if(F.isnan("q.lat") | F.col("q.lat").isNull())).first()
    assert worst[0] < 1e-9 and worst[1] < 1e-9 and worst[2] == 0


def test_poles(spark):
    for text in (MERCATOR, LCC, ALBERS):
        p = one(spark, c.of(text).xy(F.lit(-90.0), F.lit(90.0 if text != MERCATOR else 89.9999999)))
        assert abs(one(spark, c.of(text).lon_lat(F.lit(p["x"]), F.lit(p["y"])))["lat"] - 90) < 1e-6


def test_names():
    assert c.of_name(" urn:ogc:def:crs:EPSG::4326").kind == "degrees" == c.of_name("urn:ogc:def:crs:OGC:1.3:CRS84").kind
    assert c.of_name("epsg:26917").lon0 == -81 and c.of_name("EPSG:32701").north == 1e7
    for bad in ("EPSG:2154", "EPSG:", "nothing", "ESRI:102100x", "EPSG:26924", "EPSG:25827"):
        with pytest.raises(c.UnknownCrs):
            c.of_name(bad)


def test_definitions():
    paris = c.of('GEOGCS["Paris",DATUM["NTF",SPHEROID["Clarke 1880",6378249.2,293.4660212936269]],PRIMEM["Paris",2.33722917],UNIT["Grad",0.01570796326794897]]')
    assert paris.kind == "degrees" and abs(paris.unit - 0.9) < 1e-12 and paris.lon0 == 2.33722917 and paris.approximate
    assert not c.of(GRS).approximate and not c.of('GEOGCS["x",DATUM["D_WGS_1984",SPHEROID["w",6378137,298.25]]]').approximate
    assert c.of(f'COMPD_CS["both",{LCC},VERT_CS["v"]]').kind == "lcc"
    web = c.of(projected("Mercator", GRS).replace('"p"', '"WGS 84 / Pseudo-Mercator"'))
    assert web.flattening == 0 and web.kind == "merc"
    refused = ['PROJCRS["new",x["y"]]', 'GEOCCS["c"]', "POINT (1 2)", 'PROJCS["p"]', LCC + "]", LCC[:-1], projected("Stereographic"), 'GEOGCS["a"],GEOGCS["b"]', "[" * 50, "A[" * 40 + "]" * 40]
    refused += [projected("Albers", CLARKE.replace('"Greenwich",0', '"Paris",2.3')), projected("Albers", CLARKE.replace("0.0174532925199433", "0.0157")), projected("Albers", 'GEOGCS["g",DATUM["d"]]'), projected("Albers", unit='UNIT["none",0]'), "GEOGCS[" + "1," * 40_000 + "1]"]
    for bad in refused:
        with pytest.raises(c.UnknownCrs):
            c.of(bad)


def test_a_column_of_systems(spark):
    rows = [(1, 0.0, 0.0, "EPSG:3857"), (2, 500000.0, 0.0, "EPSG:32632"), (3, 10.0, 20.0, None), (4, 1.0, 2.0, "EPSG:1"), (5, None, 1.0, LCC), (6, 1885472.7, 1535925.0, ALBERS)]
    out = c.located(spark.createDataFrame(rows, "id int, x double, y double, system string"), "x", "y", "system")
    got = {r["id"]: (None if r["lon"] is None else round(r["lon"], 6), None if r["lat"] is None else round(r["lat"], 6), r["approximate"], r["crs_error"]) for r in out.collect()}
    assert got == {1: (0.0, 0.0, False, None), 2: (9.0, 0.0, False, None), 3: (10.0, 20.0, False, None), 4: (None, None, None, "EPSG:1"), 5: (None, got[5][1], True, None), 6: (-75.0, 35.0, True, None)}
