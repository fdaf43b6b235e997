"""Spellings that the tables' own values don't have."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import geo as g
from quarry.functions import names as n
from quarry.functions import text as x
from quarry.functions import typing as t
from quarry.operators import geo as o
from quarry.operators import jobs as j
from quarry.operators import records as r
from quarry.operators import sequences as s

SF = "/root/testdata/sf0.001"

CASES = {
    "color": (x.color, [("#abc", "aabbcc"), ("#A1B2C3", "a1b2c3"), ("#11223344", "112233"), ("rgb(1, 2,255)", "0102ff"), ("rgb(1,2,256)", None), ("Red", "ff0000"), (" navy ", "000080"), ("#12", None), ("nope", None)]),
    "offset": (x.utc_offset, [("+0900", 32400), ("-0330", -12600), ("+013015", 5415), ("0900", None), ("+9", None)]),
    "header": (x.header_key, [("E-Mail 1", "email1"), ("Größe (cm)", "größecm"), ("이름", "이름")]),
    "calendar": (lambda c: x.calendar_time(c).cast("string"), [("20240229", "2024-02-29 00:00:00"), ("20240229T235959Z", "2024-02-29 23:59:59"), ("20230229", None), ("2024-02-29", None), ("20240101T1200", None)]),
    "birthday": (x.birthday, [("19791123", "1979-11-23"), ("1980", "1980"), (None, None), ("--0102", "--0102")]),
    "coordinate": (g.coordinate, [("12.5", 12.5), ("12,5", 12.5), (" -7 ", -7.0), ("1,234.5", None), ("1,2,3", None), ("x", None), ("1e2", 100.0)]),
    "safe": (n.safe_name, [("a/b:c", "a_b_c"), ("con", "_con"), ("Com1.txt", "_Com1.txt"), ("ok.txt", "ok.txt"), ("...", "converted"), ("x. ", "x"), ("tab\there", "tab_here"), ("", "converted")]),
    "media": (j.media_extension, [("Text/HTML; charset=utf-8", "html"), ("image/jpeg", "jpg"), ("x/y", None)]),
    "delimiter": (r.delimiter, [("a,b;c", ","), ("a;b;c,d", ";"), ("a\tb\tc", "\t"), ('"a;b;c;d",x', ","), ("", ","), ("a;b,c", ",")]),
    "attribute": (t.attribute_kind, list(zip(["007", "+1", "12", "-12", "-0.5", "0.5", ".5", "0", "-", "", "True", "tRue", "1e3", "9223372036854775808", "1234567890123456789012345", "00", "0x1", "abc", "1.5.2", "12a"], ["text", "text", "integer", "integer", "number", "number", "number", "integer", "text", "null", "boolean", "text", "number", "number", "text", "text", "text", "text", "text", "text"], strict=True))),
    "shape": (r.shape, [('[{"a":1},null,{"b":2}]', "records"), ("[[1,2],[3]]", "rows"), ("[1,\"x\",null]", "values"), ('{"a":[1,2],"b":[3]}', "columns"), ('{"a":1,"b":[3]}', "record"), ('[1,{"a":2}]', "mixed: objects, lists and single values"), ("7", "single value"), ("[]", "empty")]),
}


@pytest.mark.parametrize("name", CASES)
def test_spellings(spark, name):
    f, cases = CASES[name]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c string")
    got = {x["i"]: x["v"] for x in df.select("i", f(F.col("c")).alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [v for _, v in cases]


def test_names(spark):
    rows = [("Doe", "Jo", None, "Jo Doe"), ("김", "철수", None, "김철수"), (None, None, "Org", "Org"), (None, " ", " ", "")]
    out = spark.createDataFrame(rows, "f string, g string, o string, want string").select(x.full_name(F.col("f"), F.col("g"), F.col("o")).alias("n"), "want").collect()
    assert all(r["n"] == r["want"] for r in out)


def test_headers():
    assert s.header_names(["a", " a ", "", "b", "a", "", "column3", "A"]) == ["a", "a_2", "column3", "b", "a_3", "column6", "column3_2", "A"]


WKT = [("point(1 2)", "POINT (1 2)"), ("SRID=4326;POINT Z (1 2 3)", "POINT Z (1 2 3)"), ("POINTM(1 2 3)", "POINT (1 2)"), ("LineString (0 0, 1.50 -2)", "LINESTRING (0 0, 1.5 -2)"), ("POLYGON((0 0,1 0,1 1,0 0),(.1 .1,.2 .1,.2 .2,.1 .1))", "POLYGON ((0 0, 1 0, 1 1, 0 0), (0.1 0.1, 0.2 0.1, 0.2 0.2, 0.1 0.1))"), ("MULTIPOINT(1 2,(3 4))", "MULTIPOINT (1 2, 3 4)"), ("GEOMETRYCOLLECTION(POINT(1 2),LINESTRING EMPTY)", "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING EMPTY)"), ("POINT(1)", None), ("CIRCLE(1 2)", None), ("POINT(1 2", None), ("MULTIPOLYGON(((0 0,1 0,1 1,0 0)))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))")]


def test_well_known_text(spark):
    out = o.parse_wkt(spark.createDataFrame([(a,) for a, _ in WKT], "wkt string"), "wkt").collect()
    assert {r["wkt"]: r["text"] for r in out} == dict(WKT)


def test_areas(spark):
    tags = [("building", "yes", True), ("natural", "coastline", False), ("natural", "water", True), ("highway", "service", False), ("area", "yes", True)]
    out = spark.createDataFrame(tags, "k string, v string, want boolean").select(g.is_area(F.create_map("k", "v")).alias("a"), "want").collect()
    assert all(r["a"] == r["want"] for r in out)


def test_zone(spark):
    p = spark.createDataFrame([(500000.0, 0.0, 9.0, 0.0), (500000.0, 4982950.400225, 9.0, 45.0), (833978.5569, 0.0, 12.0, 0.0)], "x double, y double, lon double, lat double")
    out = p.withColumn("p", g.transverse_mercator_inverse(F.col("x"), F.col("y"), 9.0)).collect()
    assert all(abs(r["p"]["lon"] - r["lon"]) < 1e-5 and abs(r["p"]["lat"] - r["lat"]) < 1e-5 for r in out)


def test_routes_of_every_format(spark):
    """Each format that can be made into another is there, not ten of them, with each of its targets."""
    from quarry.plans import catalog, routes
    from quarry.queries import queries

    got = queries()["route_reachable"](spark, SF)
    edges = routes.admissible(catalog.edges(spark))
    want = routes.routes(edges.select(F.col("from").alias("id")).distinct().withColumn("category", F.lit("")), edges)
    assert {tuple(r) for r in got.select("origin", "target", "cost", "hops").distinct().collect()} == {tuple(r) for r in want.select("origin", "target", "cost", "hops").collect()}


def test_attributes_in_every_spelling(spark):
    from quarry.queries import queries

    got = queries()["infer_attribute_type"](spark, SF)
    fixed = {r["value"]: r["kind"] for r in got.where("p_partkey is null").collect()}
    assert len(fixed) == 20 and fixed["tRue"] == "text" and fixed["9223372036854775808"] == "number"
    assert {r["count"] for r in got.where("p_partkey is not null").groupBy("p_partkey").count().collect()} == {19}


def test_rows_of_small_files_share_batches(spark):
    from quarry.sources import files

    def parse(data: bytes):
        for k in range(data[0]):
            yield (k,)

    some = spark.range(0, 3000, 1, 1).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.char(F.col("id") % 3), F.lit("x")).cast("binary")).alias("content"))
    out = files.parsed(some, "content", parse, "k int", ("id",))
    assert sorted(map(tuple, out.collect())) == [(i, k) for i in range(3000) if i % 7 for k in range(i % 3)]
    sizes = out.select("k").mapInArrow(lambda bs: (b.slice(0, 1) for b in bs), "k int").count()
    assert sizes < 10
