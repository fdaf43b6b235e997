import pytest
from pyspark.sql import functions as F

from quarry.functions import names as n
from quarry.operators import geo as g
from quarry.operators import jobs as j


def test_sizes(spark):
    r = spark.range(1).select(n.most_bytes(F.lit(1.001)), n.least_bytes(F.lit(1.001)), n.most_bytes(F.lit(2.5)), n.percent_bytes(F.lit(1999), F.lit(50)), n.least_bytes(F.lit(0.0000005)), n.percent_bytes(F.lit(None).cast("long"), F.lit(5))).first()
    assert tuple(r) == (1_000_999, 1_001_000, 2_500_000, 999, 1, None)


def test_ignored(spark):
    paths = {"/w/a.pdf": False, "/w/a.PDF": False, "/w/.a.pdf": True, "/w/~$a.pdf": True, "/w/a.pdf~": True, "/w/Thumbs.db": True, "/w/a.part": True, "/w/a.exe": True, "/w/out/a.pdf": True, "/w/outer/a.pdf": False, "/w/done/x/a.pdf": True, "/w/sub/a.pdf": False, None: True, "/w/": True}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    at = lambda **k: {r["p"]: r["x"] for r in df.select("p", n.ignored(F.col("p"), "/w/", ["pdf"], **k).alias("x")).collect()}
    assert at(output="/w/out", originals="/w/done/") == paths
    assert not at(output="/w")["/w/a.pdf"] and not at(output="/")["/w/out/a.pdf"]
    assert at(subfolders=False)["/w/sub/a.pdf"] and not at(subfolders=False)["/w/a.pdf"]
    assert at(include=F.col("p").contains("sub"))["/w/a.pdf"]


RANGES = {"": None, " ": None, None: None, "1-3,5": None, "7-": None, "-4": None, "11": "past the end", "1-11": "past the end", "-": "invalid", "a": "invalid", "0": "invalid", "1--3": "invalid", ",": "invalid", "1 - 3 , 5": None, "１–３、５": None, "١-٣": None, "3-1": None, "99999999999": "invalid", "+1": "invalid", "1-2-3": "invalid"}


def test_page_ranges(spark):
    df = spark.createDataFrame([(e,) for e in RANGES], "e string")
    assert {r["e"]: r["p"] for r in df.select("e", n.page_range_problem(F.col("e"), F.lit(10)).alias("p")).collect()} == RANGES


def test_newest_entry_decides(spark):
    rows = [("r", "a", 1, True), ("r", "a", 2, False), ("r", "b", 1, False), ("r", "b", 3, True), ("r", "c", 1, None), ("s", "a", 1, True)]
    out = j.watch_totals(spark.createDataFrame(rows, "rule string, source string, at int, failed boolean"), "rule", "source", "at", "failed")
    assert {tuple(r) for r in out.collect()} == {("r", 2, 1), ("s", 0, 1)}


def test_repeated_headers(spark):
    rows = [("d", 1, 1, 0, ["h", "i"]), ("d", 1, 1, 1, ["1", "2"]), ("d", 2, 1, 0, ["h", "i"]), ("d", 2, 1, 1, ["h", "i"]), ("d", 3, 1, 0, ["3", "4"]), ("d", 4, 2, 0, ["h", "i"]), (None, 1, 1, 0, ["x"]), (None, 2, 1, 0, ["x"])]
    df = spark.createDataFrame(rows, "doc string, part int, `table` int, row int, cells array<string>")
    out = j.without_repeated_headers(df, "doc", "part", "table", "row", "cells")
    assert out.columns == df.columns and sorted((str(r["doc"]), r["part"], r["row"]) for r in out.collect()) == [("None", 1, 0), ("d", 1, 0), ("d", 1, 1), ("d", 2, 1), ("d", 3, 0), ("d", 4, 0)]


def test_places(spark):
    assert g.place_columns(["id", "Y", "X", "Long_itude", "LAT.", "Alt"]) == {"lon": "Long_itude", "lat": "LAT.", "height": "Alt"}
    assert g.place_columns(["x", "the_geom", "y"]) == {"wkt": "the_geom"} and g.place_columns(["lat", "name"]) == {}
    rows = spark.createDataFrame([("a", "1,5", "2"), ("b", "x", "2"), ("c", None, None), ("d", "1", "91")], "name string, lon string, lat string")
    assert [tuple(r) for r in g.placed_rows(rows).orderBy("name").collect()] == [("a", "POINT", "POINT (1.5 2)"), ("b", None, None), ("c", None, None), ("d", None, None)]
    high = spark.createDataFrame([("1", "2", "3"), ("1", "2", "")], "x string, y string, z string")
    assert [r["text"] for r in g.placed_rows(high).collect()] == ["POINT Z (1 2 3)", "POINT (1 2)"]
    wkt = spark.createDataFrame([("point(1 2)", 1), (" ", 2)], "wkt string, n int")
    assert {r["n"]: r["text"] for r in g.placed_rows(wkt).collect()} == {1: "POINT (1 2)", 2: None}
    with pytest.raises(ValueError, match="no columns"):
        g.placed_rows(rows.select("name"))
