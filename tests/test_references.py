from pyspark.sql import functions as F

from quarry.operators import jobs as j
from quarry.operators import references as r
from quarry.operators import sequences as s


def test_links_of_a_message(spark):
    m = spark.createDataFrame([(1, "<img src='cid:A%40x'> url(CID:b) cid:none", "k"), (2, "cid:b", "k"), (3, None, "k"), (4, "no link", "k"), (5, "cid:b cid:b", None), (None, "cid:b", "n")], "id int, html string, more string")
    parts = spark.createDataFrame([(1, "<a@x>", "data:1"), (1, "B", "data:cid:b"), (1, "b", "data:z"), (5, "b", "five"), (2, "other", "x"), (2, None, "x"), (4, "b", "y")], "id int, cid string, uri string")
    out = r.inlined(m, parts, "id", "html", "cid", "uri")
    assert out.columns == m.columns
    assert {x["id"]: x["html"] for x in out.collect()} == {1: "<img src='data:1'> url(data:cid:b) cid:none", 2: "cid:b", 3: None, 4: "no link", 5: "five five", None: "cid:b"}


def test_values_in_order(spark):
    df = spark.createDataFrame([("k", "b", 2), ("k", "a", 3), ("k", "b", 1), ("k", None, 0), ("k", "c", 9), ("n", None, 1)], "k string, v string, at int")
    assert {x["k"]: x["values"] for x in r.distinct_in_order(df, "k", "v", "at").collect()} == {"k": ["b", "a", "c"]}
    assert r.distinct_in_order(df, "k", "v", "at", 2).first()["values"] == ["b", "a"]
    cells = spark.createDataFrame([("k", "x", "work", 2), ("k", "y", None, 1), ("k", " ", "home", 0), ("j", "z", "", 0)], "k string, v string, kind string, at int")
    assert {x["k"]: x["cell"] for x in r.in_one_cell(cells, "k", "v", "kind", "at").collect()} == {"k": "y; x (work)", "j": "z"}


def test_stalls(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 00:00:05", 2), ("a", "2024-01-01 00:00:11", 3), ("b", "2024-01-01 00:00:00", 4)], "k string, t string, i int").withColumn("t", F.col("t").cast("timestamp"))
    assert {x["i"]: (x["stalled"], x["session"]) for x in s.stalls(df, "k", "t", "'5' second", "i").collect()} == {1: (True, 1), 2: (False, 1), 3: (True, 2), 4: (True, 1)}
    v = spark.range(1).select(*[s.nearing(F.lit(0.2), F.lit(1.0), F.lit(x), F.lit(10.0)) for x in (-5.0, 0.0, 10.0, 1e6)]).first()
    assert v[0] == v[1] == 0.2 and 0.70 < v[2] < 0.71 and v[3] <= 1.0


def test_wholes(spark):
    w, p = spark.createDataFrame([(1,), (2,), (3,), (4,)], "w int"), spark.createDataFrame([(1, True, 5), (1, True, 6), (2, True, 1), (2, False, 1), (3, None, 1)], "of int, ok boolean, v int")
    assert {x["w"]: tuple(x)[1:] for x in j.all_or_nothing(w, p, "w", "of", F.col("ok"), "v").collect()} == {1: (2, True, 11), 2: (2, False, None), 3: (1, False, None), 4: (0, False, None)}
