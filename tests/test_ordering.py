import random

import pytest
from pyspark.sql import functions as F

from quarry.functions.names import folder_key, natural_key
from quarry.operators import ordering as o

SCHEMA = "a long, b string, c double, t timestamp_ntz, `_k0` string, place string"


def table(n=4000):
    import datetime

    rng = random.Random(6)
    out = []
    for i in range(n):
        a = 7 if rng.random() < 0.5 else rng.choice([None, *range(-20, 20)])
        t = None if rng.random() < 0.1 else datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=rng.randrange(50))
        out.append((a, rng.choice([None, "", "é", "z" * 500 + str(rng.randrange(9)), "A", "a", "日本"]), rng.choice([None, 0.0, -1.5, float("inf"), 2.25]), t, f"own {i}", "old"))
    return out


def after(value, descending, nulls_last):
    """A sort key for one value as Python's."""

    class K:
        def __init__(self, v):
            self.v = v.encode() if isinstance(v, str) else v

        def __lt__(self, other):
            if self.v is None or other.v is None:
                return (self.v is not None and other.v is None) if nulls_last else (self.v is None and other.v is not None)
            return self.v > other.v if descending else self.v < other.v

        def __eq__(self, other):
            return self.v == other.v

    return K(value)


ORDERS = [[("a", False, False)], [("a", True, True), ("b", False, True)], [("b", True, False), ("t", True, True), ("c", False, False)], [("t", False, True), ("a", True, False), ("b", True, True)]]


@pytest.mark.parametrize("order", ORDERS)
def test_numbers_follow_every_key(spark, order):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    out = o.ranked(df, [o.Key(*k) for k in order])
    assert out.columns == ["a", "b", "c", "t", "_k0", "place"]
    got = [r["_k0"] for r in sorted(out.collect(), key=lambda r: r["place"])]
    at = {"a": 0, "b": 1, "c": 2, "t": 3}
    # Rows that are alike keep the order in which they are read.
    assert got == [r[4] for r in sorted(rows, key=lambda r: [after(r[at[c]], d, n) for c, d, n in order])]
    assert out.agg(F.min("place"), F.max("place"), F.count_distinct("place")).first()[:] == (1, len(rows), len(rows))


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_task_gets_all_rows(spark):
    """Half of the rows share one key, and so do all rows of the second table."""
    for key in (F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id") % 1000), F.lit(1)):
        df = spark.range(20_000).select(F.col("id"), key.alias("k"))
        order = [o.Key("k", True, True)]
        assert "SinglePartition" not in plan(o.ranked(df, order))
        sizes = [r["count"] for r in o.ranged(df, order, "part").groupBy("part").count().collect()]
        ranges = o.RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert len(sizes) >= ranges - 2 and max(sizes) < 3 * 20_000 / ranges


def test_ranges_are_in_order(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 9 > 0, F.col("id") * 7919 % 5003).alias("x"))
    ends = o.ranged(df, [o.Key("x", nulls_last=True)], "p").groupBy("p").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count_if(F.col("x").isNull()).alias("n")).orderBy("p").collect()
    filled = [r for r in ends if r["a"] is not None]
    assert all(r["b"] <= q["a"] for r, q in zip(filled, filled[1:])) and not any(r["n"] for r in filled[:-1])


def test_empty_and_single(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert o.ranked(none, [o.Key("a"), o.Key("b")]).collect() == []
    assert [r["n"] for r in o.ranked(spark.range(1), [o.Key("id", True)], "n").collect()] == [1]
    assert sorted(r["n"] for r in o.ranked(spark.createDataFrame([(None,)] * 5, "x string"), [o.Key("x")], "n").collect()) == [1, 2, 3, 4, 5]


def test_array_keys(spark):
    paths = ["b/2.txt", "b/10.txt", "b/sub/z.txt", "a.txt", "b/a.txt", "c/x/1.txt", "A/9.txt", "b/sub/Y.txt"]
    df = spark.createDataFrame([(p,) for p in paths * 200], "path string")
    out = o.ranked(df, o.file_order("name", folders_together=True))
    got = [r["path"] for r in sorted(out.collect(), key=lambda r: r["place"])][::200]
    assert got == ["A/9.txt", "b/sub/Y.txt", "b/sub/z.txt", "b/2.txt", "b/10.txt", "b/a.txt", "c/x/1.txt", "a.txt"]
    back = [r["path"] for r in sorted(o.ranked(df, o.file_order("name_descending", folders_together=True)).collect(), key=lambda r: r["place"])][::200]
    assert back == got[::-1]


def test_names_of_orders(spark):
    with pytest.raises(ValueError):
        o.file_order("size")
    assert natural_key and folder_key


def test_bounds_stay_out_of_the_plan(spark):
    """600 bounds of lists of structs as literals took the driver half a minute an order."""
    files = spark.range(20_000).select(F.concat(F.lit("d/File "), F.col("id").cast("string"), F.lit(".txt")).alias("path"), F.lit(None).cast("timestamp").alias("modified"), F.col("id"))
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        out = o.ranked(files, [*o.file_order("name"), o.Key("id")])
        assert len(out._jdf.queryExecution().analyzed().toString()) < 100_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [r["id"] for r in out.orderBy("place").select("id").limit(50).collect()] == [*range(50)]
