import os

import pytest
from pyspark.sql import functions as F

from quarry.sources import sheets_out as o

SF = "/root/testdata/sf0.001"


def names(folder):
    return sorted(os.listdir(folder))


def test_customers_come_back(spark, tmp_path):
    c = spark.read.parquet(f"{SF}/customer.parquet").withColumn("odd", F.when(F.col("c_custkey") % 3 == 0, ' "a",\r\nb ').when(F.col("c_custkey") % 3 == 1, "é日🙂"))
    o.write(c, str(tmp_path / "t"), "customers", "c_mktsegment")
    segments = {r[0] for r in c.select("c_mktsegment").distinct().collect()}
    assert names(tmp_path / "t") == sorted(f"customers_{s}.csv" for s in segments)
    back = o.read(spark, str(tmp_path / "t"), file_column="file")
    assert back.columns == [*(x for x in c.columns if x != "c_mktsegment"), "file"]
    want = c.select(*[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in c.columns if x != "c_mktsegment"], F.concat(F.lit("customers_"), "c_mktsegment", F.lit(".csv")))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, want.collect()))
    data = (tmp_path / "t" / names(tmp_path / "t")[0]).read_bytes()
    assert data.startswith(b"\xef\xbb\xbfc_custkey,") and data.endswith(b"\r\n") and b"\n" not in data.replace(b"\r\n", b"")


def test_byte_ranges_have_every_line_once(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").alias("k"), F.expr("repeat('é', cast(id % 40 as int))").alias("t"))
    o.write(rows, str(tmp_path / "t"), kind="tsv")
    for step in (1000, 777, 4_000_000):
        back = o.read(spark, str(tmp_path / "t"), "tsv", split_bytes=step)
        assert back.rdd.getNumPartitions() >= (5 if step <= 1000 else 1)
        assert sorted((int(r["k"]), len(r["t"])) for r in back.collect()) == [(i, i % 40) for i in range(3000)]


def test_names_that_are_taken(spark, tmp_path):
    folder = str(tmp_path / "t")
    df = spark.createDataFrame([("a/b", "1"), ("a:b", "2"), ("A_B", "3"), (None, "4")], "s string, x string")
    o.write(df, folder, "n", "s")
    assert names(folder) == ["n_A_B.csv", "n_Sheet.csv", "n_a_b (2).csv", "n_a_b (3).csv"]
    one = spark.createDataFrame([("z", "5")], "s string, x string")
    for conflict, want in (("skip", 4), ("number", 5), ("number", 6), ("overwrite", 6)):
        o.write(one, folder, "n_Sheet", "s", conflict=conflict)
        assert len(names(folder)) == want, conflict
    assert "n_Sheet (2).csv" in names(folder) and open(f"{folder}/n_Sheet.csv", encoding="utf-8-sig").read() == "x\n5\n"
    with pytest.raises(Exception, match="taken"):
        o.write(one, folder, conflict="ask")


def test_parts_of_a_sheet(spark, tmp_path):
    o.write(spark.range(100).repartition(4), str(tmp_path / "t"), in_parts=True)
    assert names(tmp_path / "t") == ["table (2).csv", "table (3).csv", "table (4).csv", "table.csv"]
    assert sorted(int(r["id"]) for r in o.read(spark, str(tmp_path / "t")).collect()) == list(range(100))


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "t")
    o.write(spark.range(3), folder)
    before = {n: open(f"{folder}/{n}", "rb").read() for n in names(folder)}
    bad = spark.range(4000).repartition(4).select(F.when(F.col("id") == 3999, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("id"))
    for conflict in o.CONFLICTS:
        with pytest.raises(Exception, match="broken"):
            o.write(bad, folder, conflict=conflict, in_parts=True)
        assert {n: open(f"{folder}/{n}", "rb").read() for n in names(folder)} == before


def test_tasks_that_are_tried_again(spark, tmp_path):
    """What an attempt wrote that did not report goes at the commit."""
    schema = spark.range(1).selectExpr("cast(id as string) id").schema
    w = o.SheetWriter({"path": str(tmp_path), "name": "n"}, schema, False)
    hidden = tmp_path / o.HIDDEN.format(run=w.run)
    for p in (hidden / "1-0", hidden / "2-0", tmp_path / ".quarry-other"):
        p.write_text("x")
    w.commit([o.Written([o.Part(None, 0, 0, str(hidden / "1-0"), 1)]), None])
    assert names(tmp_path) == [".quarry-other", "n.csv"]


def test_other_layouts_are_named(spark, tmp_path):
    folder = str(tmp_path / "t")
    o.write(spark.range(1), folder, "a")
    o.write(spark.range(1).withColumnRenamed("id", "other"), folder, "b")
    with pytest.raises(Exception, match="b.csv has the columns"):
        o.read(spark, folder).collect()


def test_empty_tables(spark, tmp_path):
    o.write(spark.range(0), str(tmp_path / "t"))
    os.makedirs(tmp_path / "t", exist_ok=True)
    assert o.read(spark, str(tmp_path / "t")).count() == 0
