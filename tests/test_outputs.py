from pyspark.sql import functions as F

from quarry.operators import outputs as o

FILES = [(1, "in/a/x.docx"), (2, "in/b/x.docx"), (3, "in/a/X.doc"), (4, "in/a/Minutes {date}.docx"), (5, "in/a/x.pdf"), (6, None), (7, "top.txt"), (8, "in/a/noext")]


def run(spark, rule, existing=(), files=FILES, to="pdf"):
    df = spark.createDataFrame([(i, p, to) for i, p in files], "i int, p string, to string").withColumn("at", F.lit("2024-05-06 07:08:09").cast("timestamp"))
    there = spark.createDataFrame([(p,) for p in existing], "path string")
    return {r["i"]: r["output"] for r in o.allocated(df, there, rule, "p", "to", "i", "at").collect()}


def test_beside_the_source(spark):
    assert run(spark, o.Rule()) == {1: "in/a/x (2).pdf", 2: "in/b/x.pdf", 3: "in/a/X (3).pdf", 4: "in/a/Minutes {date}.pdf", 5: "in/a/x (4).pdf", 6: None, 7: "top.pdf", 8: "in/a/noext.pdf"}
    assert run(spark, o.Rule(), ["in/b/X.PDF", "in/b/x (2).pdf", "top.doc"])[2] == "in/b/x (3).pdf"


def test_folders_and_patterns(spark):
    got = run(spark, o.Rule("{PRESET}-{name}.{ext}_{date}T{time}#{index}", "subfolder", "out/{ext}", preset="p"))
    assert got[1] == "in/a/out_docx/p-x.docx_20240506T070809#1.pdf" and got[4] == "in/a/out_docx/p-Minutes {date}.docx_20240506T070809#4.pdf" and got[7] == "out_txt/p-top.txt_20240506T070809#7.pdf"
    kept = run(spark, o.Rule(location="custom", folder="/dest/", keep_from="in"))
    assert kept[1] == "/dest/a/x.pdf" and kept[2] == "/dest/b/x.pdf" and kept[7] == "/dest/top.pdf"
    assert run(spark, o.Rule(" ", "custom", "d"))[2] == "d/x (2).pdf"
    assert run(spark, o.Rule("?..", "custom", "d"), files=[(1, "a/b.c")])[1] == "d/_.pdf"
    assert run(spark, o.Rule("{name}", renames=(("replace", "x", ""),)), files=[(1, "a/x.c")])[1] == "a/x.pdf"


def test_policies(spark):
    existing = ["in/b/x.pdf", "in/a/x.pdf"]
    over = run(spark, o.Rule(conflict="overwrite"), existing)
    assert over[1] == "in/a/x.pdf" and over[2] == "in/b/x.pdf" and over[3] == "in/a/X.pdf" and over[5] == "in/a/x (2).pdf"
    skip = run(spark, o.Rule(conflict="skip"), existing)
    assert skip[1] is None and skip[2] is None and skip[3] is None and skip[4] == "in/a/Minutes {date}.pdf" and skip[5] == "in/a/x (2).pdf"
    fresh = run(spark, o.Rule(conflict="skip"), [], [(1, "a/x.c"), (2, "a/X.d")])
    assert fresh == {1: "a/x.pdf", 2: None}


def test_nothing(spark):
    assert run(spark, o.Rule(), files=[]) == {} and run(spark, o.Rule(conflict="skip"), files=[]) == {}
