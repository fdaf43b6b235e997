import os
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import merging as m
from quarry.operators.ordering import Key, running


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(5), rng.choice([None, *range(9)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, v long, i int").coalesce(1)
    out = running(df, [Key("k", True)], F.col("v"), "before")
    total, want = 0, {}
    for _, v, i in sorted(rows, key=lambda r: -r[0]):
        want[i], total = total, total + (v or 0)
    assert {r["i"]: r["before"] for r in out.collect()} == want and out.columns == ["k", "v", "i", "before"]


@pytest.mark.parametrize("between", [b"", b"\r\n--\n"])
def test_rows_equal_a_loop(spark, tmp_path, between):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "", "é" * rng.randrange(50), "x" * rng.randrange(4000), "日本"]), "own") for i in range(400)]
    target = str(tmp_path / "out" / "all.txt")
    out = m.merge_rows(spark.createDataFrame(rows, "i int, t string, start string").repartition(7), [Key("i", True)], "t", target, between)
    want = between.join((t or "").encode() for _, t, _ in reversed(rows))
    assert open(target, "rb").read() == want and os.listdir(tmp_path / "out") == ["all.txt"]
    back = m.read_back(out, "file://" + target)
    assert {r["i"]: bytes(r["content"]) for r in back.collect()} == {i: (t or "").encode() for i, t, _ in rows}


def test_files_equal_a_loop(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 1000)  # many blocks a file
    rng, parts = random.Random(4), []
    (tmp_path / "in").mkdir()
    for k in range(12):
        data = rng.randbytes(rng.choice([0, 1, 999, 1000, 1001, 5000, 12_345]))
        (tmp_path / "in" / f"part {k:02d}é.bin").write_bytes(data)
        parts.append(data)
    # Spark's own listing leaves empty files out.
    files = spark.createDataFrame([(f"file:{p}", p.stat().st_size) for p in (tmp_path / "in").iterdir()], "path string, length long").repartition(3)
    target = tmp_path / "whole"
    m.merge_files(files, [Key("path", True)], str(target), between=b"|")
    assert target.read_bytes() == b"|".join(reversed(parts))
    wrong = files.withColumn("length", F.col("length") + 1)
    with pytest.raises(Exception, match="bytes, not"):
        m.merge_files(wrong, [Key("path")], str(target))
    assert target.read_bytes() == b"|".join(reversed(parts)) and sorted(os.listdir(tmp_path)) == ["in", "whole"]


def test_nothing_and_elsewhere(spark, tmp_path):
    none = spark.createDataFrame([], "i int, t string")
    m.merge_rows(none, [Key("i")], "t", str(tmp_path / "empty"))
    assert (tmp_path / "empty").read_bytes() == b""
    with pytest.raises(ValueError, match="mounted"):
        m.merge_rows(none, [Key("i")], "t", "s3://bucket/x")
