import json
import random

from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators.sequences import free_names, header_names
from quarry.sources import files


def loop(wanted, taken):
    """As the rule says it: try the name, then (2), (3), ... until one is free."""
    used, out = {t.lower() for t in taken}, []
    for w in wanted:
        name, n = w, 2
        while name.lower() in used:
            name, n = f"{w} ({n})", n + 1
        used.add(name.lower())
        out.append(name)
    return out


def test_free_names_are_as_by_a_loop(spark):
    rng = random.Random(3)
    cases = [(["a", "a", "a (2)"], []), (["a"], ["a", "a (2)"]), (["A", "a", "b"], ["B"])]
    names = [f"{x}{y}" for x in ("a", "A", "b.txt") for y in ("", " (2)", " (3)", " (2) (2)")]
    cases += [([rng.choice(names) for _ in range(60)], rng.sample(names, 4)) for _ in range(3)]
    for wanted, taken in cases:
        w = spark.createDataFrame([(i, n, "x") for i, n in enumerate(wanted)], "id int, name string, free_ string")
        out = free_names(w, spark.createDataFrame([(t,) for t in taken], "name string"), "name", "id").orderBy("id").collect()
        assert [r["free"] for r in out] == loop(wanted, taken)


def test_header_names_are_unique():
    assert header_names(["a", "a", "a_2"]) == ["a", "a_2", "a_2_2"]
    assert header_names([" x ", "", None, "column2", "X"]) == ["x", "column2", "column3", "column2_2", "X"]


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'say "hi"', " lead", "true", "1.5", None), (2, "two\nlines", "a,b", "FALSE", "-2", ""), (3, "", "", "true", "1e3", "z")]
    df = spark.createDataFrame(rows, "id int, t string, u string, f string, x string, `id ` string")
    files.write_csv(df, str(tmp_path / "c"))
    # The parts are one file, cut.
    (tmp_path / "c.csv").write_bytes(b"".join(p.read_bytes() for p in sorted((tmp_path / "c").glob("part-*"))))
    back = files.read_csv(spark, str(tmp_path / "c.csv"))
    assert back.dtypes == [("id", "bigint"), ("t", "string"), ("u", "string"), ("f", "boolean"), ("x", "double"), ("id_2", "string")]
    assert sorted(map(tuple, back.collect())) == [(1, 'say "hi"', " lead", True, 1.5, ""), (2, "two\nlines", "a,b", False, -2.0, ""), (3, "", "", True, 1000.0, "z")]


def test_tsv_blank_rows_and_broken_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("k\tk\t\n1\t007\tx;y\n\t\t\n2\t8\t\n")
    back = files.read_csv(spark, str(tmp_path / "a.tsv"))
    assert back.columns == ["k", "k_2", "column3"] and sorted(map(tuple, back.collect())) == [(1, "007", "x;y"), (2, "8", "")]
    (tmp_path / "good.json").write_text('[{"a": 1}]')
    (tmp_path / "bad.json").write_bytes(b'{"a": [1, ')
    out = files.read(spark, str(tmp_path), lambda data: iter([(str(json.loads(data)),)]), "text string", "*.json", errors="error").collect()
    assert len(out) == 2 and sum(r["error"] is None for r in out) == 1


def folded(line):
    """Character by character: a new line before the one that would make 76 bytes."""
    out, size = "", 0
    for char in line:
        n = len(char.encode())
        if size + n > 75:
            out, size = out + "\r\n ", 1
        out, size = out + char, size + n
    return out


def test_lines_are_folded_as_by_a_loop(spark):
    rng = random.Random(5)
    lines = ["", "a" * 75, "a" * 76, "é" * 38, "a" * 74 + "é", "a" * 74 + "€", "a" * 74 + "😀", "😀" * 60, "a\n" * 90, "$1\\" * 60]
    lines += ["".join(rng.choices("ab é€😀가", k=rng.randrange(400))) for _ in range(100)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*lines, None])], "id int, t string")
    out = [r["f"] for r in frame.select("id", text.fold(F.col("t")).alias("f")).orderBy("id").collect()]
    assert out == [*map(folded, lines), None]
    assert all(len(part.encode()) <= 75 for f in out[:-1] for part in f.split("\r\n"))
    back = frame.select("id", text.unfold(text.fold(F.col("t"))).alias("f")).orderBy("id").collect()
    assert [r["f"] for r in back] == [*lines, None]
