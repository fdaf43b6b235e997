import random

from pyspark.sql import functions as F

from quarry.operators import grids as g

CELLS, MERGES, HIDDEN = "sheet string, row long, column int, text string, other int", "sheet string, top long, left int, bottom long, right int", "sheet string, at long"


def brute_range(cells, merges):
    full = [(r, c) for r, c, t in cells if t]
    if not full:
        return None
    top, left, bottom, right = min(r for r, _ in full), min(c for _, c in full), max(r for r, _ in full), max(c for _, c in full)
    before = None
    while before != (bottom, right):
        before = bottom, right
        for t, l, b, r in merges:
            if None not in (t, l) and top <= t <= bottom and left <= l <= right:
                bottom, right = max(bottom, b), max(right, r)
    return top, left, bottom, right


def table(seed):
    rng = random.Random(seed)
    cells, merges, rows, columns = [], [], [], []
    for s in [*"abcdefgh", None]:
        spot = rng.randrange(2, 9)
        cells += [(s, rng.randrange(1, 9), rng.randrange(1, 9), rng.choice(["x", 'q"', "", None, "a,b"]), 1) for _ in range(rng.choice([0, 1, 12]))]
        merges += [(s, t := rng.randrange(20), l := rng.randrange(20), t + rng.randrange(6), l + rng.randrange(6)) for _ in range(rng.choice([0, 8, 40]))]
        merges += [(s, spot + k, spot + k, spot + k + 1, spot + k + 1) for k in range(rng.choice([0, 7]))]
        rows += [(s, rng.randrange(15)) for _ in range(3)]
        columns += [(s, rng.randrange(12)) for _ in range(2)]
    return cells, [*merges, ("a", None, 1, 90, 90)], rows, columns


def test_ranges_and_lines_equal_loops(spark):
    for seed in range(3):
        cells, merges, rows, columns = table(seed)
        c = spark.createDataFrame(cells, CELLS)
        ranges = g.used_range(c, spark.createDataFrame(merges, MERGES))
        sheets = {x[0] for x in cells}
        want = {s: brute_range([x[1:4] for x in cells if x[0] == s], [m[1:] for m in merges if m[0] == s]) for s in sheets}
        got = {r["sheet"]: (r["top"], r["left"], r["bottom"], r["right"]) for r in ranges.collect()}
        assert got == {s: r for s, r in want.items() if r}
        out = g.lines(c, ranges, spark.createDataFrame(rows, HIDDEN), spark.createDataFrame(columns, HIDDEN), lambda t: F.concat(F.lit("<"), t, F.lit(">")))
        text = {}
        for s, r, k, t, _ in cells:
            text[s, r, k] = max((x for x in (text.get((s, r, k)), t) if x is not None), default=None)
        lines = {(s, r): [f"<{text.get((s, r, k)) or ''}>" for k in range(got[s][3] + 1) if (s, k) not in columns] for s in got for r in range(got[s][2] + 1) if (s, r) not in rows}
        assert {(x["sheet"], x["row"]): x["fields"] for x in out.collect()} == lines


def test_hidden_ones_make_others_move(spark):
    cells = [("s", r, c, f"{r}.{c}", 0) for r in range(6) for c in range(4)] + [(None, 3, 0, "n", 0)]
    c = spark.createDataFrame(cells, CELLS)
    hidden = spark.createDataFrame([("s", 0), ("s", 3), ("s", 3), ("s", 99), ("other", 1), (None, 1)], HIDDEN)
    out = g.shown(g.shown(c, hidden, "row"), spark.createDataFrame([("s", 1)], HIDDEN), "column")
    assert out.columns == c.columns and out.schema["row"] == c.schema["row"]
    assert sorted((str(x["sheet"]), x["row"], x["column"], x["text"]) for x in out.collect()) == sorted([("None", 2, 0, "n"), *(("s", i, j, f"{r}.{k}") for i, r in enumerate([1, 2, 4, 5]) for j, k in enumerate([0, 2, 3]))])


def test_nothing(spark):
    none = spark.createDataFrame([], CELLS)
    ranges = g.used_range(none, spark.createDataFrame([("s", 0, 0, 5, 5)], MERGES))
    hidden = spark.createDataFrame([], HIDDEN)
    assert ranges.count() == 0 and g.lines(none, ranges, hidden, hidden, lambda t: t).count() == 0 and g.shown(none, hidden, "row").count() == 0
