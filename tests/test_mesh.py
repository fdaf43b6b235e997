import math
import random

from pyspark.sql import functions as F

from quarry.functions import mesh as m

FACE = "array<struct<x: double, y: double, z: double>>"


def star(rng, n, plane):
    """A simple polygon around a point, mostly concave, in a tilted plane, either way round."""
    at = [2 * math.pi * (k + rng.uniform(0.1, 0.9)) / n for k in range(n)]  # no gap of half a turn
    uv = [(r * math.cos(a), r * math.sin(a)) for a in at for r in [rng.uniform(0.2, 3)]]
    if rng.random() < 0.5:
        uv.reverse()
    a, b, c = plane
    return [(u + a, v * b, u * c + v * 0.5) for u, v in uv]


def cross(a, b):
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def minus(a, b):
    return tuple(x - y for x, y in zip(a, b))


def area_vector(points):
    out = (0.0, 0.0, 0.0)
    for i in range(1, len(points) - 1):
        out = tuple(x + y for x, y in zip(out, cross(minus(points[i], points[0]), minus(points[i + 1], points[0]))))
    return out


def length(v):
    return math.sqrt(sum(x * x for x in v))


def test_triangles_fill_the_face(spark):
    rng, faces = random.Random(7), []
    for i in range(150):
        faces.append((i, star(rng, rng.choice([3, 4, 5, 8, 20]), (rng.uniform(-5, 5), rng.choice([1.0, -2.0]), rng.uniform(-2, 2)))))
    df = spark.createDataFrame(faces, f"i int, face {FACE}").repartition(4)
    got = {r["i"]: [tuple(t) for t in r["t"]] for r in df.select("i", m.triangulated(F.col("face")).alias("t")).collect()}
    fans = 0
    for i, face in faces:
        whole = area_vector(face)
        parts = [area_vector([face[k] for k in t]) for t in got[i]]
        assert len(parts) == len(face) - 2 and sorted({k for t in got[i] for k in t}) == list(range(len(face)))
        # All triangles run as the face does and their areas add up to its own: none lies outside, none over another.
        assert all(sum(a * b for a, b in zip(p, whole)) >= 0 for p in parts)
        assert abs(sum(map(length, parts)) - length(whole)) < 1e-9 * max(1, length(whole))
        fans += got[i] == [(0, k, k + 1) for k in range(1, len(face) - 1)]
    assert fans < 90


def test_odd_faces(spark):
    square = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (1.0, 1.0, 0.0), (0.0, 1.0, 0.0)]
    arrow = [(0.0, 0.0, 1.0), (2.0, 1.0, 1.0), (0.0, 2.0, 1.0), (1.0, 1.0, 1.0)]
    line = [(float(i), 0.0, 0.0) for i in range(5)]
    bow = [(0.0, 0.0, 0.0), (1.0, 1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0)]
    big = [(math.cos(a / 10), math.sin(a / 10), 0.0) for a in range(65)]
    rows = [(0, []), (1, square[:2]), (2, square[:3]), (3, square), (4, arrow), (5, arrow[::-1]), (6, line), (7, big), (8, None), (9, square[:2] + square), (10, bow)]
    out = {r["i"]: r["t"] and [tuple(t) for t in r["t"]] for r in spark.createDataFrame(rows, f"i int, f {FACE}").select("i", m.triangulated(F.col("f")).alias("t")).collect()}
    assert out[0] == [] == out[1] and out[2] == [(0, 1, 2)] and len(out[3]) == 2 and out[8] is None
    assert sorted(map(sorted, out[4])) == [[0, 1, 3], [1, 2, 3]] and len(out[5]) == 2 and all(0 not in t or 2 not in t for t in map(set, out[4]))
    assert out[6] == [(0, 1, 2), (0, 2, 3), (0, 3, 4)] and len(out[7]) == 63 and out[7][0] == (0, 1, 2) and len(out[9]) == 4 and len(out[10]) == 2


def test_totals(spark):
    rows = [("m", [1, 2, 3], [1]), ("m", [4], []), ("n", None, None)]
    out = m.totals(spark.createDataFrame(rows, "mesh string, v array<int>, t array<int>"), "mesh", "v", "t")
    assert sorted(map(tuple, out.collect())) == [("m", 2, 4, 1), ("n", 1, 0, 0)]


def test_unknown_corners_make_fans_and_faces_are_cut_together(spark):
    arrow = [(0.0, 0.0, 1.0), (2.0, 1.0, 1.0), (0.0, 2.0, 1.0), (1.0, 1.0, 1.0)]
    rows = [(0, [(None, 0.0, 0.0), *arrow]), (1, [arrow[0], (math.nan, 1.0, 1.0), *arrow[2:]]), (2, [None, *arrow[1:]]), (3, arrow)]
    cut = spark.createDataFrame(rows, f"i int, f {FACE}").select("i", m.triangulated(F.col("f")).alias("t"))
    out = {r["i"]: [tuple(t) for t in r["t"]] for r in cut.collect()}
    assert out[0] == [(0, 1, 2), (0, 2, 3), (0, 3, 4)] and out[1] == out[2] == [(0, 1, 2), (0, 2, 3)] and sorted(map(sorted, out[3])) == [[0, 1, 3], [1, 2, 3]]
    assert "ArrowEvalPython" in cut._jdf.queryExecution().executedPlan().toString()
