import random

from pyspark.sql import functions as F

from quarry.operators import geo as o

RING = "array<struct<x: double, y: double>>"


def holds(ring, x, y):
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        if (by > y) != (ay > y) and x < (ax - bx) * (y - by) / (ay - by) + bx:
            inside = not inside
    return inside


def area(ring):
    return sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(ring, ring[1:]))


def boxed(ring, x, y):
    return min(p[0] for p in ring) <= x <= max(p[0] for p in ring) and min(p[1] for p in ring) <= y <= max(p[1] for p in ring)


def brute(rings):
    """(place, ring numbers) of the polygons of one record, as a loop over all rings does it."""
    shut = [(k, r if r[0] == r[-1] else r + r[:1]) for k, r in rings if len(r) >= 3]
    shut = [(k, r, area(r)) for k, r in shut if len(r) >= 4 and area(r) != 0]
    outer = [x for x in shut if x[2] < 0] or shut
    holes = [x for x in shut if x not in outer]
    found, orphans = {k: [k] for k, _, _ in outer}, []
    for k, r, _ in holes:
        near = [(abs(a), j) for j, s, a in outer if boxed(s, *r[0]) and holds(s, *r[0])]
        if near:
            found[min(near)[1]].append(k)
        else:
            orphans.append([k])
    return [found[k] for k, _, _ in outer] + orphans


def star(rng, x, y, size, clockwise):
    import math

    n = rng.randint(3, 9)
    at = [(x + size * rng.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), y + size * rng.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    return at[::-1] if clockwise else at


def rings(seed, n, shells=0.3):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        clockwise = rng.random() < shells
        size = 10 ** rng.uniform(0, 3) if clockwise else rng.uniform(0.1, 5)
        r = star(rng, rng.uniform(-500, 500), rng.uniform(-500, 500), size, clockwise)
        out.append((k, r + r[:1] if rng.random() < 0.5 else r))
    return [*out, (n, [(0, 0), (1, 1)]), (n + 1, [(0, 0), (1, 1), (2, 2), (0, 0)]), (n + 2, [(0, 0), (5, 0), (0, 0)])]


def test_polygons_equal_a_loop(spark):
    records = {1: rings(1, 300), 2: rings(2, 60, 0), 3: rings(3, 40, 1), 4: [(0, [(0, 0), (1, 0), (0, 1)])], 5: [(0, [(0, 0), (1, 1)])]}
    df = spark.createDataFrame([(r, k, [tuple(map(float, p)) for p in ring], "x") for r, all_ in records.items() for k, ring in all_], f"record long, k long, ring {RING}, rings string")
    for cell in (1.0, 5000.0):
        out = o.polygons(df, "record", "k", cell)
        for r, all_ in records.items():
            got = [[p["place"]["shell"], *p["holes"]] for p in sorted(out.where(F.col("record") == r).collect(), key=lambda p: p["place"])]
            assert got == brute(all_), r
    of = {(r, k): ring if ring[0] == ring[-1] else ring + ring[:1] for r, all_ in records.items() for k, ring in all_}
    for p in out.collect():
        assert [[tuple(q) for q in ring] for ring in p["rings"]] == [[tuple(map(float, q)) for q in of[p["record"], k]] for k in (p["place"]["shell"], *p["holes"])]


def square(x, y, size):
    return [(x - size, y - size), (x + size, y - size), (x + size, y + size), (x - size, y + size)]


def test_depth_decides_where_directions_do_not(spark):
    """An island in a lake on an island, all drawn one way."""
    all_ = [(0, square(0.0, 0.0, 100.0)), (1, square(1.0, 1.0, 50.0)), (2, square(2.0, 2.0, 20.0)), (3, square(3.0, 3.0, 5.0)), (4, square(1000.0, 0.0, 7.0))]
    out = o.polygons(spark.createDataFrame([(1, k, r) for k, r in all_], f"record long, k long, ring {RING}"), "record", "k", 10.0, by_depth=True)
    assert sorted([p["place"]["shell"], *p["holes"]] for p in out.collect()) == [[0, 1], [2, 3], [4]]


def test_shells_of_any_size(spark):
    """A shell of a million by a million cells is a few rows, and so is one that all holes are in."""
    shells = [(0, square(0.0, 0.0, 5e5)), (1, square(10.0, 10.0, 3.0)), (2, square(0.0, 0.0, 5e5))]
    shells = spark.createDataFrame([(k, r + r[:1]) for k, r in shells], f"shell long, ring {RING}")
    holes = spark.range(20_000).select(F.col("id").alias("hole"), F.array(o.point(F.col("id") % 200 - 99.5, F.col("id") % 300 - 99.5)).alias("ring"))
    out = o.holes_to_shells(holes, shells, "hole", "shell", 1.0)
    got = {r["shell"]: r["count"] for r in out.groupBy("shell").count().collect()}
    inside = sum(abs(i % 200 - 109.5) < 3 and abs(i % 300 - 109.5) < 3 for i in range(20_000))
    assert got == {0: 20_000 - inside, 1: inside}


def test_no_rings(spark):
    none = spark.createDataFrame([], f"record long, k long, ring {RING}")
    assert o.polygons(none, "record", "k", 1.0).count() == 0
    assert o.polygons(none, "record", "k", 1.0, by_depth=True).count() == 0
    holes = spark.createDataFrame([(1, [(0.0, 0.0)]), (2, None)], f"hole long, ring {RING}")
    assert [r["shell"] for r in o.holes_to_shells(holes, none.select(F.col("k").alias("shell"), "ring"), "hole", "shell", 1.0).collect()] == [None, None]


def test_parts_together_and_apart(spark):
    rows = [(1, 0, "Point", "a"), (1, 1, "Point", "b"), (2, 0, "Polygon", "c"), (3, 1, "LineString", "d"), (3, 0, "Point", "e"), (4, 0, "MultiPoint", "f"), (4, 1, "MultiPoint", "g"), (5, 0, None, None)]
    whole = o.gathered(spark.createDataFrame(rows, "r long, at long, kind string, shape string"), "r", "at", "kind", "shape")
    assert sorted((r["r"], r["kind"], r["parts"]) for r in whole.collect()) == [(1, "MultiPoint", ["a", "b"]), (2, "Polygon", ["c"]), (3, "GeometryCollection", ["e", "d"]), (4, "GeometryCollection", ["f", "g"])]
    apart = o.exploded(whole.where("r < 3"), "kind", "parts")
    assert sorted(tuple(r) for r in apart.collect()) == [(1, 0, "Point", "a"), (1, 1, "Point", "b"), (2, 0, "Polygon", "c")]
    mixed = spark.createDataFrame([(1, "GeometryCollection", [("Point", "a"), ("LineString", "b")]), (2, None, None)], "r long, kind string, parts array<struct<kind: string, shape: string>>")
    assert sorted(map(str, o.exploded(mixed, "kind", "parts").collect())) == ["Row(r=1, part=0, kind='Point', parts='a')", "Row(r=1, part=1, kind='LineString', parts='b')", "Row(r=2, part=None, kind=None, parts=None)"]


def test_points_under_many_boxes_meet_the_smallest_only(spark, monkeypatch):
    """400 nested boxes around 300 points: 120,000 pairs, of which a round of 64 boxes and then unfound points alone are looked at."""
    from pyspark.sql import functions as F

    from quarry.operators import geo as o

    seen, in_boxes = [], o.in_boxes

    def counted(*args):
        out = in_boxes(*args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(o, "in_boxes", counted)
    k = F.col("id")
    points = spark.range(300).select(k.alias("p"), (k % 20 * 3.0).alias("x"), (k % 7 * 4.0).alias("y"))
    boxes = spark.range(400).select(k.alias("b"), (-k - 70.0).alias("x0"), (-k - 70.0).alias("y0"), (k + 70.0).alias("x1"), (k + 70.0).alias("y1"))
    assert {(r["p"], r["b"]) for r in o.smallest_container(points, boxes, "p", "b", 5.0).collect()} == {(i, 0) for i in range(300)}
    assert sum(seen) <= 64 * 300
