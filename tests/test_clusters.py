import numpy as np
from pyspark.sql import functions as F

from quarry.operators import clusters as o

SF = "/root/testdata/sf0.001"


def brute(points, k, shift, rounds):
    """Labels of the points and centres, by loops over boxes."""
    boxes = {}
    for p in points:
        key = tuple(x >> shift for x in p)
        w, s = boxes.get(key, (0, np.zeros(len(p), np.int64)))
        boxes[key] = w + 1, s + np.array(p)
    keys = sorted(boxes)
    w = np.array([boxes[x][0] for x in keys])
    s = np.array([boxes[x][1] for x in keys])
    at = s / w[:, None]
    dist = lambda c: sum((at[:, j] - c[j]) ** 2 for j in range(at.shape[1]))
    centres, score = [], w.astype(float)
    for _ in range(k):
        best = int(np.argmax(score))
        if centres and score[best] <= 0:
            break
        centres.append(at[best])
        score = w * np.min([dist(c) for c in centres], axis=0)
    for _ in range(rounds):
        near = np.argmin([dist(c) for c in centres], axis=0)
        new = [s[near == c].sum(axis=0) / w[near == c].sum() if (near == c).any() else centres[c] for c in range(len(centres))]
        if np.array_equal(new, centres):
            break
        centres = new
    near = np.argmin([dist(c) for c in centres], axis=0)
    used = sorted(set(near.tolist()))
    return {x: used.index(n) for x, n in zip(keys, near.tolist())}, np.array([centres[c] for c in used])


def levels(spark, dims):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    return e.select("vec_id", F.transform(F.slice("embedding", 1, dims), lambda x: F.floor((x.cast("double") + 1) * 128).cast("int")).alias("v"))


def test_equals_a_loop_over_embeddings(spark):
    for dims, k, shift in ((3, 8, 3), (3, 40, 4), (64, 5, 5)):
        points = levels(spark, dims)
        rows = [tuple(r["v"]) for r in points.collect()]
        labels, centres = brute(rows, k, shift, 24)
        got = o.kmeans(points.repartition(7), "v", dims, o.KMeans(k, shift))
        assert np.array_equal(got.centres, centres)
        assert got.boxes.count() == len(labels) and got.boxes.agg(F.sum("w")).first()[0] == len(rows)
        assert {tuple(r["box"]): r["cluster"] for r in got.boxes.collect()} == labels
        out = got.label(points, "v")
        assert out.columns == ["vec_id", "v", "cluster"]
        assert all(r["cluster"] == labels[tuple(x >> shift for x in r["v"])] for r in out.collect())


def test_few_boxes_and_odd_points(spark):
    rows = [(1, [0, 0], "a"), (2, [1, 1], None), (3, [200, 200], "c"), (4, None, "d"), (5, [1], "e"), (6, [1, None], "f"), (7, [0, 0], "g")]
    points = spark.createDataFrame(rows, "id int, v array<int>, cluster string")
    got = o.kmeans(points, "v", 2, o.KMeans(10))
    assert got.centres.tolist() == [[1 / 3, 1 / 3], [200.0, 200.0]]
    assert {r["id"]: r["cluster"] for r in got.label(points, "v").collect()} == {1: 0, 2: 0, 3: 1, 4: None, 5: None, 6: None, 7: 0}
    none = o.kmeans(points.where("id > 9"), "v", 2, o.KMeans(3))
    assert none.boxes.count() == 0 and len(none.centres) == 0 and {r["cluster"] for r in none.label(points, "v").collect()} == {None}


def test_one_hot_box(spark):
    """A colour that most points share is one row of the histogram."""
    points = spark.range(30_000).select(F.when(F.col("id") % 10 > 0, F.array(F.lit(7), F.lit(7), F.lit(7))).otherwise(F.array(F.col("id") % 256, F.lit(0), F.lit(255)).cast("array<int>")).alias("v"))
    got = o.kmeans(points, "v", 3, o.KMeans(4))
    assert got.boxes.count() <= 33 and got.boxes.agg(F.max("w")).first()[0] == 27_000
