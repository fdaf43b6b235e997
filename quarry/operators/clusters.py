"""Weighted k-means over a histogram: many points become few boxes, and rounds run over the boxes.

A point is a list of whole numbers, such as the levels of a colour. Points whose numbers agree in their upper bits share a box, with a count
and sums; both are exact, so results do not depend on how rows are dealt out. The start is seeded by the data: the heaviest box, then each
time the box with the largest weight times squared distance from all centres so far. In a round, tasks assign their boxes to the nearest
centre and hand on one row a centre; the centres, a few numbers, go to all tasks as literals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kept import kept

#: Boxes that may be sent to where the points are.
BROADCAST_BOXES = 400_000


@dataclass(frozen=True)
class KMeans:
    """At most ``k`` centres; numbers that agree but for their last ``shift`` bits share a box; rounds end when no centre moves."""

    k: int
    shift: int = 3
    rounds: int = 24


def histogram(points: DataFrame, values: str, dims: int, shift: int) -> DataFrame:
    """box, w, s: the boxes of ``points``, how many points are in each, and their sums. Nulls and points of other lengths are in none."""
    v = F.col(values)
    fine = v.isNotNull() & (F.size(v) == dims) & ~F.exists(v, lambda x: x.isNull())
    boxed = points.where(fine).select(v.cast("array<bigint>").alias("_v")).select("_v", F.transform("_v", lambda x: F.shiftright(x, shift)).alias("box"))
    sums = boxed.groupBy("box").agg(F.count("*").alias("w"), *[F.sum(F.col("_v")[j]).alias(f"s{j}") for j in range(dims)])
    return sums.select("box", "w", F.array(*[F.col(f"s{j}") for j in range(dims)]).alias("s"))


def _read(b: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, sums and mean points of a batch (w, s)."""
    w = b.column("w").to_numpy(zero_copy_only=False)
    s = b.column("s").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return w, s, s / w[:, None]


def distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances, summed up axis by axis, so that a point has one distance however it is batched."""
    out = np.zeros(len(points))
    for j in range(points.shape[1]):
        out += (points[:, j] - centre[j]) ** 2
    return out


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each point; of equal ones the first."""
    best, at = np.full(len(points), np.inf), np.zeros(len(points), np.int64)
    for c, centre in enumerate(centres):
        d = distances(points, centre)
        at[d < best] = c
        best = np.minimum(best, d)
    return at


def start(boxes: DataFrame, dims: int, k: int) -> np.ndarray:
    """The first centres; of boxes that are alike the first is taken, in the order of their numbers."""

    def scored(centres: np.ndarray) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    w, _, p = _read(b, dims)
                    score = w.astype(float)
                    if len(centres):
                        score = score * np.min([distances(p, c) for c in centres], axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(score), *map(b.column, ("box", "w", "s"))], ["score", "box", "w", "s"])

        return run

    centres = np.zeros((0, dims))
    order = [F.col("score").desc(), F.col("box").asc()]
    for _ in range(k):
        first = boxes.mapInArrow(scored(centres), "score double, box array<bigint>, w bigint, s array<bigint>").orderBy(*order).limit(1).collect()
        if not first or (len(centres) and first[0]["score"] <= 0):
            break
        centres = np.vstack([centres, np.array(first[0]["s"]) / first[0]["w"]])
    return centres


def lloyd(boxes: DataFrame, centres: np.ndarray, rounds: int) -> np.ndarray:
    """The centres after the rounds; one that nothing is nearest to stays where it is."""
    k, dims = centres.shape

    def moved(at: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
            for b in batches:
                if b.num_rows:
                    w, s, p = _read(b, dims)
                    c = nearest(p, at)
                    np.add.at(total, c, w)
                    np.add.at(sums, c, s)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], ["c", "w", "s"])

        parts = boxes.mapInArrow(run, "c bigint, w bigint, s array<bigint>")
        merged = parts.groupBy("c").agg(F.sum("w").alias("w"), *[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(dims)]).collect()
        out = at.copy()
        for r in merged:
            out[r["c"]] = np.array([r[f"s{j}"] for j in range(dims)]) / r["w"]
        return out

    for _ in range(rounds):
        last, centres = centres, moved(centres)
        if np.array_equal(last, centres):
            break
    return centres


@dataclass(frozen=True)
class Clusters:
    """``boxes``: box, w, s and the cluster of each; ``centres``: a row a cluster."""

    boxes: DataFrame
    centres: np.ndarray
    dims: int
    shift: int

    def label(self, points: DataFrame, values: str, name: str = "cluster") -> DataFrame:
        """``points`` with the cluster of their box; null where a point has none."""
        small = self.boxes.limit(BROADCAST_BOXES + 1).count() <= BROADCAST_BOXES
        boxes = self.boxes.select(F.col("box").alias("_box"), F.col("cluster").alias("_cluster"))
        box = F.transform(F.col(values).cast("array<bigint>"), lambda x: F.shiftright(x, self.shift))
        out = points.drop(name).withColumn("_of", box).join(F.broadcast(boxes) if small else boxes, F.col("_of") == F.col("_box"), "left")
        return out.withColumn(name, F.col("_cluster")).drop("_of", "_box", "_cluster")


def kmeans(points: DataFrame, values: str, dims: int, how: KMeans) -> Clusters:
    """Clusters of the points that ``values`` (a list of ``dims`` whole numbers) gives; clusters that stay empty have no number.

    Defined cases: fewer boxes than centres give a cluster a box; equal distances go to the first centre; no points, no clusters.
    """
    boxes = kept(histogram(points, values, dims, how.shift))
    centres = lloyd(boxes, start(boxes, dims, how.k), how.rounds) if not boxes.isEmpty() else np.zeros((0, dims))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*map(b.column, ("box", "w", "s")), pa.array(nearest(_read(b, dims)[2], centres))], ["box", "w", "s", "c"])

    labelled = kept(boxes.mapInArrow(assigned, "box array<bigint>, w bigint, s array<bigint>, c bigint"))
    used = sorted(r["c"] for r in labelled.select("c").distinct().collect())  # at most k
    number = F.create_map(*[F.lit(x) for pair in ((c, i) for i, c in enumerate(used)) for x in pair]) if used else F.create_map().cast("map<bigint,int>")
    return Clusters(labelled.select("box", "w", "s", number[F.col("c")].cast("int").alias("cluster")), centres[used], dims, how.shift)
