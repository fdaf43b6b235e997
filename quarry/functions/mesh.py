"""Faces of meshes: ear clipping of polygons with more than three corners in Arrow batches, totals of meshes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Corners up to which ears are looked for; larger faces, which modelling programs don't make, become fans.
CORNERS = 64
#: Numbers that the faces which are cut together hold at most.
CELLS = 1 << 18


def _cross(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])


def _least(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
    """Is ``a`` at least ``b``? Not-a-number is above all, as in Spark."""
    return (a >= b) | np.isnan(a)


def normal(p: np.ndarray) -> np.ndarray:
    """x, y, z of each of the faces (face, corner, axis): the sum of the edges' contributions, which is right for concave faces too."""
    q = np.roll(p, -1, 1)
    parts = np.stack([(p[..., i] - q[..., i]) * (p[..., j] + q[..., j]) for i, j in ((1, 2), (2, 0), (0, 1))], -1)
    out = np.zeros((len(p), 3))
    for k in range(p.shape[1]):  # in the corners' order
        out += parts[:, k]
    return out


def flattened(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The corners in the plane that drops the normal's largest axis, running counter-clockwise."""
    x, y, z = np.abs(n).T
    axis = np.where(_least(x, y) & _least(x, z), 0, np.where(_least(y, z), 1, 2))
    forward = _least(np.take_along_axis(n, axis[:, None], 1)[:, 0], 0)
    u, v = (axis + 1) % 3, (axis + 2) % 3
    take = lambda at: np.take_along_axis(p, at[:, None, None].repeat(p.shape[1], 1), 2)[..., 0]
    return np.stack([take(np.where(forward, u, v)), take(np.where(forward, v, u))], -1)


def fan(n: int) -> np.ndarray:
    """Triangles of the first corner with each following pair."""
    return np.array([(0, i, i + 1) for i in range(1, n - 1)], np.int32).reshape(-1, 3)


def ears(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Triangles of each of the faces (face, corner, axis), and which are stuck: the first ear is cut off until three corners are left."""
    m, n = flat.shape[:2]
    left, stuck, done = np.tile(np.arange(n, dtype=np.int32), (m, 1)), np.zeros(m, bool), []
    rows = np.arange(m)
    while left.shape[1] > 3:
        size = left.shape[1]
        at = flat[rows[:, None], left]
        p, q, r = np.roll(at, 1, 1), at, np.roll(at, -1, 1)
        ear, first = np.zeros(m, bool), np.zeros(m, np.int64)
        for i in range(size):
            a, b, c = (side[:, i, None, :] for side in (p, q, r))
            inside = _least(_cross(a, b, at), 0) & _least(_cross(b, c, at), 0) & _least(_cross(c, a, at), 0)
            inside[:, [(i - 1) % size, i, (i + 1) % size]] = False
            here = ~ear & ~(_cross(a, b, c)[:, 0] <= 0) & ~inside.any(1)
            first[here], ear = i, ear | here
            if ear.all():
                break
        stuck |= ~ear
        done.append(np.stack([left[rows, (first - 1) % size], left[rows, first], left[rows, (first + 1) % size]], -1))
        left = left[np.arange(size) != first[:, None]].reshape(m, size - 1)
    return np.stack([*done, left], 1), stuck


def _faces(p: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The triangles (face, triangle, corner) of faces that have one number of corners; those that are not ``whole`` become fans."""
    n = p.shape[1]
    out = np.tile(fan(n), (len(p), 1, 1))
    if 3 < n <= CORNERS:
        with np.errstate(all="ignore"):
            m = normal(p)
            fine = np.flatnonzero(whole & (m != 0).any(1) & np.isfinite(m[:, 0]))
            if len(fine):
                cut, stuck = ears(flattened(p[fine], m[fine]))
                out[fine[~stuck]] = cut[~stuck]
    return out


def triangulated(corners: Column) -> Column:
    """Triangles (a, b, c), by the corners' numbers from 0 on, of a face (a list of x, y, z) in its own direction.

    A face that is no simple polygon, has no area or more than ``CORNERS`` corners becomes a fan; one with fewer than three has none.
    Faces of a batch that have as many corners are cut together.
    """

    @F.arrow_udf("array<struct<a: int, b: int, c: int>>")
    def cut(faces: pa.Array) -> pa.Array:
        sizes = np.asarray(pc.fill_null(pc.list_value_length(faces), 0)).astype(np.int64)
        flat = pc.list_flatten(faces)
        axes = [pc.cast(pc.struct_field(flat, c), pa.float64()) for c in ("x", "y", "z")]
        p = np.stack([np.asarray(pc.fill_null(axis, math.nan)) for axis in axes], -1)
        known = np.logical_and.reduce([np.asarray(pc.is_valid(axis)) for axis in axes])
        start, counts = np.cumsum(sizes) - sizes, np.maximum(sizes - 2, 0)
        ends = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty((ends[-1], 3), np.int32)
        for n in np.unique(sizes[sizes > 2]):
            all_of = np.flatnonzero(sizes == n)
            step = max(1, CELLS // (n * min(n, CORNERS)))
            for i in range(0, len(all_of), step):
                some = all_of[i : i + step]
                at = start[some][:, None] + np.arange(n)
                out[ends[some][:, None] + np.arange(n - 2)] = _faces(p[at], known[at].all(1))
        triangles = pa.StructArray.from_arrays([pa.array(out[:, k]) for k in range(3)], ["a", "b", "c"])
        nulls = np.asarray(pc.is_null(faces))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(nulls, False)) if nulls.any() else pa.array(ends, pa.int32()), triangles)

    return cut(corners)


def totals(parts: DataFrame, mesh: str, vertices: str, triangles: str) -> DataFrame:
    """mesh, parts, vertices, triangles: how many each mesh has, from lists of them a part; null lists count as empty."""
    count = lambda c: F.sum(F.greatest(F.size(F.coalesce(F.col(c), F.array().cast(parts.schema[c].dataType))), F.lit(0)).cast("long"))
    return parts.groupBy(mesh).agg(F.count("*").alias("parts"), count(vertices).alias("vertices"), count(triangles).alias("triangles"))
