"""Clusters of points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters as o
from .registry import query


@query()
def weighted_kmeans(spark, table):
    """The first three numbers of every embedding as the levels of a colour, in sixteen clusters. Rounds to a fixed point are not SQL's."""
    levels = F.transform(F.slice("embedding", 1, 3), lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 1) * 128))).cast("int"))
    points = table("embeddings").select("vec_id", levels.alias("levels"))
    return o.kmeans(points, "levels", 3, o.KMeans(16)).label(points, "levels").drop("levels")
