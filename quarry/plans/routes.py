"""Cheapest conversion routes of at most three hops.

A route is a path over the edge table. The hops are joins of the frontier with the edges, each followed by an aggregate that keeps the
cheapest path per (origin, node, hops): the frontier never holds more than origins times formats rows, and a cheap long path never
hides a dearer short one that can still go on. The edge table is small and broadcast by the planner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_HOPS = 3


def admissible(edges: DataFrame, shaping: bool = False, priority: DataFrame | None = None) -> DataFrame:
    """Edges of ordinary routes; an engine's priority (0 to 9) is added to its costs."""
    e = edges.where(F.col("special").isNull() & (F.col("from") != F.col("to")))
    if shaping:
        e = e.where(~F.col("unshaped"))
    if priority is not None:
        e = e.join(F.broadcast(priority), "engine", "left").withColumn("cost", F.col("cost") + F.coalesce("priority", F.lit(0))).drop("priority")
    return e


def routes(origins: DataFrame, edges: DataFrame, targets: Column | None = None) -> DataFrame:
    """origin, target, cost, hops, path of the cheapest route from each origin (id, category) to each format it can become.

    Of routes with one cost the shorter counts, then the first by its path. A direct-only edge is a route of its own.
    """
    step = edges.select(F.col("from").alias("_f"), F.col("to").alias("_t"), F.col("cost").alias("_c"), "engine", "direct_only", "image_sources_only", "not_for_image_sources", "sources")
    front = origins.select(F.col("id").alias("origin"), (F.col("category") == "image").alias("_image"), F.col("id").alias("node"), F.lit(0).alias("cost"), F.array("id").alias("path"))
    found = None
    for hop in range(1, MAX_HOPS + 1):
        allowed = (~F.col("image_sources_only") | F.col("_image")) & (~F.col("not_for_image_sources") | ~F.col("_image")) & (F.col("sources").isNull() | F.array_contains("sources", F.col("origin")))
        nxt = front.join(step, front["node"] == step["_f"]).where(allowed & ~F.array_contains("path", F.col("_t")))
        if hop > 1:
            nxt = nxt.where(~F.col("direct_only"))
        nxt = nxt.select("origin", "_image", F.col("_t").alias("node"), (F.col("cost") + F.col("_c")).alias("cost"), F.concat("path", F.array("_t")).alias("path"), "direct_only")
        best = nxt.groupBy("origin", "_image", "node").agg(F.min(F.struct("cost", "path")).alias("b")).select("origin", "_image", "node", "b.cost", "b.path", F.lit(hop).alias("hops"))
        found = best if found is None else found.unionAll(best)
        front = nxt.where(~F.col("direct_only")).groupBy("origin", "_image", "node").agg(F.min(F.struct("cost", "path")).alias("b")).select("origin", "_image", "node", "b.cost", "b.path")
    out = found.groupBy("origin", F.col("node").alias("target")).agg(F.min(F.struct("cost", "hops", "path")).alias("b")).select("origin", "target", "b.cost", "b.hops", "b.path")
    return out.where(targets) if targets is not None else out


def self_conversion(edges: DataFrame) -> DataFrame:
    """format, engine, cost: the cheapest explicit edge of a format to itself."""
    own = edges.where(F.col("special").isNull() & (F.col("from") == F.col("to")))
    return own.groupBy(F.col("from").alias("format")).agg(F.min(F.struct("cost", "engine")).alias("b")).select("format", "b.engine", "b.cost")


def special_route(edges: DataFrame, order: list[str]) -> DataFrame:
    """from, to, special, cost: single special edges; of several kinds the first of ``order`` counts."""
    rank = F.coalesce(*[F.when(F.col("special") == s, F.lit(i)) for i, s in enumerate(order)])
    e = edges.where(F.col("special").isin(*order))
    return e.groupBy("from", "to").agg(F.min(F.struct(rank.alias("rank"), "cost", "special")).alias("b")).select("from", "to", "b.special", "b.cost")


def composed(first: DataFrame, second: DataFrame) -> DataFrame:
    """Routes through a step in between (OCR to PDF, translation, an opened envelope): the cheapest of first + second."""
    a = first.select("origin", F.col("target").alias("_m"), F.col("cost").alias("_c1"), F.col("path").alias("_p1"))
    b = second.select(F.col("origin").alias("_m"), "target", F.col("cost").alias("_c2"), F.col("path").alias("_p2"))
    both = a.join(b, "_m").select("origin", "target", (F.col("_c1") + F.col("_c2")).alias("cost"), F.concat("_p1", F.slice("_p2", 2, MAX_HOPS)).alias("path"))
    return both.groupBy("origin", "target").agg(F.min(F.struct("cost", "path")).alias("b")).select("origin", "target", "b.cost", "b.path")
