"""Mixing sources to target weights by hash thresholds (DataFrame functions only).

Each document has a hash in [0, 1). A source's documents below a threshold are taken, so a larger budget only ever adds documents.
The threshold that meets a budget is found without sorting: words are summed by source and the first bits of the hash, the bucket in
which the running sum crosses the budget is found, and only that bucket's documents are summed again by the next bits. A target
above the source's size takes every document whole once or twice, and the threshold deals out the rest.

Defined cases: a null text has size 0; a null source is a source of its own, the last; rows with the same doc_id have the same hash
and go together; all sizes 0 give targets 0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column_or_null, settle, small, word_count


@dataclass(frozen=True)
class Mix:
    """Weights go to the sources in code point order, repeating; ``level_bits`` of the hash are looked at per refinement."""

    weights: tuple[int, ...] = (5, 2, 1)
    max_copies: int = 3
    level_bits: int = 12
    levels: int = 3


def hashed(doc_id: Column, bits: int) -> Column:
    """The first ``bits`` bits of the MD5 of an id's text; a null id counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, bits // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """source, source_size, target of each source; ``sizes`` has source, source_size.

    Targets are min(cap, level * weight) with the level at which they add up to the total. Sorted by cap / weight, the capped
    sources are those before the first whose level would not reach its cap. One row a source: that is what this window sorts.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, mix.weights)), (F.row_number().over(one) - 1) % len(mix.weights) + 1)
    t = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * mix.max_copies)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    t = t.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    t = t.withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    t = t.withColumn("at", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level")))).over(every)["level"])
    return t.select("source", "source_size", F.when(F.col("at").isNull() | (F.col("at") * F.col("weight") > F.col("cap")), F.col("cap").cast("double")).otherwise(F.col("at") * F.col("weight")).alias("target"))


def thresholds(docs: DataFrame, budgets: DataFrame, mix: Mix) -> DataFrame:
    """source, threshold: documents with a hash below it add up to the budget as nearly as the last bucket allows.

    ``docs`` has source, size, h; ``budgets`` has source, budget (less than the source's size).
    """
    total = mix.level_bits * mix.levels
    state = settle(budgets.select(F.col("source").alias("b_source"), F.col("budget").alias("left"), F.lit(0).cast("long").alias("floor"), F.lit(False).alias("whole")))
    same = F.col("source").eqNullSafe(F.col("b_source"))
    for level in range(mix.levels):
        width = 1 << (total - mix.level_bits * (level + 1))
        inside = docs.select("source", "size", "h").join(small(state), same)
        if level:
            inside = inside.where((F.col("h") >= F.col("floor")) & (F.col("h") < F.col("floor") + width * (1 << mix.level_bits)))
        hist = inside.groupBy("b_source", "left", "floor", (F.col("h") - F.col("h") % width).alias("bucket")).agg(F.sum("size").alias("words"))
        cum = hist.withColumn("cum", F.sum("words").over(Window.partitionBy("b_source").orderBy("bucket")))
        # The boundary is the first bucket whose running sum exceeds what is left; ``under`` is the sum before it.
        edge = cum.where(F.col("cum") > F.col("left")).groupBy("b_source").agg(F.min(F.struct("bucket", (F.col("cum") - F.col("words")).alias("under"), "words", "left")).alias("e"))
        found = edge.select("b_source", (F.col("e.left") - F.col("e.under")).alias("left"), F.col("e.bucket").alias("floor"), (2 * (F.col("e.left") - F.col("e.under")) >= F.col("e.words")).alias("whole"))
        state = settle(found)
    # The last bucket is taken if that comes nearer to the budget than leaving it.
    return state.select(F.col("b_source").alias("source"), (F.col("floor") + F.when(F.col("whole"), 1).otherwise(0)).alias("threshold"))


def mix_sources(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every document."""
    bits = mix.level_bits * mix.levels
    base = docs.select("doc_id", column_or_null(docs, "source", "string").alias("source"), word_count(F.col("text")).alias("size"), hashed(F.col("doc_id"), bits).alias("h"))
    # Four numbers a document, read once per level; the texts are read once.
    base = settle(base)
    goal = settle(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), mix))
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    cut = thresholds(base, goal.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")), mix)
    plan = goal.join(cut.withColumnRenamed("source", "c_source"), F.col("source").eqNullSafe(F.col("c_source")), "left").select(F.col("source").alias("p_source"), "source_size", "target", "whole", F.coalesce("threshold", F.lit(0)).alias("threshold"))
    copies = (F.col("whole") + F.when((F.col("h") < F.col("threshold")) & (F.col("whole") < mix.max_copies), 1).otherwise(0)).cast("long")
    # A row a source: counted, and broadcast where they are few, so that a source with a third of all rows stays spread.
    out = base.join(small(settle(plan)), F.col("source").eqNullSafe(F.col("p_source")), "left")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))
