"""Sheets as grids of cells: used ranges with merged areas, hidden rows and columns left out, lines of text.

Cells are rows (sheet, row, column, text), 0-based; a sheet may have any number of them, in any order. Merged areas are rows (sheet, top,
left, bottom, right), hidden rows and columns rows (sheet, at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kept import kept

RANGE = ["top", "left", "bottom", "right"]


def used_range(cells: DataFrame, merges: DataFrame, content: Column | None = None) -> DataFrame:
    """sheet, top, left, bottom, right: the smallest range with every cell that has content, and every merged area that begins inside.

    An area widens the range, so that others may begin inside of it: rounds go on until none does, each over the sheets that the last one
    widened. A round is one join and one row a sheet; there are as many as the longest chain has areas. A sheet without content has no range.
    Sheets may be null; areas with a null corner count for nothing.
    """
    content = F.coalesce(F.col("text"), F.lit("")) != "" if content is None else content
    full = cells.where(content & F.col("row").isNotNull() & F.col("column").isNotNull())
    out = kept(full.groupBy("sheet").agg(F.min("row").alias("top"), F.min("column").alias("left"), F.max("row").alias("bottom"), F.max("column").alias("right")))
    areas = merges.select(F.col("sheet").alias("m_sheet"), *[F.col(c).alias(f"m_{c}") for c in RANGE])
    moving = out
    while True:
        inside = (F.col("m_top") <= F.col("bottom")) & (F.col("m_left") <= F.col("right")) & (F.col("m_top") >= F.col("top")) & (F.col("m_left") >= F.col("left"))
        wider = (F.col("m_bottom") > F.col("bottom")) | (F.col("m_right") > F.col("right"))
        hit = areas.join(moving, F.col("m_sheet").eqNullSafe(F.col("sheet")) & inside & wider)
        moving = kept(hit.groupBy("sheet", "top", "left").agg(F.greatest(F.max("bottom"), F.max("m_bottom")).alias("bottom"), F.greatest(F.max("right"), F.max("m_right")).alias("right")))
        if moving.isEmpty():
            return out
        grown = moving.select(F.col("sheet").alias("g_sheet"), F.col("bottom").alias("g_bottom"), F.col("right").alias("g_right"))
        joined = out.join(grown, F.col("sheet").eqNullSafe(F.col("g_sheet")), "left")
        out = kept(joined.select("sheet", "top", "left", F.coalesce("g_bottom", "bottom").alias("bottom"), F.coalesce("g_right", "right").alias("right")))


def shown(cells: DataFrame, hidden: DataFrame, axis: str) -> DataFrame:
    """``cells`` that stand in no hidden row or column (``axis``), moved up by as many as are hidden before them.

    The hidden ones are counted once per sheet and place, not per cell.
    """
    marks = hidden.select("sheet", F.col("at").alias(axis)).distinct()
    places = cells.select("sheet", axis).distinct().withColumn("_h", F.lit(0)).unionByName(marks.withColumn("_h", F.lit(1)))
    places = places.groupBy("sheet", axis).agg(F.max("_h").alias("_h"))
    before = places.withColumn("_n", F.sum("_h").over(Window.partitionBy("sheet").orderBy(axis))).where("_h = 0").select(F.col("sheet").alias("_s"), F.col(axis).alias("_a"), "_n")
    out = cells.join(before, F.col("sheet").eqNullSafe(F.col("_s")) & (F.col(axis) == F.col("_a")))
    return out.withColumn(axis, (F.col(axis) - F.col("_n")).cast(cells.schema[axis].dataType)).drop("_s", "_a", "_n")


def lines(cells: DataFrame, ranges: DataFrame, hidden_rows: DataFrame, hidden_columns: DataFrame, quoted) -> DataFrame:
    """sheet, row, fields: a row of texts for each row from the first to the last of the used range that is not hidden, empty ones too.

    ``quoted`` makes a field of a text. ``row`` is the row's own number. A row of a sheet has as many fields as the sheet has columns.
    """
    off = hidden_columns.groupBy(F.col("sheet").alias("c_sheet")).agg(F.collect_set("at").alias("off"))  # a sheet has some thousand columns at most
    wide = ranges.join(off, F.col("sheet").eqNullSafe(F.col("c_sheet")), "left")
    wide = wide.select("sheet", "bottom", F.array_except(F.sequence(F.lit(0), F.col("right").cast("int")), F.coalesce(F.col("off").cast("array<int>"), F.array().cast("array<int>"))).alias("columns"))
    rows = wide.select(F.col("sheet").alias("r_sheet"), "columns", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bottom").cast("long"))).alias("r_row"))
    rows = rows.join(hidden_rows.select(F.col("sheet").alias("h_sheet"), F.col("at").alias("h_at")), F.col("r_sheet").eqNullSafe(F.col("h_sheet")) & (F.col("r_row") == F.col("h_at")), "left_anti")
    # Of cells in one place the last in text order counts.
    own = cells.groupBy("sheet", "row", F.col("column").cast("int").alias("column")).agg(F.max("text").alias("text"))
    own = own.groupBy("sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("column", "text"))).alias("cells"))
    out = rows.join(own, F.col("r_sheet").eqNullSafe(F.col("sheet")) & (F.col("r_row") == F.col("row")), "left")
    field = lambda c: F.coalesce(F.try_element_at("cells", c), F.lit(""))
    return out.select(F.col("r_sheet").alias("sheet"), F.col("r_row").alias("row"), F.transform("columns", lambda c: quoted(field(c))).alias("fields"))
