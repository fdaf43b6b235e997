"""Semi-structured records to tables: unwrapping, one-level flattening, column union in first-seen order, layouts.

Records come as JSON text. The schema is not guessed by a scan of its own: the columns are an aggregate over the keys (one small row a
key), and the values are then read with that list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def columns_in_order(records: DataFrame, order: str, json: str) -> DataFrame:
    """column, first_row, first_pos: all keys, flattened one level, by where they were first seen."""
    top = records.select(order, F.posexplode(F.json_object_keys(json)).alias("pos", "key"), F.col(json).alias("_j"))
    value = F.call_function("get_json_object", F.col("_j"), F.concat(F.lit("$['"), F.col("key"), F.lit("']")))
    top = top.withColumn("_v", value)
    nested = F.when(F.col("_v").startswith("{"), F.json_object_keys("_v"))
    flat = top.select(order, "pos", F.posexplode_outer(nested).alias("sub", "child"), "key").select(order, "pos", F.coalesce("sub", F.lit(0)).alias("sub"), F.when(F.col("child").isNotNull(), F.concat_ws(".", "key", "child")).otherwise(F.col("key")).alias("column"))
    return flat.groupBy("column").agg(F.min(F.struct(order, "pos", "sub")).alias("f")).select("column", F.col(f"f.{order}").alias("first_row"), F.col("f.pos").alias("first_pos"), F.col("f.sub").alias("first_sub"))


def field(json: str | Column, path: str) -> Column:
    """The text of ``a`` or ``a.b`` of a record; null where it is missing."""
    return F.get_json_object(json, "$" + "".join(f"['{p}']" for p in path.split(".")))


def shape(json: Column) -> Column:
    """What a JSON text is as a table: records, rows, values, columns, record, or the reason why it is none."""
    array = F.from_json(json, "array<string>")
    every = lambda test: F.forall(array, test)
    is_object = lambda x: F.coalesce(x.startswith("{"), F.lit(True))
    is_list = lambda x: F.coalesce(x.startswith("["), F.lit(False))
    scalar = lambda x: ~F.coalesce(x.startswith("[") | x.startswith("{"), F.lit(False))
    flat_list = lambda x: is_list(x) & F.forall(F.from_json(x, "array<string>"), scalar)
    values = F.map_values(F.from_json(json, "map<string,string>"))
    columns = (F.size(values) > 0) & F.forall(values, flat_list)
    listed = F.when(F.size(array) == 0, "empty").when(every(is_object), "records").when(every(flat_list), "rows").when(every(scalar), "values").otherwise("mixed: objects, lists and single values")
    return F.when(F.ltrim(json).startswith("["), listed).when(F.ltrim(json).startswith("{"), F.when(columns, "columns").otherwise("record")).otherwise("single value")


def unwrapped(json: Column, depth: int = 4) -> Column:
    """The record list inside single-key wrapper objects."""
    for _ in range(depth):
        inside = F.map_values(F.from_json(json, "map<string,string>"))[0]
        one = json.startswith("{") & (F.size(F.json_object_keys(json)) == 1)
        holds = inside.startswith("{") | (inside.startswith("[") & F.exists(F.from_json(inside, "array<string>"), lambda x: x.startswith("{")))
        json = F.when(F.coalesce(one & holds, F.lit(False)), inside).otherwise(json)
    return json


def csv_row(cells: list[Column], separator: str = ",") -> Column:
    """A CSV line with minimal quoting: separators, quotes, line breaks and blanks at the ends."""

    def cell(c: Column) -> Column:
        c = F.coalesce(c.cast("string"), F.lit(""))
        needs = c.contains(separator) | c.contains('"') | c.rlike("[\r\n]") | c.startswith(" ") | c.endswith(" ")
        return F.when(needs, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    return F.concat_ws(separator, *map(cell, cells))


def not_empty(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with some text in any column."""
    return df.where(F.exists(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), lambda x: x != ""))


def delimiter(head: Column) -> Column:
    """The most frequent of comma, semicolon and TAB outside quotes in the first 4096 characters; ties go to the comma, then the semicolon."""
    bare = F.regexp_replace(F.substring(head, 1, 4096), '"[^"]*"', "")
    n = [F.length(bare) - F.length(F.translate(bare, d, "")) for d in (",", ";", "\t")]
    return F.when((n[0] >= n[1]) & (n[0] >= n[2]), ",").when(n[1] >= n[2], ";").otherwise("\t")


def layout(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, type, width, decimals of a fixed-width table: logical, number or text; one aggregate over all columns."""
    stats = []
    for c in columns:
        t = F.col(c)
        full = t.isNotNull() & (t != "")
        whole, real = t.rlike(r"^-?[0-9]{1,18}$"), t.rlike(r"^-?[0-9]+\.[0-9]+$")
        stats.append(F.struct(
            F.lit(c).alias("column"), F.bool_and(F.when(full, t.isin("true", "false"))).alias("logical"), F.bool_and(F.when(full, whole)).alias("whole"), F.bool_and(F.when(full, whole | real)).alias("number"),
            F.max(F.when(full, F.octet_length(t))).alias("bytes"), F.max(F.when(full & real, F.length(F.regexp_extract(t, r"\.([0-9]+)$", 1)))).alias("decimals"), F.max(F.when(full, F.length(F.regexp_extract(t, r"^(-?[0-9]+)", 1)))).alias("whole_digits"),
        ))
    one = df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    fixed = F.col("number") & (F.coalesce("decimals", F.lit(0)) <= 15) & (F.col("whole_digits") + 1 + F.coalesce("decimals", F.lit(0)) <= 24)
    kind = F.when(F.col("bytes").isNull(), "text").when(F.col("logical"), "logical").when(F.col("whole"), "integer").when(fixed, "decimal").otherwise("text")
    width = F.when(kind == "logical", 1).when(kind == "integer", F.col("bytes")).when(kind == "decimal", F.col("whole_digits") + 1 + F.col("decimals")).otherwise(F.least(F.lit(254), F.coalesce("bytes", F.lit(1))))
    return one.select("column", kind.alias("type"), width.cast("int").alias("width"), F.when(kind == "decimal", F.col("decimals")).otherwise(0).cast("int").alias("decimals"))


def display_width(text: Column) -> Column:
    """Columns that a text takes on screen: wide East Asian characters take two."""
    wide = r"[\x{1100}-\x{115F}\x{2E80}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}]"
    return 2 * F.length(text) - F.length(F.regexp_replace(text, wide, ""))
