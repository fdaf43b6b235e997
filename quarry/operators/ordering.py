"""Whole tables in order: ranges and numbers by several keys at once, without gathering rows in one task.

A sample of the keys gives the bounds of ranges. Bounds are a row sent to all tasks and are compared key by key, so ascending and descending keys, texts
and nulls at either end mix freely, and a row is in one range wherever the result is used. Rows that are alike in all keys are ordered by
the place at which they are read, so a key that half of the rows share is cut into as many ranges as others. Each range is sorted on its
own, and its first number is the sum of the counts of the ranges before it.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType, TimestampNTZType, TimestampType

from ..functions.names import folder_key, natural_key
from .kept import kept

#: Ranges for each shuffle partition, so that partitions which get one more than others are not much larger; keys of a sample for each range.
RANGES, PER_RANGE = 3, 20
#: Characters of a text in a bound. Any text is a valid bound, so a beginning is; the order itself is by whole texts.
BOUND_TEXT = 256


@dataclass(frozen=True)
class Key:
    """One key of an order: a name or column, its direction, and whether nulls come last rather than first."""

    by: str | Column
    descending: bool = False
    nulls_last: bool = False

    @property
    def column(self) -> Column:
        return F.col(self.by) if isinstance(self.by, str) else self.by

    def sorting(self, name: str) -> Column:
        """The sort order of a column that holds this key."""
        c = F.col(name)
        if self.descending:
            return c.desc_nulls_last() if self.nulls_last else c.desc_nulls_first()
        return c.asc_nulls_last() if self.nulls_last else c.asc_nulls_first()

    def after(self, a: Column, b: Column) -> Column:
        """Does ``a`` come after ``b``? Never null."""
        apart = a < b if self.descending else a > b
        return F.when(a.isNull() | b.isNull(), (a.isNull() & b.isNotNull()) if self.nulls_last else (a.isNotNull() & b.isNull())).otherwise(apart)


def _shortened(value: object) -> object:
    return value[:BOUND_TEXT] if isinstance(value, str) else value


def keyed(df: DataFrame, keys: list[Key], prefix: str) -> tuple[DataFrame, list[str], list[Key]]:
    """``df`` computed once, with a column per key and a last one for the place at which a row was read; their names and keys."""
    names, columns = [f"{prefix}{i}" for i in range(len(keys))], {}
    for name, key in zip(names, keys, strict=True):
        kind = df.select(key.column.alias(name)).schema[name].dataType
        columns[name] = key.column
        if isinstance(kind, TimestampType):  # as numbers: time zones repeat hours, and literals know no zone
            columns[name] = F.unix_micros(key.column)
        elif isinstance(kind, TimestampNTZType):
            columns[name] = F.timestamp_diff("MICROSECOND", F.lit(datetime.datetime(1970, 1, 1)).cast("timestamp_ntz"), key.column)
    place = f"{prefix}{len(keys)}"
    return kept(df.withColumns(columns | {place: F.monotonically_increasing_id()})), [*names, place], [*keys, Key(place)]


def bounds(table: DataFrame, names: list[str], keys: list[Key], ranges: int) -> list[tuple]:
    """Keys that cut ``table`` into about so many ranges of one size, in order."""
    n = table.count()
    wanted = PER_RANGE * ranges
    picked = table.select(*names)
    if n > 2 * wanted:
        picked = picked.sample(1.2 * wanted / n, 7)
    rows = picked.orderBy(*[k.sorting(c) for k, c in zip(keys, names, strict=True)]).collect()
    step = max(1, -(-len(rows) // ranges))
    cut = [tuple(map(_shortened, r)) for r in rows[step::step]]
    return [b for i, b in enumerate(cut) if i == 0 or b != cut[i - 1]]


def with_range(table: DataFrame, names: list[str], keys: list[Key], cuts: list[tuple], part: str) -> DataFrame:
    """``table`` with the number of bounds that a row does not come before, by a binary search over them.

    The bounds are one row that every task gets: as literals, hundreds of them with lists of texts took the driver minutes to plan.
    """
    if not cuts:
        return table.withColumn(part, F.lit(0))
    bound = f"{part}b"
    kind = StructType([StructField(bound, ArrayType(StructType([StructField(c, table.schema[c].dataType) for c in names])))])
    one = table.sparkSession.createDataFrame([(cuts,)], kind)
    all_cuts = F.col(bound)

    def reached(cut: Column) -> Column:
        out = F.lit(True)
        for key, c in reversed([*zip(keys, names, strict=True)]):
            out = key.after(F.col(c), cut[c]) | (F.col(c).eqNullSafe(cut[c]) & out)
        return out

    steps = F.array(*[F.lit(2**k) for k in reversed(range(len(cuts).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & reached(F.get(all_cuts, at + step - 1)), at + step).otherwise(at))
    return table.crossJoin(F.broadcast(one)).withColumn(part, found).drop(bound)


def _longs(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{v}L' for v in values)})")


def _ranges(df: DataFrame, order: list[Key]) -> tuple[DataFrame, list[Column], str, int]:
    """``df`` computed once with its keys, their sort order, the name of the column with each row's range, and the number of ranges."""
    prefix = "_k"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    table, names, keys = keyed(df, order, prefix)
    cuts = bounds(table, names, keys, RANGES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = f"{prefix}p"
    return with_range(table, names, keys, cuts, part), [k.sorting(c) for k, c in zip(keys, names, strict=True)], part, len(cuts) + 1


def ranged(df: DataFrame, order: list[Key], name: str) -> DataFrame:
    """``df`` computed once, with the range that each row is in, from 0 on; all rows of a range come before those of the next."""
    table, _, part, _ = _ranges(df, order)
    return table.select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.col(part).alias(name))


def ranked(df: DataFrame, order: list[Key], name: str = "place") -> DataFrame:
    """Rows numbered from 1 in an order of several keys; rows alike in all keys are numbered as they are read.

    Defined cases: nulls stand where their key says; an empty table stays empty; a column of that name is replaced.
    """
    own = [F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()]
    table, sorting, part, ranges = _ranges(df, order)
    counts = {r[part]: r["count"] for r in table.groupBy(part).count().collect()}  # a number a range
    before = [0, *accumulate(counts.get(i, 0) for i in range(ranges - 1))]
    at = F.row_number().over(Window.partitionBy(part).orderBy(*sorting))
    return table.withColumn(f"{part}n", (F.get(_longs(before), F.col(part)) + at).cast("long")).select(*own, F.col(f"{part}n").alias(name))


#: The orders of files: by name or a date, and backwards.
FILE_ORDERS = ("name", "name_descending", "modified", "modified_descending", "created", "created_descending")


def file_order(order: str, path: str = "path", modified: str = "modified", created: str = "created", folders_together: bool = False) -> list[Key]:
    """The keys of one of ``FILE_ORDERS``: dates that are not known come last in both directions, and names decide between equal dates.

    A name is the last part of a path in natural order, or with ``folders_together`` the whole path by levels, sub-folders before files;
    the natural order of whole paths decides between equal names.
    """
    if order not in FILE_ORDERS:
        raise ValueError(f"no order of files: {order}")
    back = order.endswith("_descending")
    name = folder_key(F.col(path)) if folders_together else natural_key(F.regexp_extract(F.col(path), r"([^/\\]*)$", 1))
    names = [name, natural_key(F.col(path))]
    if order.startswith("name"):
        return [Key(c, back) for c in names]
    return [Key(modified if order.startswith("modified") else created, back, nulls_last=True), *map(Key, names)]


def running(df: DataFrame, order: list[Key], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of a whole number over all rows before each, in an order of several keys; nulls add nothing.

    Ranges are summed up first, one number each, and every range is run through on its own.
    """
    own = [F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()]
    table, sorting, part, ranges = _ranges(df.withColumn("_v_of_running", F.coalesce(value.cast("long"), F.lit(0).cast("long"))), order)
    sums = {r[part]: r["n"] for r in table.groupBy(part).agg(F.sum("_v_of_running").alias("n")).collect()}
    before = [0, *accumulate(sums.get(i, 0) for i in range(ranges - 1))]
    inside = F.sum("_v_of_running").over(Window.partitionBy(part).orderBy(*sorting).rowsBetween(Window.unboundedPreceding, -1))
    at = F.get(_longs(before), F.col(part)) + F.coalesce(inside, F.lit(0))
    return table.withColumn(f"{part}n", at.cast("long")).select(*own, F.col(f"{part}n").alias(name))
