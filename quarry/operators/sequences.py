"""Operators on ordered neighbours: numbering, naming, grouping, intervals, rates.

Every window is partitioned by the key that the data has (user, document, job), so it shuffles once on that key. Numbering over a whole
table has no such key: ``ordering`` does it with ranges and their counts, not by sorting in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from .ordering import Key, ranged, ranked


def dated(date: str | Column, newest_first: bool, *then: Key) -> list[Key]:
    """The order of files by a date: unknown dates last either way, then by what follows."""
    return [Key(date, newest_first, nulls_last=True), *then]


def numbered(df: DataFrame, by: str, name: str = "at") -> DataFrame:
    """Rows numbered from 1 in the order of ``by``, without gathering them in one task."""
    return ranked(df, [Key(by)], name)


def parts(df: DataFrame, by: str, parts: int | None = None, every: int | None = None) -> DataFrame:
    """``part`` and the name ``suffix`` of each row: ``parts`` groups whose first are one longer, or groups of ``every`` rows."""
    at = numbered(df, by)
    if parts is not None:
        at = at.crossJoin(F.broadcast(df.agg(F.count("*").alias("_all"))))
        n = F.least(F.lit(parts), F.col("_all"))
        base, longer = F.floor(F.col("_all") / n), F.col("_all") % n
        edge = longer * (base + 1)
        part = F.when(F.col("at") <= edge, F.floor((F.col("at") - 1) / (base + 1)) + 1).otherwise(longer + F.floor((F.col("at") - 1 - edge) / base) + 1)
    else:
        part = F.floor((F.col("at") - 1) / max(1, every or 1)) + 1
    at = at.withColumn("part", part.cast("int"))
    ends = at.groupBy("part").agg(F.min("at").alias("_a"), F.max("at").alias("_b"))
    suffix = F.concat(F.lit("_p"), F.col("_a").cast("string"), F.when(F.col("_b") > F.col("_a"), F.concat(F.lit("-"), F.col("_b").cast("string"))).otherwise(""))
    return at.join(ends, "part").withColumn("suffix", suffix).drop("_a", "_b", "_all")


def first_free(taken: set[str], counters: dict[str, int], name: str, key: str, numbered: str, end: str = "") -> str:
    """``name`` if its key is free, else ``name`` with the first free number from 2 on, before its ``end``; the choice is taken from now on."""
    if key + end not in taken:
        taken.add(key + end)
        return name + end
    n = counters.get(key, 2)
    while (k := numbered.format(key, n) + end) in taken:
        n += 1
    taken.add(k)
    counters[key] = n + 1
    return numbered.format(name, n) + end


def free_names(wanted: DataFrame, taken: DataFrame, name: str, order: str) -> DataFrame:
    """``free``: the name, or the name with (2), (3), ... where an earlier row or an existing file has it; case does not matter.

    Each row looks at what all rows before it were given, so "a (2)" may be wanted, given or there already. Only names that are alike
    but for such numbers concern each other: their rows are sorted together and read once, and a task holds one such family's names.
    """
    root = F.regexp_replace(F.lower(F.col(name)), r"( \([0-9]+\))+$", "")
    rows = wanted.withColumn("_root", root).withColumn("_there", F.lit(1))
    there = taken.select(F.col(name).cast("string").alias(name)).distinct().withColumn("_root", root).withColumn("_there", F.lit(0))
    rows = rows.unionByName(there, allowMissingColumns=True).repartition("_root").sortWithinPartitions("_root", "_there", order)
    schema = StructType([*wanted.schema.fields, StructField("free", StringType())])
    at, arrow, columns = rows.columns.index(name), to_arrow_schema(schema), wanted.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, counters = None, set(), {}
        for b in batches:
            free, kept = [], []
            for want, family, new in zip(b.column(at).to_pylist(), b.column("_root").to_pylist(), b.column("_there").to_pylist(), strict=True):
                if family != now:
                    now, held, counters = family, set(), {}
                kept.append(bool(new))
                if not new:
                    held.add((want or "").lower())
                elif want is None:
                    free.append(None)
                else:
                    free.append(first_free(held, counters, want, want.lower(), "{} ({})"))
            b = b.select(columns).filter(pa.array(kept, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(free, pa.string())], schema=arrow)

    return rows.mapInArrow(run, schema)


def header_names(row: list[str | None]) -> list[str]:
    """Trimmed names, blank ones named by their place, repeats with _2, _3, ... as far as those are free."""
    taken, counters = set(), {}
    named = [(h or "").strip() or f"column{k}" for k, h in enumerate(row, 1)]
    return [first_free(taken, counters, h, h, "{}_{}") for h in named]


def unique_headers(headers: DataFrame) -> DataFrame:
    """at, header: the names that ``header_names`` gives the one row of headers, a row a column."""
    row = headers.orderBy("at").collect()
    named = header_names([r["header"] for r in row])
    return headers.sparkSession.createDataFrame([(r["at"], h) for r, h in zip(row, named, strict=True)], "at int, header string")


def page_range(df: DataFrame) -> DataFrame:
    """page: the distinct pages that ``expression`` names out of 1 to ``last``; all of them if it names none."""
    item = df.select("last", F.explode(F.split("expression", ",")).alias("raw")).withColumn("raw", F.trim("raw")).where("raw <> ''")
    number = r"^[+-]?[0-9]{1,9}$"
    left, right = F.trim(F.regexp_extract("raw", "^([^-]*)-", 1)), F.trim(F.regexp_extract("raw", "^[^-]*-(.*)$", 1))
    single = ~F.col("raw").contains("-")
    a = F.when(single, F.when(F.col("raw").rlike(number), F.col("raw").try_cast("long"))).when(left == "", F.lit(1)).when(left.rlike(number), left.try_cast("long"))
    b = F.when(single, a).when(right == "", F.col("last")).when(right.rlike(number), right.try_cast("long"))
    ends = item.select("last", a.alias("a"), b.alias("b")).where("a is not null and b is not null and (a >= 0 and b >= 0)")
    ends = ends.select(F.greatest(F.lit(1), F.least("a", "b")).alias("a"), F.least(F.col("last"), F.greatest("a", "b")).alias("b")).where("a <= b")
    found = ends.select(F.explode(F.sequence("a", "b")).alias("page")).distinct()
    every = df.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("last"))).alias("page"))
    none = found.limit(1).agg(F.count("*").alias("n"))
    return found.unionAll(every.join(F.broadcast(none), F.col("n") == 0).select("page"))


def cue_ends(cues: DataFrame, key: str, start: str, line: str, last_ms: int = 4000) -> DataFrame:
    """``end``: each cue ends where the next of its document begins, the last after ``last_ms``; of cues with one start the last stays."""
    w = Window.partitionBy(key).orderBy(start, line)
    out = cues.withColumn("_next", F.lead(start).over(w)).where(F.col("_next").isNull() | (F.col("_next") != F.col(start)))
    return out.withColumn("end", F.coalesce("_next", F.col(start) + last_ms)).drop("_next")


def transfer_rate(samples: DataFrame, key: str, seconds: str, total: str, window: float = 5.0, settle: float = 0.5) -> DataFrame:
    """``rate``: bytes per second since the newest sample at least ``window`` old, or the first; null until ``settle`` has passed.

    The samples within the window and one before it are what is measured; both frames are one sort by key.
    """
    w = f"partition by `{key}` order by `{seconds}`"
    old = f"{w} range between unbounded preceding and {window}D preceding"
    from_s, from_b = (F.coalesce(F.expr(f"last_value(`{c}`) over ({old})"), F.expr(f"first_value(`{c}`) over ({w})")) for c in (seconds, total))
    span = F.col(seconds) - from_s
    return samples.withColumn("rate", F.when((span >= settle) & (span > 0), F.greatest(F.lit(0.0), (F.col(total) - from_b) / span)))


def remaining(done: Column, total: Column, rate: Column) -> Column:
    """Seconds until ``total``; unknown without a rate."""
    return F.when(rate > 0, F.greatest(F.lit(0.0), total - done) / rate)


def sessions(df: DataFrame, key: list[str], order: str, new: Column) -> DataFrame:
    """``session``: a running number that grows where ``new`` holds (gaps and islands)."""
    return df.withColumn("session", F.sum(F.coalesce(new.cast("int"), F.lit(1))).over(Window.partitionBy(*key).orderBy(order)))


def forward_only(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``progress``: a value that never goes back."""
    return df.withColumn("progress", F.max(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def not_repeated(lines: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Lines that are not blank and differ from the line before."""
    w = Window.partitionBy(key).orderBy(order)
    full = lines.where(F.trim(F.col(text)) != "")
    return full.withColumn("_before", F.lag(text).over(w)).where(F.col("_before").isNull() | (F.col("_before") != F.col(text))).drop("_before")


def asof(left: DataFrame, right: DataFrame, at: str, since: str, values: list[str], key: list[str] | None = None) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before it.

    Both sides are one union sorted per key: no theta join. Without a key, rows are dealt to ranges of time, and each range begins with
    the last right row before it, found on the small right side.
    """
    key = key or []
    tagged = left.select(*[F.col(c) for c in left.columns], F.col(at).alias("_t"), F.lit(1).alias("_side"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values])
    events = right.select(*[F.col(c) if c in key else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.col(since).alias("_t"), F.lit(0).alias("_side"), *[F.col(v).alias(f"_{v}") for v in values])
    both = tagged.unionByName(events)
    if key:
        w = Window.partitionBy(*key).orderBy("_t", "_side")
    else:
        both = ranged(both, [Key("_t"), Key("_side")], "_p")
        w = Window.partitionBy("_p").orderBy("_t", "_side")
    w = w.rowsBetween(Window.unboundedPreceding, 0)
    filled = both
    for v in values:
        filled = filled.withColumn(v, F.last(f"_{v}", ignorenulls=True).over(w))
    if not key:
        # What the ranges before knew last: one row a range.
        ends = both.groupBy("_p").agg(*[F.max_by(f"_{v}", F.when(F.col("_side") == 0, F.col("_t"))).alias(f"_e{v}") for v in values])
        upto = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select("_p", *[F.last(f"_e{v}", ignorenulls=True).over(upto).alias(f"_e{v}") for v in values])
        filled = filled.join(F.broadcast(ends), "_p")
        for v in values:
            filled = filled.withColumn(v, F.coalesce(v, f"_e{v}"))
    return filled.where("_side = 1").select(*left.columns, *values)


def stalls(df: DataFrame, key: str, at: str, limit: str, *then: str) -> DataFrame:
    """``stalled``: nothing was heard of the key for longer than ``limit`` (an interval) before this row, or ever; ``session``: its stretch
    between stalls, from 1 on. ``then`` tells rows of one time apart."""
    by = ", ".join(f"`{c}`" for c in (at, *then))
    gap = F.expr(f"`{at}` - lag(`{at}`) over (partition by `{key}` order by {by}) > interval {limit}")
    return df.withColumn("stalled", F.coalesce(gap, F.lit(True))).withColumn("session", F.sum(F.col("stalled").cast("int")).over(Window.partitionBy(key).orderBy(at, *then)).cast("int"))


def nearing(start: Column, end: Column, elapsed: Column, pace: Column) -> Column:
    """Progress of a step that reports none: it nears ``end`` without reaching it, two thirds of the way after ``pace``."""
    return start + (end - start) * (1 - F.exp(-F.greatest(elapsed, F.lit(0)) / pace))
