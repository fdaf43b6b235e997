"""Where results go: folders, names from patterns, and what happens when a name is taken.

A pattern is read once on the driver and becomes one expression, so a source whose own name looks like a pattern is not expanded twice.
Names that are free for everybody are found by ``sequences.free_names``; the other policies are joins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as n
from .sequences import free_names

TOKEN = re.compile(r"\{(name|ext|preset|date|time|index)\}", re.IGNORECASE)


@dataclass(frozen=True)
class Rule:
    """``location``: "source" (beside it), "subfolder" (``folder`` below it) or "custom" (``folder``, with the folders below ``keep_from``).

    ``conflict``: "number", "overwrite" or "skip". A source is never written over: such a result is numbered whatever the policy is.
    """

    pattern: str = "{name}"
    location: str = "source"
    folder: str = "converted"
    keep_from: str | None = None
    conflict: str = "number"
    preset: str = ""
    renames: tuple[tuple[str, str, str], ...] = ()


def expanded(pattern: str, values: dict[str, Column]) -> Column:
    """A pattern with its tokens replaced, in one pass; an empty pattern is the name."""
    out, last = [], 0
    pattern = pattern if pattern.strip() else "{name}"
    for m in TOKEN.finditer(pattern):
        out += [F.lit(pattern[last : m.start()]), F.coalesce(values[m[1].lower()].cast("string"), F.lit(""))]
        last = m.end()
    return F.concat(*out, F.lit(pattern[last:]))


def sanitized(name: Column, fallback: Column) -> Column:
    """A name that every system takes: signs of paths become underscores, blanks at the ends and points at the end go."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(name, r'[\x00-\x1f\x7f<>:"/\\|?*]', "_")), r"\.+$", "")
    return F.when(clean == "", fallback).otherwise(clean)


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def below(folder: Column, root: str) -> Column:
    """The part of a folder below a root; empty for the root itself and for folders outside."""
    root = root.rstrip("/")
    return F.when(folder.startswith(root + "/"), F.substring(folder, len(root) + 2, 1 << 30)).otherwise("")


def allocated(files: DataFrame, existing: DataFrame, rule: Rule, path: str, target: str, order: str, at: str | None = None) -> DataFrame:
    """``files`` with ``output``: the path to write for each ``path``, with the extension in ``target``; null where it is to be skipped.

    ``existing`` has a column ``path`` of what is there; what an earlier row of ``order`` was given counts as well. Names that differ in
    case only are the same. ``at`` is a column with the time for {date} and {time}. A null path has no output.
    """
    source = F.col(path)
    name, ext = F.regexp_extract(source, r"([^/]*)$", 1), n.extension(source)
    stem = F.when(F.length(ext) > 0, F.expr("left(_name, length(_name) - length(_ext) - 1)")).otherwise(F.col("_name"))
    rows = files.withColumns({"_name": name, "_ext": F.coalesce(ext, F.lit(""))}).withColumn("_stem", stem)
    time = F.col(at) if at else F.current_timestamp()
    values = {"name": F.col("_stem"), "ext": F.col("_ext"), "preset": F.lit(rule.preset), "date": F.date_format(time, "yyyyMMdd"), "time": F.date_format(time, "HHmmss"), "index": F.col(order)}
    beside = folder_of(source)
    folder = {
        "source": lambda: beside,
        "subfolder": lambda: F.concat_ws("/", F.when(beside != "", beside), sanitized(expanded(rule.folder, values), F.lit("converted"))),
        "custom": lambda: F.concat_ws("/", F.lit(rule.folder.rstrip("/")), F.when(below(beside, rule.keep_from) != "", below(beside, rule.keep_from)) if rule.keep_from else F.lit(None).cast("string")),
    }[rule.location]()
    base = sanitized(n.rename(expanded(rule.pattern, values), [*rule.renames]), F.col("_stem"))
    whole = F.concat_ws("/", F.when(folder != "", folder), base)
    # Names are told apart with their extension, and numbered before it.
    rows = rows.withColumn("_want", F.when(source.isNotNull(), F.concat(F.lower(F.col(target)), F.lit("\n"), whole)))
    cut = F.regexp_extract("path", r"\.([^./]*)$", 1)
    taken = existing.where("path is not null").select(F.concat(F.lower(cut), F.lit("\n"), F.when(cut == "", F.col("path")).otherwise(F.expr("left(path, length(path) - length(regexp_extract(path, '[.]([^./]*)$', 1)) - 1)"))).alias("_want"))
    own = F.lower("_want") == F.lower(F.concat(F.lower("_ext"), F.lit("\n"), F.concat_ws("/", F.when(beside != "", beside), F.col("_stem"))))
    sources = rows.where(source.isNotNull()).select(F.concat(F.lower("_ext"), F.lit("\n"), F.concat_ws("/", F.when(beside != "", beside), F.col("_stem"))).alias("_want"))
    rows = rows.withColumn("_own", F.coalesce(own, F.lit(False)))
    if rule.conflict == "number":
        out = free_names(rows, taken.unionAll(sources.join(rows.where("_own").select(F.lower("_want").alias("_o")), F.lower("_want") == F.col("_o"), "left_semi")), "_want", order)
    else:
        others = rows.where("not _own")
        numbered = free_names(rows.where("_own"), taken.unionAll(sources).unionAll(others.where("_want is not null").select("_want")), "_want", order)
        if rule.conflict == "overwrite":
            out = numbered.unionByName(others.withColumn("free", F.col("_want")))
        else:
            there = taken.select(F.lower("_want").alias("_t")).distinct().withColumn("_there", F.lit(True))
            first = F.row_number().over(Window.partitionBy(F.lower("_want")).orderBy(order)) == 1
            given = others.withColumn("_first", first).join(there, F.lower("_want") == F.col("_t"), "left")
            out = numbered.unionByName(given.withColumn("free", F.when(F.col("_first") & F.col("_there").isNull(), F.col("_want"))).drop("_first", "_t", "_there"))
    end = F.when(F.col(target) == "", F.lit("")).otherwise(F.concat(F.lit("."), F.col(target)))
    return out.withColumn("output", F.concat(F.substring_index("free", "\n", -1), end)).select(*[F.col(f"`{c}`") for c in files.columns], "output")
