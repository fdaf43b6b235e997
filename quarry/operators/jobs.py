"""Roll-ups of jobs, files and history; assemblies with an all-or-nothing rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def job_states(files: DataFrame, job: str, state: str) -> DataFrame:
    """state of each job: cancelled if any file is; completed if all are done or skipped; partly if some are; else failed."""
    is_ = lambda *names: F.col(state).isin(*names)
    out = F.when(F.bool_or(is_("cancelled")), "cancelled").when(F.bool_and(is_("done", "skipped")), "completed").when(F.bool_or(is_("done")), "completed_with_errors").otherwise("failed")
    return files.groupBy(job).agg(out.alias("state"))


def job_progress(jobs: DataFrame, files: DataFrame, job: str, progress: str) -> DataFrame:
    """Mean progress of each job's files; a job without files is at 1."""
    return jobs.select(job).join(files.groupBy(job).agg(F.avg(progress).alias("progress")), job, "left").select(job, F.coalesce("progress", F.lit(1.0)).alias("progress"))


def transfers(files: DataFrame, job: str, active: Column, done: str, total: str) -> DataFrame:
    """Bytes done and in all of the files under way; the total is known only if every one of them is."""
    a = files.where(active)
    return a.groupBy(job).agg(F.count("*").alias("files"), F.sum(done).alias("bytes"), F.when(F.count(total) == F.count("*"), F.sum(total)).alias("total"))


def latest(history: DataFrame, key: str | list[str], order: str, values: list[str]) -> DataFrame:
    """Each key's newest row; an aggregate with partial sums, not a window over all versions."""
    keys = [key] if isinstance(key, str) else key
    return history.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_v")).select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def extrapolated(files: DataFrame, kind: str, size: str, estimate: str) -> DataFrame:
    """estimate of each kind: what is known plus the rest at the known files' ratio; null if nothing is known."""
    known = F.col(estimate).isNotNull()
    g = files.groupBy(kind).agg(F.sum(F.when(known, F.col(size))).alias("_k"), F.sum(estimate).alias("_e"), F.coalesce(F.sum(F.when(~known, F.col(size))), F.lit(0)).alias("_r"))
    return g.select(kind, F.when(F.col("_k") > 0, F.col("_e") + F.round(F.col("_r") * (F.col("_e") / F.col("_k")))).cast("bigint").alias("estimate"))


def majority(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; ties go to the one seen first."""
    c = df.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return c.groupBy(*by).agg(F.max_by(value, F.struct("n", (-F.col("_first")).alias("f"))).alias(value), F.max("n").alias("n"))


def assembled(lists: DataFrame, key: str, refs: str, items: DataFrame, item: str, value: str) -> DataFrame:
    """``values`` of each key in the order of its references; keys with a missing reference are marked not ``complete``."""
    parts = lists.select(key, F.posexplode(refs).alias("_at", "_ref"))
    joined = parts.join(items.select(F.col(item).alias("_ref"), F.col(value).alias("_v")), "_ref", "left")
    g = joined.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", "_v"))).alias("_l"), F.bool_and(F.col("_v").isNotNull()).alias("complete"))
    return g.select(key, F.when(F.col("complete"), F.transform("_l", lambda x: x["_v"])).alias("values"), "complete")


def not_generated(files: DataFrame, outputs: DataFrame) -> DataFrame:
    """Files that are no output of ours: path, length and time are not all the same."""
    return files.join(outputs.select("path", "length", "mtime"), ["path", "length", "mtime"], "left_anti")


def without_companions(files: DataFrame, path: str, main: str, companions: list[str]) -> DataFrame:
    """Files without the sidecars of a main file of the same folder and stem that is in the list too."""
    p = F.lower(F.col(path))
    stem, ext = F.regexp_replace(p, r"\.[^./]*$", ""), F.regexp_extract(p, r"\.([^./]*)$", 1)
    mains = files.where(ext == main).select(stem.alias("_stem")).distinct().withColumn("_main", F.lit(True))
    out = files.withColumn("_stem", stem).withColumn("_ext", ext).join(mains, "_stem", "left")
    return out.where(F.col("_main").isNull() | ~F.col("_ext").isin(*companions)).drop("_stem", "_ext", "_main")


def stitched(tables: DataFrame, doc: str, page: str, place: str, widths: str) -> DataFrame:
    """``table``: tables that go on at the top of the next page with columns as wide (5 % and 100 units) as the one before."""
    order = Window.partitionBy(doc).orderBy(page, place)
    on_page = Window.partitionBy(doc, page)
    t = tables.withColumn("_first", F.col(place) == F.min(place).over(on_page)).withColumn("_last", F.col(place) == F.max(place).over(on_page))
    t = t.withColumn("_b", F.lag(F.struct(page, "_last", widths)).over(order))
    close = F.forall(F.zip_with(F.col(widths), F.col(f"_b.{widths}"), lambda a, b: F.coalesce(F.abs(a - b) <= 0.05 * F.greatest(a, b) + 100, F.lit(False))), lambda x: x)
    on = (F.col(f"_b.{page}") == F.col(page) - 1) & F.col("_b._last") & F.col("_first") & close
    return t.withColumn("table", F.sum(F.when(F.coalesce(on, F.lit(False)), 0).otherwise(1)).over(order).cast("int")).drop("_first", "_last", "_b")


def smaller_only(files: DataFrame, source: str, result: str) -> DataFrame:
    """``kept``: a result that is not smaller than its source gives way to the source."""
    keep_source = F.coalesce(F.col(result) >= F.col(source), F.lit(True))
    return files.withColumn("kept", F.when(keep_source, "source").otherwise("result")).withColumn("size", F.when(keep_source, F.col(source)).otherwise(F.col(result)))


def history(files: DataFrame, job: str, state: str, name: str, limit: int = 500) -> DataFrame:
    """Per job: how many files, the failed ones in order, and the outputs that may be undone (at most ``limit``)."""
    failed = F.array_sort(F.collect_list(F.when(F.col(state) == "failed", F.col(name))))
    done = F.slice(F.array_sort(F.collect_list(F.when(F.col(state) == "done", F.col(name)))), 1, limit)
    return files.groupBy(job).agg(F.count("*").alias("files"), failed.alias("failures"), done.alias("outputs"))


def undoable(outputs: DataFrame, now: DataFrame) -> DataFrame:
    """Outputs that are still as they were written: path, length and time agree."""
    return outputs.join(now.select("path", "length", "mtime"), ["path", "length", "mtime"], "left_semi")


#: File extensions by media type.
MEDIA_TYPES = {"application/json": "json", "application/pdf": "pdf", "application/xml": "xml", "application/zip": "zip", "image/jpeg": "jpg", "image/png": "png", "image/svg+xml": "svg", "image/webp": "webp", "text/calendar": "ics", "text/csv": "csv", "text/html": "html", "text/markdown": "md", "text/plain": "txt", "text/vcard": "vcf"}


def media_extension(media_type: Column) -> Column:
    """The extension of a media type; parameters and case do not matter."""
    bare = F.lower(F.trim(F.regexp_extract(media_type, "^([^;]*)", 1)))
    return F.element_at(F.create_map(*[F.lit(v) for kv in MEDIA_TYPES.items() for v in kv]), bare)


def first_attribute(properties: Column, names: list[str]) -> Column:
    """The value of the first of several names that a map has, whatever their case."""
    lowered = F.transform_keys(properties, lambda k, v: F.lower(k))
    return F.coalesce(*[F.element_at(lowered, n.lower()) for n in names])


def watch_totals(history: DataFrame, rule: str, source: str, order: str, failed: str) -> DataFrame:
    """converted and failed sources of each rule: for every source its newest entry decides."""
    newest = latest(history, [rule, source], order, [failed])
    return newest.groupBy(rule).agg(F.count_if(~F.coalesce(F.col(failed), F.lit(False))).alias("converted"), F.count_if(F.coalesce(F.col(failed), F.lit(False))).alias("failed"))


def without_repeated_headers(rows: DataFrame, doc: str, part: str, table: str, row: str, cells: str) -> DataFrame:
    """Rows of stitched tables without the first row of a part that says again what the table's first row says.

    ``part`` numbers the pieces of a document in order, ``table`` the tables they were stitched to, ``row`` the rows of a piece from 0 on.
    """
    first = rows.where(F.col(row) == 0).groupBy(doc, table).agg(F.min_by(F.struct(part, cells), part).alias("_h"))
    first = first.select(F.col(doc).alias("_d"), F.col(table).alias("_t"), F.col(f"_h.{part}").alias("_p"), F.col(f"_h.{cells}").alias("_c"))
    joined = rows.join(first, F.col(doc).eqNullSafe(F.col("_d")) & F.col(table).eqNullSafe(F.col("_t")), "left")
    again = (F.col(row) == 0) & (F.col(part) != F.col("_p")) & F.col(cells).eqNullSafe(F.col("_c"))
    return joined.where(~F.coalesce(again, F.lit(False))).select(*[F.col(f"`{c}`") for c in rows.columns])


def all_or_nothing(wholes: DataFrame, parts: DataFrame, whole: str, part_of: str, fine: Column, value: str) -> DataFrame:
    """members, complete and total of each whole: a whole without parts, or with one that is not ``fine``, has no total."""
    own = parts.select(F.col(part_of).alias("_of"), F.coalesce(fine, F.lit(False)).alias("_fine"), F.col(value).alias("_value"))
    g = own.groupBy("_of").agg(F.count("*").alias("members"), F.bool_and("_fine").alias("_all"), F.sum("_value").alias("_sum"))
    out = wholes.select(whole).join(g, F.col(whole) == F.col("_of"), "left")
    complete = F.coalesce("_all", F.lit(False))
    return out.select(whole, F.coalesce("members", F.lit(0)).cast("long").alias("members"), complete.alias("complete"), F.when(complete, F.col("_sum")).alias("total"))
