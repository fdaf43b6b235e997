"""Folder ingestion: files that have settled, each version once, own outputs left out, one retry.

The same rules exist twice: ``settled`` replays a log of observations with window functions (backfills, tests), and ``settled_stream``
keeps one small state a path in Structured Streaming, with a processing-time timer that a change restarts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def settled(seen: DataFrame, settle: str, path: str = "path", at: str = "seen_at", length: str = "length", mtime: str = "mtime") -> DataFrame:
    """path, length, mtime, ready_at of each version that stayed unchanged for ``settle`` (an interval); each version once.

    ``seen`` has one row an observation. A change restarts the clock; a version that comes back later is not converted again.
    """
    w = Window.partitionBy(path).orderBy(at)
    version = F.struct(length, mtime)
    changed = F.coalesce(F.lag(version).over(w) != version, F.lit(True))
    runs = seen.withColumn("_v", version).withColumn("_new", changed).where("_new").select(path, length, mtime, F.col(at).alias("_since"), F.lead(at).over(w).alias("_until_any"))
    runs = runs.withColumn("_until", F.lead("_since").over(Window.partitionBy(path).orderBy("_since")))
    ready = runs.withColumn("ready_at", F.expr(f"_since + interval {settle}")).where(F.col("_until").isNull() | (F.col("_until") >= F.col("ready_at")))
    return ready.groupBy(path, length, mtime).agg(F.min("ready_at").alias("ready_at"))


def attempts(results: DataFrame, path: str = "path", at: str = "at", ok: str = "ok", delay: str = "10 seconds") -> DataFrame:
    """path, next_at: what failed once is tried again after ``delay``; what failed twice or succeeded is not."""
    g = results.groupBy(path).agg(F.bool_or(ok).alias("_ok"), F.count("*").alias("_n"), F.max(at).alias("_last"))
    return g.where(~F.col("_ok") & (F.col("_n") == 1)).select(path, F.expr(f"_last + interval {delay}").alias("next_at"))


def files_stream(spark: SparkSession, folder: str, glob: str = "*", max_files: int | None = None, originals: str | None = None) -> DataFrame:
    """New files below a folder as a stream: path, length, mtime; ``max_files`` a batch at most.

    With ``originals``, files go there after their batch is done, below the path they had.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    s = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    if max_files:
        s = s.option("maxFilesPerTrigger", max_files)
    if originals:
        s = s.option("cleanSource", "archive").option("sourceArchiveDir", originals)
    s = s.load(folder)
    return s.select("path", "length", F.col("modificationTime").alias("mtime"))


def settled_stream(seen: DataFrame, settle_ms: int) -> DataFrame:
    """path, length, mtime of versions that have not changed for ``settle_ms``, from a stream of observations."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            length, mtime, done = state.get
            state.update((length, mtime, True))
            if not done:
                yield pd.DataFrame({"path": [key[0]], "length": [length], "mtime": [mtime]})
            return
        for f in frames:
            for length, mtime in zip(f["length"], f["mtime"], strict=True):
                if not state.exists or state.get[:2] != (int(length), int(mtime)):
                    state.update((int(length), int(mtime), False))
        if not state.get[2]:
            state.setTimeoutDuration(settle_ms)

    micros = seen.select("path", "length", F.unix_micros("mtime").alias("mtime"))
    return micros.groupBy("path").applyInPandasWithState(step, "path string, length bigint, mtime bigint", "length bigint, mtime bigint, done boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def in_batches(stream: DataFrame, work, checkpoint: str, once: bool = True):
    """Runs ``work(batch, id)`` on each micro-batch, sorted by path; the checkpoint makes restarts go on where they stopped."""
    writer = stream.writeStream.foreachBatch(lambda df, i: work(df.orderBy("path"), i)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
