"""Many inputs into one file, in order and in parallel.

Each part's place in the result is the sum of the sizes before it, so tasks write their parts where they belong, in any order, and a task
that is tried again writes the same bytes to the same place. Large files are cut into blocks, so one of them is not one task's work. The
result has a hidden name until every byte of it was written; only then it gets its own, by one rename. It stands on a file system that
the driver and all executors mount, as parts of a file can't be written apart elsewhere; what is read may be anywhere.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .ordering import Key, running

#: Bytes of a file that are read at a time.
BLOCK = 8 << 20


def mounted(path: str) -> str:
    """The path of a file on a mounted file system, from a path as Spark writes it."""
    local = re.fullmatch(r"(?:file:(?://[^/]*)?)?(/.*|(?![a-zA-Z][a-zA-Z0-9+.-]+:).*)", path, re.DOTALL)
    if not local:
        raise ValueError(f"{path} is on no file system that is mounted")
    return local[1]


def placed(parts: DataFrame, order: list[Key], size: Column, between: int = 0) -> DataFrame:
    """``parts`` with ``start``, the place of each in the result; ``between`` bytes stand after each but the last."""
    return running(parts, order, F.coalesce(size.cast("long"), F.lit(0)) + between, "start")


class _Whole:
    """A file that gets its name when all of it is there."""

    def __init__(self, target: str, size: int) -> None:
        self.target = mounted(target)
        folder, name = os.path.split(self.target)
        os.makedirs(folder or ".", exist_ok=True)
        self.hidden, self.size = os.path.join(folder, f".{name}.{uuid.uuid4().hex}"), size
        with open(self.hidden, "wb") as f:
            f.truncate(size)

    def commit(self, written: int) -> None:
        if written != self.size:
            self.abort()
            raise OSError(f"{written} of {self.size} bytes were written to {self.target}")
        os.replace(self.hidden, self.target)

    def abort(self) -> None:
        if os.path.exists(self.hidden):
            os.remove(self.hidden)


def _written(rows: DataFrame, run, whole: _Whole) -> None:
    try:
        done = rows.mapInArrow(run, "bytes bigint").agg(F.sum("bytes").alias("n")).first()["n"] or 0
    except BaseException:
        whole.abort()
        raise
    whole.commit(done)


def merge_rows(rows: DataFrame, order: list[Key], content: str, target: str, between: bytes = b"") -> DataFrame:
    """Writes a text or binary column of all rows, one after the other, into one file; gives the rows without it, with start and size.

    Null contents are empty parts. An empty table makes an empty file.
    """
    bare = F.coalesce(F.col(f"`{content}`").cast("binary"), F.lit(b""))
    sized = placed(rows.withColumn("size", F.octet_length(bare).cast("long")), order, F.col("size"), len(between))
    ends = sized.agg(F.max(F.col("start") + F.col("size")).alias("n")).first()["n"] or 0
    whole = _Whole(target, ends)
    hidden, total = whole.hidden, ends

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(hidden, "r+b") as f:
            for b in batches:
                n = 0
                for at, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    part = data.as_py() + between
                    part = part[: max(0, total - at)]
                    f.seek(at)
                    f.write(part)
                    n += len(part)
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["bytes"])

    _written(sized.select("start", bare.alias("content")), run, whole)
    return sized.drop(content)


def merge_files(files: DataFrame, order: list[Key], target: str, path: str = "path", size: str = "length", between: bytes = b"") -> DataFrame:
    """Writes whole files (``path``, ``size`` as listed) one after the other into one; gives ``files`` with start.

    Files are read where Spark's listing found them, by pyarrow's file systems. A file that has changed its size since ends the job.
    """
    listed = placed(files, order, F.col(size), len(between))
    ends = listed.agg(F.max(F.col("start") + F.coalesce(F.col(size), F.lit(0))).alias("n")).first()["n"] or 0
    whole = _Whole(target, ends)
    hidden, total = whole.hidden, ends
    blocks = listed.select("start", F.col(path).alias("path"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"))
    blocks = blocks.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(BLOCK).cast("long")))).repartition("path", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..sources.sheets_out import opened

        with open(hidden, "r+b") as f:
            for b in batches:
                n = 0
                for start, name, length, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    system, inside = opened(name)
                    with system.open_input_file(inside) as g:
                        if g.size() != length:
                            raise OSError(f"{name} has {g.size()} bytes, not {length}")
                        g.seek(at)
                        part = g.read(min(BLOCK, length - at))
                    if at + len(part) == length:
                        part += between
                    part = part[: max(0, total - start - at)]
                    f.seek(start + at)
                    f.write(part)
                    n += len(part)
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["bytes"])

    _written(blocks, run, whole)
    return listed


def read_back(parts: DataFrame, target: str, start: str = "start", size: str = "size", to: str = "content") -> DataFrame:
    """``parts`` with the bytes that stand at their place."""
    path = mounted(target)
    fields = [*parts.schema.fields]
    at, long = parts.columns.index(start), parts.columns.index(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as f:
            for b in batches:
                out = []
                for s, n in zip(b.column(at).to_pylist(), b.column(long).to_pylist(), strict=True):
                    f.seek(s)
                    out.append(f.read(n))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, to])

    return parts.mapInArrow(run, StructType([*fields, StructField(to, BinaryType())]))
