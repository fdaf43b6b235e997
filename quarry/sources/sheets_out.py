"""Sheets of text as files: a data source that writes and reads CSV and TSV folders, with a commit.

``write`` puts rows into one file a sheet, as spreadsheet programs open them: UTF-8 with a byte order mark, CRLF, quotes where needed.
Tasks write into a hidden folder that this run has below the target. Only when all have ended does the commit give the files their names,
by renames: a name that is taken is numbered, overwritten or skipped, as asked. If the job fails, the hidden folder goes, with what tasks
that were tried twice have left; a task that is still running then finds no folder to write to. A file that was there before stays as it
was until the rename.

Reading makes a partition of each file, or of byte ranges where no line breaks stand inside of quotes. Every file's header is compared
with the first one's; a file of another layout ends the job with its name. Folders may be anywhere pyarrow's file systems reach.
"""

from __future__ import annotations

import csv
import io
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.sequences import first_free, header_names

FORMAT = "quarry_sheets"
BOM = b"\xef\xbb\xbf"
#: The folder of the files of a run that are not yet committed.
HIDDEN = ".quarry-{run}"
CONFLICTS = ("number", "overwrite", "skip")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path in it. Such paths are not encoded, whatever characters they have."""
    if local := re.fullmatch(r"(?:file:(?://[^/]*)?)?(/.*|(?![a-zA-Z][a-zA-Z0-9+.-]+:).*)", path, re.DOTALL):
        return fs.LocalFileSystem(), local[1]
    return fs.FileSystem.from_uri(quote(path, safe=":/@+-._~%"))


def safe_name(name: str) -> str:
    """A sheet's name as part of a file's."""
    return re.sub(r'[\x00-\x1f<>:"/\\|?*]', "_", name).strip(". ") or "Sheet"


def quoted(column: pa.Array, separator: str) -> pa.Array:
    """Cells as CSV has them; null cells are empty."""
    text = pc.fill_null(column.cast(pa.large_string()), "")
    needs = pc.match_substring_regex(text, f'[{re.escape(separator)}"\r\n]|^ | $')
    quote, nothing = pa.scalar('"', pa.large_string()), pa.scalar("", pa.large_string())
    return pc.if_else(needs, pc.binary_join_element_wise(quote, pc.replace_substring(text, '"', '""'), quote, nothing), text)


def lines(batch: pa.RecordBatch, separator: str) -> bytes:
    rows = pc.binary_join_element_wise(*[quoted(c, separator) for c in batch.columns], pa.scalar(separator, pa.large_string()))
    return "".join(f"{x}\r\n" for x in rows.to_pylist()).encode()


@dataclass
class Part:
    """A hidden file: the rows of one sheet that one task has met in a row."""

    sheet: str | None
    partition: int
    number: int
    path: str
    rows: int


@dataclass
class Written(WriterCommitMessage):
    parts: list[Part]


class SheetWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        self.folder, self.name = options["path"].rstrip("/"), options.get("name", "table")
        self.separator = {"csv": ",", "tsv": "\t"}[options.get("kind", "csv")]
        self.kind, self.sheet, self.conflict = options.get("kind", "csv"), options.get("sheet"), "overwrite" if overwrite else options.get("conflict", "number")
        if self.conflict not in CONFLICTS:
            raise ValueError(f"no way to meet a name that is taken: {self.conflict}")
        self.columns = [f.name for f in schema.fields if f.name != self.sheet]
        self.header = lines(pa.RecordBatch.from_arrays([pa.array([c]) for c in self.columns], self.columns), self.separator)
        self.run = uuid.uuid4().hex
        system, folder = opened(self.folder)
        system.create_dir(f"{folder}/{HIDDEN.format(run=self.run)}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        partition, attempt = context.partitionId(), context.taskAttemptId()
        system, folder = opened(self.folder)
        parts: list[Part] = []
        out, last = None, object()
        try:
            for batch in iterator:
                names = batch.column(self.sheet).cast(pa.string()).to_pylist() if self.sheet else [None] * batch.num_rows
                rows, start = batch.select(self.columns), 0
                for i in range(1, len(names) + 1):
                    if i < len(names) and names[i] == names[start]:
                        continue
                    if names[start] != last or out is None:
                        if out is not None:
                            out.close()
                        last = names[start]
                        path = f"{folder}/{HIDDEN.format(run=self.run)}/{attempt}-{len(parts)}"
                        parts.append(Part(last, partition, len(parts), path, 0))
                        out = system.open_output_stream(path)
                        out.write(BOM + self.header)
                    out.write(lines(rows.slice(start, i - start), self.separator))
                    parts[-1].rows += i - start
                    start = i
        finally:
            if out is not None:
                out.close()
        return Written(parts)

    def names(self, parts: list[Part], there: set[str]) -> Iterator[tuple[Part, str | None]]:
        """Each part with its file's name, or None to skip it. Parts of one sheet follow one another; names differ beyond case."""
        several = len({p.sheet for p in parts}) > 1
        before, given = {x.lower() for x in there}, set()
        taken, counters = set(before), {}
        for p in sorted(parts, key=lambda p: (p.sheet is not None, p.sheet or "", p.partition, p.number)):
            base = self.name + (f"_{safe_name(p.sheet or '')}" if several else "")
            wanted = f"{base}.{self.kind}"
            if self.conflict != "number" and wanted.lower() not in given:
                given.add(wanted.lower())
                taken.add(wanted.lower())
                yield p, None if self.conflict == "skip" and wanted.lower() in before else wanted
            else:
                # A number stands before the extension, so names are told apart without it.
                yield p, first_free(taken, counters, base, base.lower(), "{} ({})", f".{self.kind}")

    def commit(self, messages: Sequence[Written | None]) -> None:
        system, folder = opened(self.folder)
        there = {x.base_name for x in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if not x.base_name.startswith(".")}
        for part, name in self.names([p for m in messages if m for p in m.parts], there):
            if name is not None:
                system.move(part.path, f"{folder}/{name}")
        self._clear(system, folder)

    def abort(self, messages: Sequence[Written | None]) -> None:
        self._clear(*opened(self.folder))

    def _clear(self, system: fs.FileSystem, folder: str) -> None:
        system.delete_dir(f"{folder}/{HIDDEN.format(run=self.run)}")


@dataclass
class Range(InputPartition):
    """Bytes of a file: lines that begin in it."""

    path: str
    start: int
    end: int


class SheetReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.folder, self.schema = options["path"].rstrip("/"), schema
        self.separator = {"csv": ",", "tsv": "\t"}[options.get("kind", "csv")]
        self.kind, self.split_bytes = options.get("kind", "csv"), int(options.get("splitbytes", 0))
        self.file_column = options.get("filecolumn")

    def files(self) -> list[fs.FileInfo]:
        system, folder = opened(self.folder)
        found = system.get_file_info(fs.FileSelector(folder))
        return sorted((x for x in found if x.is_file and x.base_name[0] not in "._" and x.extension.lower() == self.kind), key=lambda x: x.path)

    def partitions(self) -> list[Range]:
        out = []
        for f in self.files():
            step = self.split_bytes or max(1, f.size)
            out += [Range(f.path, at, min(f.size, at + step)) for at in range(0, max(1, f.size), step)]
        return out or [Range("", 0, 0)]

    def header(self, system: fs.FileSystem, path: str) -> list[str]:
        with system.open_input_stream(path) as raw:
            row = next(csv.reader(io.TextIOWrapper(raw, "utf-8-sig", newline=""), delimiter=self.separator), [])
        return header_names(row)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = opened(self.folder)
        own = [f.name for f in self.schema.fields if f.name != self.file_column]
        names = self.header(system, partition.path)
        if names != own and names:
            raise ValueError(f"{partition.path} has the columns {names}, the first file {own}")
        base = partition.path.rpartition("/")[2]
        with system.open_input_file(partition.path) as f:
            text = self._lines(f, partition) if self.split_bytes else io.TextIOWrapper(f, "utf-8-sig", newline="")
            rows = csv.reader(text, delimiter=self.separator)
            if partition.start == 0:
                next(rows, None)
            held = []
            for row in rows:
                held.append(row[: len(own)] + [None] * (len(own) - len(row)))
                if len(held) == 4096:
                    yield self._batch(held, base)
                    held = []
            if held:
                yield self._batch(held, base)

    def _batch(self, rows: list[list], base: str) -> pa.RecordBatch:
        columns = iter(zip(*rows, strict=True))
        arrays = [pa.array([base] * len(rows), pa.string()) if f.name == self.file_column else pa.array(next(columns), pa.string()) for f in self.schema.fields]
        return pa.RecordBatch.from_arrays(arrays, [f.name for f in self.schema.fields])

    @staticmethod
    def _lines(f: pa.NativeFile, part: Range) -> Iterator[str]:
        """The lines that begin in a range: a line belongs to where its first byte is."""
        if part.start:
            f.seek(part.start - 1)
            reader = io.BufferedReader(f, 1 << 20)
            at = part.start - 1 + len(reader.readline())
        else:
            reader, at = io.BufferedReader(f, 1 << 20), 0
        while at < part.end and (line := reader.readline()):
            yield (line.removeprefix(BOM) if at == 0 else line).decode("utf-8")
            at += len(line)


class Sheets(DataSource):
    """``quarry_sheets``. Options: path; kind (csv, tsv). Writing: name, sheet (a column), conflict (number, overwrite, skip).
    Reading: splitbytes (no line breaks inside of quotes then), filecolumn."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        reader = SheetReader(dict(self.options), StructType())
        files = reader.files()
        names = reader.header(opened(reader.folder)[0], files[0].path) if files else ["column1"]
        return StructType([StructField(n, StringType()) for n in [*names, *([reader.file_column] if reader.file_column else [])]])

    def reader(self, schema: StructType) -> SheetReader:
        return SheetReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> SheetWriter:
        return SheetWriter(dict(self.options), schema, overwrite)


def write(df: DataFrame, folder: str, name: str = "table", sheet: str | None = None, kind: str = "csv", conflict: str = "number", in_parts: bool = False) -> None:
    """One file a sheet, its rows in one task; with ``in_parts`` a sheet's rows stay where they are, and files after the first are numbered."""
    df.sparkSession.dataSource.register(Sheets)
    rows = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    if sheet:
        rows = (rows if in_parts else rows.repartition(F.col(f"`{sheet}`"))).sortWithinPartitions(F.col(f"`{sheet}`"))
    elif not in_parts:
        rows = rows.coalesce(1)
    w = rows.write.format(FORMAT).mode("append").option("name", name).option("kind", kind).option("conflict", conflict)
    (w.option("sheet", sheet) if sheet else w).save(folder)


def read(spark: SparkSession, folder: str, kind: str = "csv", split_bytes: int = 0, file_column: str | None = None) -> DataFrame:
    """All files of one kind and layout in a folder, as text."""
    spark.dataSource.register(Sheets)
    r = spark.read.format(FORMAT).option("kind", kind).option("splitbytes", split_bytes)
    return (r.option("filecolumn", file_column) if file_column else r).load(folder)
