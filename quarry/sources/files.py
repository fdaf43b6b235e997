"""Files in and out: a parser per format over whole files, read by Spark and parsed where they are read.

A parser takes a file's bytes and yields rows; ``read`` runs it in Arrow batches over ``binaryFile`` scans, so listing, splitting and
retries are Spark's, and paths may be in any store that Spark reads.
"""

from __future__ import annotations

import codecs
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StringType, StructField, StructType, _parse_datatype_string

Parser = Callable[[bytes], Iterator[tuple]]


#: Rows that are held at a time, and bytes of files after which they are handed on.
ROWS, READ = 4096, 4 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out to all tasks by a key: short rows that Python is to work on lie in few splits, and would be few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def parsed(df: DataFrame, content: str, parser: Parser, fields: str, keep: tuple[str, ...] = (), errors: str | None = None) -> DataFrame:
    """The rows that ``parser`` makes of a text or binary column, with the columns to ``keep``. A null has no rows.

    With ``errors``, a column of that name is null where parsing went well; a file that cannot be parsed costs the rows that it had
    before and one row with the reason there, not the job. Without it, such a file ends the job.
    """
    added = _parse_datatype_string(fields)
    schema = StructType([*(df.schema[k] for k in keep), *added.fields, *([StructField(errors, StringType())] if errors else [])])
    arrow = to_arrow_schema(schema)
    width = len(added.fields)
    source = df.select(*keep, F.col(content).alias("__content"))

    def safely(data: bytes) -> Iterator[tuple]:
        try:
            for row in parser(data):
                yield (*row, None)
        except Exception as e:  # whatever a hostile file brings a codec to raise
            yield (*(None,) * width, f"{type(e).__name__}: {e}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [f.type for f in list(arrow)[len(keep) :]]

        def batch(b: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
            fixed = [b.column(k).take(pa.array(at, pa.int64())).cast(arrow.field(k).type) for k in range(len(keep))]
            return pa.RecordBatch.from_arrays([*fixed, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], schema=arrow)

        for b in batches:
            at, out, read = [], [], 0
            for i in range(b.num_rows):  # rows of many small files together, those of large ones some thousands at a time
                data = b.column(len(keep))[i].as_py()
                if data is None:
                    continue
                data = data.encode() if isinstance(data, str) else data
                rows, read = (safely if errors else parser)(data), read + len(data)
                while some := list(itertools.islice(rows, ROWS - len(out))):
                    out += some
                    at += [i] * len(some)
                    if len(out) >= ROWS:
                        yield batch(b, at, out)
                        at, out, read = [], [], 0
                if out and read >= READ:
                    yield batch(b, at, out)
                    at, out, read = [], [], 0
            if out:
                yield batch(b, at, out)

    return source.mapInArrow(run, schema)


def made(df: DataFrame, to: str, maker: Callable[..., bytes], columns: list[str]) -> DataFrame:
    """``df`` with a column of bytes that ``maker`` makes of the values of some columns, a batch of rows at a time."""
    df = df.drop(to)
    schema = StructType([*df.schema.fields, StructField(to, BinaryType())])
    at = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [maker(*values) for values in zip(*(b.column(i).to_pylist() for i in at), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, to])

    return df.mapInArrow(run, schema)


def read(spark: SparkSession, path: str, parser: Parser, fields: str, glob: str | None = None, errors: str | None = None) -> DataFrame:
    """path and the parsed rows of all files below ``path``."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (r.option("pathGlobFilter", glob) if glob else r).load(path)
    return parsed(files, "content", parser, fields, ("path",), errors)


def read_csv(spark: SparkSession, path: str, separator: str | None = None, multi_line: bool = True) -> DataFrame:
    """CSV or TSV files with one layout as typed columns: Spark reads them in parallel, quotes doubled, line breaks inside of quotes.

    The separator is what the head of the first file has most of. Names are trimmed, blank ones named by their place, repeats numbered;
    rows without any text go. A column is boolean, bigint or double if all its filled cells are, else string; blanks are null in the
    former. Files without line breaks inside of quotes are split among tasks with ``multi_line`` off.
    """
    from ..operators.records import delimiter, not_empty
    from ..operators.sequences import header_names

    head = spark.read.text(path).limit(50).agg(F.array_join(F.collect_list("value"), "\n").alias("head"))
    separator = separator or head.select(delimiter(F.col("head")).alias("d")).first()["d"]
    r = spark.read.option("sep", separator).option("quote", '"').option("escape", '"').option("multiLine", multi_line).option("header", "false")
    r = r.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").option("nullValue", "\0").option("emptyValue", "").option("mode", "PERMISSIVE")
    first = r.csv(path).limit(1).collect()
    if not first:
        return spark.createDataFrame([], "column1 string")
    names = header_names([(c or "").removeprefix("\ufeff") for c in first[0]])
    plain = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    rows = r.option("header", "true").option("enforceSchema", "true").schema(plain).csv(path)
    rows = not_empty(rows, [f"`{n.replace('`', '``')}`" for n in names])
    return typed(rows)


def typed(rows: DataFrame) -> DataFrame:
    """String columns as boolean, bigint or double where all filled cells are; one aggregate decides over all rows."""
    cells = [F.col(f"`{n.replace('`', '``')}`") for n in rows.columns]
    number = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
    full = [c.isNotNull() & (c != "") for c in cells]
    kinds = [
        F.when(F.bool_and(F.when(f, F.lower(c).isin("true", "false"))), "boolean").when(F.bool_and(F.when(f, c.rlike(r"^-?(0|[1-9][0-9]{0,17})$"))), "bigint").when(F.bool_and(F.when(f, c.rlike(number) & (F.length(c) < 20))), "double").otherwise("string").alias(f"k{i}")
        for i, (c, f) in enumerate(zip(cells, full, strict=True))
    ]
    found = rows.agg(*kinds).first()
    return rows.select(*[(F.coalesce(c, F.lit("")) if k == "string" else F.when(f, c).cast(k)).alias(n) for n, c, f, k in zip(rows.columns, cells, full, found, strict=True)])


def decode(data: bytes, declared: str | None = None) -> str:
    """Text by BOM, then UTF-16 without one, strict UTF-8, the declared charset, a Korean code page if it looks so, else Latin-1."""
    for bom, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if data.startswith(bom):
            return data.decode(name, "replace")
    head = data[:4096]
    if len(head) >= 4 and (head[1::2].count(0) > 0.4 * len(head[1::2]) or head[::2].count(0) > 0.4 * len(head[::2])):
        return data.decode("utf-16-le" if head[1::2].count(0) >= head[::2].count(0) else "utf-16-be", "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    if declared:
        try:
            return data.decode(declared)
        except (LookupError, UnicodeDecodeError):
            pass
    return data.decode("cp949" if looks_korean(data) else "cp1252", "replace")


def looks_korean(data: bytes) -> bool:
    """Whether at least half of the two-byte pairs are Hangul syllables of the Korean code page, and few lead bytes are rare ones."""
    i = pairs = hangul = rare = 0
    while i < len(data) - 1:
        if data[i] < 0x80:
            i += 1
            continue
        pairs += 1
        hangul += 0xB0 <= data[i] <= 0xC8 and 0xA1 <= data[i + 1] <= 0xFE
        rare += data[i] > 0xFD or data[i] < 0x81
        i += 2
    return pairs > 0 and 2 * hangul >= pairs and 10 * rare <= pairs


def write_csv(df: DataFrame, path: str, separator: str = ",") -> None:
    """CSV with minimal quoting, CRLF and a header; a file a partition, under Spark's commit protocol."""
    from ..operators.records import csv_row

    header = [F.lit(c) for c in df.columns]
    body = df.select(csv_row([F.col(c) for c in df.columns], separator).alias("value"))
    first = df.sparkSession.range(1).select(csv_row(header, separator).alias("value"))
    first.coalesce(1).unionAll(body).write.option("lineSep", "\r\n").text(path)


def zip_entries(data: bytes) -> Iterator[tuple]:
    """(name, bytes, is_folder, safe) of an archive; names that leave the folder or name a drive are not safe."""
    import io
    import zipfile

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for e in z.infolist():
            name = e.filename.replace("\\", "/")
            safe = not name.startswith("/") and ":" not in name.split("/")[0] and ".." not in name.split("/")
            yield name, e.file_size, e.is_dir(), safe


ZIP = "name string, bytes bigint, is_folder boolean, safe boolean"


def mail(data: bytes) -> Iterator[tuple]:
    """(subject, sender, recipients, date, text, html, attachments) of an e-mail."""
    from email import policy
    from email.parser import BytesParser

    m = BytesParser(policy=policy.default).parsebytes(data)
    body = lambda kind: (p.get_content() if (p := m.get_body((kind,))) else None)
    yield str(m["subject"] or ""), str(m["from"] or ""), str(m["to"] or ""), str(m["date"] or ""), body("plain"), body("html"), [a.get_filename() or "" for a in m.iter_attachments()]


MAIL = "subject string, sender string, recipients string, date string, text string, html string, attachments array<string>"
