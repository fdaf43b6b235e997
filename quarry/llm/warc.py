"""WARC archives: written with an index, read back by coalesced byte ranges.

Equal payloads are found first, by (SHA-1, length); only digests are shuffled for that, with sums made before. The pages then go to
their writers by page_id. Each task writes archives of its own, one gzip member a record, and returns an index row a record: file,
offset, length, URL, digest, type. The index is kept as a table in the shared folder. A reader selects index rows, deals them out by
file and offset, and reads each run of neighbouring records in one request. Archive names carry the task attempt, so a repeated
attempt never writes into the archive of another; an archive that no index row names is garbage of a lost attempt.

Defined cases: a null html is an empty payload; a null url is written as the empty URL; payloads smaller than ``min_payload`` are all
responses; of rows with equal page_id and payload the first written is the response; a null page_id comes after all others and is
referred to by nothing; an empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_path, settle, small, trimmed

INDEX = "page_id long, file string, offset long, length long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long"
_ARROW = pa.schema([("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64())])
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
_ARROW_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
_ID = "urn:page:"


@dataclass(frozen=True)
class Archive:
    min_payload: int = 0
    #: Uncompressed bytes after which a task begins its next archive.
    roll_bytes: int = 512 << 20
    #: Neighbouring records are read in one request of at most this many bytes, over gaps of at most ``gap_bytes``.
    request_bytes: int = 8 << 20
    gap_bytes: int = 64 << 10
    #: Bytes of archives that a task reads.
    task_bytes: int = 16 << 20


def _digest(html: Column) -> Column:
    return F.sha1(F.encode(html, "UTF-8"))


def decisions(pages: DataFrame, archive: Archive) -> DataFrame:
    """page_id, sha, first: of each distinct page_id and payload, the page whose response it refers to."""
    own = pages.select("page_id", _digest(F.col("html")).alias("sha"), F.octet_length("html").alias("n")).groupBy("page_id", "sha", "n").agg(F.lit(1).alias("one")).drop("one")
    own = own.withColumn("alone", F.col("n") < archive.min_payload)
    # Only payloads that several pages have are joined, few enough to be broadcast unless they are counted to be more.
    same = own.where(~F.col("alone")).groupBy(F.col("sha").alias("f_sha"), F.col("n").alias("f_n")).agg(F.min("page_id").alias("least"), F.count("*").alias("pages")).where("pages > 1")
    same = small(settle(same.select("f_sha", "f_n", "least")))
    out = own.join(same, (F.col("sha") == F.col("f_sha")) & (F.col("n") == F.col("f_n")), "left")
    first = F.when(~F.col("alone"), F.coalesce("least", "page_id"))
    return out.select(F.col("page_id").alias("d_page"), F.col("sha").alias("d_sha"), first.alias("first"), "alone")


def _head(kind: str, page: int | None, url: str, digest: str, refers: int | None, body: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{'' if page is None else page}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {quote(url, safe=_SAFE)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", *([f"WARC-Refers-To: <{_ID}{refers}>"] if refers is not None else [])]
    return "\r\n".join([*lines, f"Content-Length: {body}", "", ""]).encode()


#: ASCII that a URL header keeps as it is.
_SAFE = "!#$&'()*+,/:;=?@[]~"


def record(page: int | None, url: str, payload: bytes, refers: int | None, revisit: bool) -> tuple[bytes, str]:
    """One gzip member, and the payload's digest."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress(_head("revisit" if revisit else "response", page, url, digest, refers, len(body)) + body + b"\r\n\r\n") + pack.flush(), digest


def parse(member: bytes) -> dict:
    """What a record says of itself."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    named = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(named["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    http, _, payload = body.partition(b"\r\n\r\n")
    number = lambda x: int(t) if (t := x[len(_ID) + 1 : -1]) else None
    kind = named["WARC-Type"]
    told = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != told or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("a payload is not what its record says")
    return {"page_id": number(named["WARC-Record-ID"]), "payload_bytes": told, "payload_digest": digest, "record_type": kind, "refers_to": number(named["WARC-Refers-To"]) if "WARC-Refers-To" in named else None, "url": unquote(named["WARC-Target-URI"]), "payload": payload if kind == "response" else None}


def write_warc(pages: DataFrame, archive: Archive = Archive(), to: str | None = None) -> DataFrame:
    """Archives below ``to`` (or a new folder in the shared one); returns their index."""
    pages = bounded_batches(pages)
    folder = to or fresh_path(pages.sparkSession, "warc")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    told = decisions(own, archive)
    # Rows of one page_id meet in one task in order, so that the first of equal ones can be told.
    joined = own.withColumn("sha", _digest(F.col("html"))).join(told, F.col("page_id").eqNullSafe(F.col("d_page")) & (F.col("sha") == F.col("d_sha")))
    joined = joined.sortWithinPartitions("page_id", "sha").select("page_id", "url", "html", "sha", "first", "alone")

    @trimmed
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        out, name, at, raw, before = None, "", 0, 0, None
        try:
            for b in batches:
                rows = []
                for page, url, html, sha, first, alone in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if out is None or raw > archive.roll_bytes:
                        if out is not None:
                            out.close()
                        else:
                            fs.create_dir(base, recursive=True)
                        name, at, raw = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    revisit = not alone and ((page, sha) == before or page != first)
                    payload = html.encode("utf-8", "surrogatepass")
                    data, digest = record(page, url, payload, first if revisit else None, revisit)
                    out.write(data)
                    rows.append((page, name, at, len(data), url, digest, len(payload), "revisit" if revisit else "response", first if revisit else None))
                    at, raw, before = at + len(data), raw + len(payload), (page, sha)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)
        finally:
            if out is not None:
                out.close()

    index = settle(joined.mapInArrow(write, INDEX))
    return index.withColumn("file", F.concat(F.lit(f"{folder}/"), "file"))


#: Records that are parsed at a time.
PARSED = 128


def read_warc(index: DataFrame, archive: Archive = Archive()) -> DataFrame:
    """The records that ``index`` names, parsed and verified, with their payloads."""

    @trimmed
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stream = None, None
        for b in batches:
            run = []
            for file, offset, length in [*zip(*(c.to_pylist() for c in b.columns), strict=True), (None, 0, 0)]:
                if run and (file != run[0][0] or offset - run[-1][1] - run[-1][2] > archive.gap_bytes or offset + length - run[0][1] > archive.request_bytes):
                    if at != run[0][0]:
                        if stream is not None:
                            stream.close()
                        at = run[0][0]
                        fs, path = pa.fs.FileSystem.from_uri(at if "://" in at else f"file://{at}")
                        stream = fs.open_input_file(path)
                    start = run[0][1]
                    data = stream.read_at(run[-1][1] + run[-1][2] - start, start)
                    for k in range(0, len(run), PARSED):
                        yield pa.RecordBatch.from_pylist([parse(data[o - start : o - start + n]) for _, o, n in run[k : k + PARSED]], schema=_ARROW_READ)
                    run = []
                run.append((file, offset, length))
        if stream is not None:
            stream.close()

    # The planner sees the index's few bytes; tasks are dealt out by the bytes that they will read.
    tasks = -(-(index.agg(F.sum("length")).first()[0] or 0) // archive.task_bytes) or 1
    dealt = index.select("file", "offset", "length").repartitionByRange(tasks, F.col("file"), F.col("offset")).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, READ)


def archive_pages(pages: DataFrame, archive: Archive = Archive()) -> DataFrame:
    """Writes all pages and reads all records back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return read_warc(write_warc(pages, archive), archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
