"""Substring dedup by hashing normalised lines, and passages inside lines.

A unit is a line, of any length, or a piece of at least ``min_words`` words of a longer line, between content-defined breaks: a word
begins a piece where the hash of it and the next word is the smallest within ``reach`` words, so a passage is cut alike wherever it
stands; without pieces (``reach`` 0), a passage that stands inside of lines is not found. Lines and pieces share their digests. Long runs without white space, as scripts
without blanks have them, are cut likewise by the hashes of four characters. Units are normalised (A-Z lower-cased, white
space runs become one blank) and hashed to 96 bits; the blank lines between paragraphs are no units. Of all occurrences of a digest the earliest stays (by
doc_id, then row, then offset) and the others are removed, as code point ranges of the original text.

Each task decides repeats among its own rows first and forwards one occurrence a digest, so a line that half of all documents share
costs one entry a batch. Entries travel in packs by digest range; a task sorts its packs and decides one range at a time.

Defined cases: a null text has no units; a null doc_id ranks last; ids of any type rank by their value; a repeated row loses the units that its first copy keeps; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..operators.ordering import Key, ranked
from .common import bounded_batches, settle, text_tasks, trimmed

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ENTRY = np.dtype([("d1", "<u8"), ("d2", "<u4"), ("doc", "<i8"), ("uid", "<i8"), ("start", "<i4"), ("end", "<i4")])


@dataclass(frozen=True)
class Units:
    #: Of pieces of lines; with 8 and 8, 96 % of passages of 51 words inside of lines share a piece.
    min_words: int = 8
    min_chars: int = 24
    reach: int = 8
    unspaced: int = 48
    char_reach: int = 16
    #: Bytes of the files below for each task of the shuffle of digests.
    file_bytes: int = 128_000_000
    #: Ranges of digests in each of these tasks.
    ranges: int = 8


def unspaced_cuts(c: np.ndarray, reach: int) -> list[int]:
    """Where pieces of a run of characters begin and end: where the hash of four characters is the smallest within ``reach``."""
    x = (c + 32 * ((c >= 65) & (c <= 90))).astype(np.uint64)
    n = len(x) - 3
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(4):
            h = (h ^ x[k : k + n]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
    wide = np.concatenate([np.full(reach, 2**64 - 1, np.uint64), h, np.full(reach, 2**64 - 1, np.uint64)])
    view = np.lib.stride_tricks.sliding_window_view(wide, 2 * reach + 1)
    breaks = np.flatnonzero(h == view.min(1))
    breaks = breaks[(view[breaks] == h[breaks, None]).sum(1) == 1]
    return np.union1d(breaks, [0, len(c)]).tolist()


def units(text: str | None, p: Units) -> list[tuple[bytes, int, int]]:
    """(normalised unit, start, end) with code point offsets; the end is exclusive."""
    if not text:
        return []
    words = WORD.findall(text.encode("utf-8", "surrogatepass").lower())
    if not words:
        return []
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.diff((~((c == 32) | ((c >= 9) & (c <= 13)))).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    line = np.searchsorted(np.flatnonzero(c == 10), starts)
    first = np.flatnonzero(np.diff(line, prepend=-1))
    out = []

    def add(i: int, j: int, whole: bool) -> None:
        unit = b" ".join(words[i:j])
        if whole or j - i >= p.min_words and len(unit) >= p.min_chars:
            out.append((unit, int(starts[i]), int(ends[j - 1])))

    bounds = [*first.tolist(), len(words)]
    for i, j in zip(bounds, bounds[1:], strict=False):
        add(i, j, True)
    if p.reach and len(words) > p.min_words:
        digest = xxhash.xxh3_64_intdigest
        h = np.array([digest(w) for w in words], np.uint64)
        with np.errstate(over="ignore"):
            h = (h ^ (np.append(h[1:], np.uint64(0)) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xFF51AFD7ED558CCD)
        wide = np.concatenate([np.full(p.reach, 2**64 - 1, np.uint64), h, np.full(p.reach, 2**64 - 1, np.uint64)])
        view = np.lib.stride_tricks.sliding_window_view(wide, 2 * p.reach + 1)
        breaks = np.flatnonzero((h == view.min(1)) & ((view == h[:, None]).sum(1) == 1))
        cuts = np.union1d(breaks, bounds).tolist()
        whole = set(zip(bounds, bounds[1:], strict=False))
        for i, j in zip(cuts, cuts[1:], strict=False):
            if (i, j) not in whole:
                add(i, j, False)
    for i in np.flatnonzero(ends - starts > p.unspaced):
        at = int(starts[i])
        cuts = unspaced_cuts(c[at : ends[i]], p.char_reach)
        for a, b in zip(cuts, cuts[1:], strict=False):
            unit = text[at + a : at + b].encode("utf-8", "surrogatepass").lower()
            if len(unit) >= p.min_chars:
                out.append((b"\n" + unit, at + a, at + b))
    return out


def later(e: np.ndarray) -> np.ndarray:
    """Sorts entries by digest and rank in place; marks those that are not the first of their digest."""
    e[:] = e[np.lexsort((e["start"], e["uid"], e["doc"], e["d2"], e["d1"]))]
    out = np.zeros(len(e), bool)
    out[1:] = (e["d1"][1:] == e["d1"][:-1]) & (e["d2"][1:] == e["d2"][:-1])
    return out


#: kind 0: a row (doc_id, uid, n_units, n_chars); 1: a pack of entries; 2: a removed range.
_FIELDS = [("kind", pa.int32()), ("r", pa.int64()), ("uid", pa.int64()), ("n_units", pa.int64()), ("n_chars", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("pack", pa.binary())]
_SCHEMA = "kind int, r long, uid long, n_units long, n_chars long, start int, end int, pack binary"


def _rows(schema: pa.Schema, n: int, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols and not isinstance(cols[f.name], pa.Array) else cols.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)


def _removed(e: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    return _rows(schema, len(e), kind=np.full(len(e), 2, np.int32), r=e["uid"], uid=e["uid"], start=e["start"], end=e["end"])


def repeated_units(docs: DataFrame, p: Units = Units()) -> DataFrame:
    """doc_id, n_chars, n_units, n_removed, removed_chars, removed (start:end, merged, comma-joined) of every document."""
    docs = bounded_batches(docs)
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = own.schema["doc_id"].dataType.simpleString()
    if isinstance(own.schema["doc_id"].dataType, IntegralType):
        own = own.withColumn("rank", F.col("doc_id").cast("long"))
    else:  # the numbers of the ids in their own order, wherever the rows stand
        ids = ranked(own.select(F.col("doc_id").alias("r_id")).where("r_id is not null").distinct(), [Key("r_id")], "rank")
        own = own.join(ids, F.col("doc_id") == F.col("r_id"), "left").select("doc_id", "text", "rank")
    tasks = text_tasks(docs, p.file_bytes)
    bits = (p.ranges * tasks - 1).bit_length()

    @trimmed
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            schema = pa.schema([("doc_id", b.schema.field(0).type), *_FIELDS])
            ids = b.column(2).to_pylist()
            counts, lengths, parts = [], [], []
            for at in range(0, b.num_rows, 256):
                digests, entries = [], []
                for k, text in enumerate(b.column(1).slice(at, 256).to_pylist(), at):
                    found = units(text, p)
                    counts.append(len(found))
                    lengths.append(None if text is None else len(text))
                    doc = 2**63 - 1 if ids[k] is None else ids[k]
                    for unit, start, end in found:
                        digests.append(xxhash.xxh3_128_digest(unit))
                        entries.append((doc, uid + k, start, end))
                if entries:
                    # Entries wait as 36 bytes each, not as Python objects.
                    e = np.zeros(len(entries), ENTRY)
                    d = np.frombuffer(b"".join(digests), np.dtype([("d1", "<u8"), ("d2", "<u4"), ("rest", "<u4")]))
                    e["d1"], e["d2"] = d["d1"], d["d2"]
                    e["doc"], e["uid"], e["start"], e["end"] = np.array(entries, np.int64).T
                    parts.append(e)
            yield _rows(schema, b.num_rows, doc_id=b.column(0), kind=[0] * b.num_rows, r=np.arange(b.num_rows) + uid, uid=np.arange(b.num_rows) + uid, n_units=counts, n_chars=lengths)
            uid += b.num_rows
            if not parts:
                continue
            e = np.concatenate(parts)
            gone = later(e)
            if gone.any():
                yield _removed(e[gone], schema)
            e = e[~gone]
            r = (e["d1"] >> np.uint64(64 - bits)).astype(np.int64)
            first = np.flatnonzero(np.diff(r, prepend=-1))
            yield _rows(schema, len(first), kind=np.full(len(first), 1, np.int32), r=r[first], pack=[e[i:j].tobytes() for i, j in zip(first, [*first[1:], len(e)], strict=True)])

    @trimmed
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs, now, schema = [], None, None

        def met() -> Iterator[pa.RecordBatch]:
            e = np.concatenate(packs)
            gone = later(e)
            if gone.any():
                yield _removed(e[gone], schema)

        for b in batches:  # in the order of r
            schema = b.schema
            kind = b.column("kind").to_numpy()
            if (kind != 1).any():
                yield b.filter(pa.array(kind != 1))
            b = b.filter(pa.array(kind == 1))
            for r, pack in zip(b.column("r").to_numpy(), b.column("pack"), strict=True):
                if r != now and packs:
                    yield from met()
                    packs = []
                now = r
                packs.append(np.frombuffer(pack.as_py(), ENTRY))
        if packs:
            yield from met()

    schema = f"doc_id {id_type}, {_SCHEMA}"
    out = settle(own.mapInArrow(cut, schema).repartition(tasks, "r").sortWithinPartitions("r").mapInArrow(meet, schema).select("kind", "doc_id", "uid", "n_units", "n_chars", "start", "end"))
    spans = out.where("kind = 2").groupBy(F.col("uid").alias("s_uid")).agg(F.count("*").alias("n_removed"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s"))
    # Ranges that overlap, or that only white space parts, become one.
    merged = F.aggregate("s", F.array().cast("array<struct<start:int,end:int>>"), lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] + 1 >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))))
    spans = spans.withColumn("s", F.when(F.size("s") > 0, merged))
    spans = spans.select("s_uid", "n_removed", F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("removed"), F.aggregate("s", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"]).alias("removed_chars"))
    rows = out.where("kind = 0").join(spans, F.col("uid") == F.col("s_uid"), "left")
    return rows.select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n_chars"), "n_units", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("removed_chars", F.lit(0)).alias("removed_chars"), F.coalesce("removed", F.lit("")).alias("removed"))
