"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The items' words make one automaton, built on the driver and broadcast; its size is bounded by ``max_shard_words``, and a benchmark
above that bound becomes several automata through which each batch of documents runs in turn. A document's words stream through an
automaton that tracks the longest suffix read so far which occurs in some item. Where that reaches ``window`` words, all of its words
are hit; an item of fewer words counts where it occurs as a whole. No shuffle: every document is decided where it is read.

Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z.

Defined cases: a null or wordless text has no words and no hits; null or wordless items are ignored; items with the same item_id are
one item; a null item_id is written as the empty text; repeated document rows each give a row; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, trimmed

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Rows looked at together, so that Python holds few texts at once.
SLICE = 256


@dataclass(frozen=True)
class Limits:
    window: int = 10
    #: Words of items in one automaton; about 0.3 kB each.
    max_shard_words: int = 200_000
    #: A document with a larger share of hit words is dropped as a whole; below it, the hit spans go.
    max_coverage: float = 0.5


def words_of(text: str | None) -> tuple[bytes, list[bytes]]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data, WORD.findall(data.lower())


class SuffixAutomaton:
    """All substrings of the items that were added, by word."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.out: list[dict[int, int]] = [{}]
        self.length = [0]
        self.link = [-1]
        self.ends: list[set[str]] = [set()]  # items that have a prefix ending in the state
        self.whole: dict[int, set[str]] = {}  # short items that the state spells

    def _state(self, length: int, out: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.out.append(out)
        self.link.append(link)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A copy of q for the strings that are not longer than p's by more than w."""
        copy = self._state(self.length[p] + 1, dict(self.out[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.out[p].get(w) == q:
            self.out[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        q = self.out[last].get(w)
        if q is not None:  # read before, in this or another item
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.out[p]:
            self.out[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.out[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def add(self, item: str, words: list[bytes]) -> None:
        state = 0
        for w in words:
            state = self._extend(state, self.ids.setdefault(w, len(self.ids)))
            self.ends[state].add(item)
        if len(words) < self.window:
            self.whole.setdefault(state, set()).add(item)

    def freeze(self) -> SuffixAutomaton:
        """Ready for reading: items by window state, whole short items by state, one table of transitions."""
        by_length = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for v in reversed(by_length):
            self.ends[self.link[v]] |= self.ends[v] if self.link[v] > 0 else set()
        n = len(self.length)
        self.items: list[tuple[str, ...]] = [()] * n
        self.short: list[tuple[tuple[int, str], ...]] = [()] * n
        for v in by_length:  # a link comes before what points to it
            up = self.link[v]
            if self.length[v] >= self.window:
                self.items[v] = self.items[up] if self.length[up] >= self.window else tuple(sorted(self.ends[v]))
            self.short[v] = self.short[up] + tuple((self.length[v], x) for x in sorted(self.whole.get(v, ())))
        self.size = max(1, len(self.ids))
        self.table = {s * self.size + w: t for s, out in enumerate(self.out) for w, t in out.items()}
        self.out, self.ends = [], []
        return self

    def scan(self, words: list[bytes]) -> tuple[bytearray, set[str]]:
        """A mark for each word that is hit, and the items that hit."""
        hit, found = bytearray(len(words)), set()
        table, size, link, length, window, items, short = self.table.get, self.size, self.link, self.length, self.window, self.items, self.short
        state = matched = 0
        running = False  # the match that ends at the word before is marked
        for i, w in enumerate(map(self.ids.get, words)):
            if w is None:
                state = matched = 0
                running = False
                continue
            to = table(state * size + w)
            if to is None:
                running = False
                while to is None:
                    state = link[state]
                    if state < 0:
                        break
                    to = table(state * size + w)
                matched = length[state] if state >= 0 else -1
                to = to or 0
            state = to
            matched += 1
            if matched >= window:
                if running:
                    hit[i] = 1
                else:
                    hit[i - matched + 1 : i + 1] = b"\1" * matched
                    running = True
                found.update(items[state])
            for n, item in short[state]:
                if n <= matched:
                    hit[i - n + 1 : i + 1] = b"\1" * n
                    found.add(item)
        return hit, found


def build(benchmark: DataFrame, limits: Limits) -> list:
    """Broadcast automata of at most about ``max_shard_words`` words each."""
    spark = benchmark.sparkSession
    step = limits.window - 1
    piece = max(limits.window, limits.max_shard_words // 4)

    @trimmed
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)[1]
                # A long item is cut into pieces that overlap by all but one word of a window, so no window is lost.
                rows += [(item or "", b" ".join(words[k : k + piece]), len(words[k : k + piece])) for k in range(0, max(1, len(words) - step), piece - step) if words]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary(), pa.int64()))], ["item", "words", "n"])

    cut = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(pieces, "item string, words binary, n long").distinct()
    total = cut.agg(F.sum("n")).first()[0] or 0
    shards = -(-total // limits.max_shard_words)
    out = []
    for k in range(shards):
        sam = SuffixAutomaton(limits.window)
        for row in cut.where(F.pmod(F.xxhash64("item", "words"), F.lit(shards)) == k).orderBy("item", "words").toLocalIterator():
            sam.add(row["item"], bytes(row["words"]).split(b" "))
        out.append(spark.sparkContext.broadcast(sam.freeze()))
    return out


def _marks(texts: list[str | None], automata: list) -> Iterator[tuple[bytes, list[bytes], bytearray, set[str]]]:
    """Of each text: its bytes, words, hit marks and items."""
    for at in range(0, len(texts), SLICE):
        read = [words_of(t) for t in texts[at : at + SLICE]]
        marks = [(bytearray(len(w)), set()) for _, w in read]
        for one in automata:
            sam = one.value
            for (_, words), (hit, found) in zip(read, marks, strict=True):
                now, items = sam.scan(words)
                if items:
                    found |= items
                    for i, x in enumerate(now):
                        if x:
                            hit[i] = 1
        yield from ((data, words, hit, found) for (data, words), (hit, found) in zip(read, marks, strict=True))


def contamination(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hit spans as word positions (end exclusive)."""
    docs = bounded_batches(docs)
    automata = build(benchmark, limits)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]

    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for _, words, hit, found in _marks(b.column(1).to_pylist(), automata):
                n = sum(hit)
                spans = ",".join(f"{m.start()}:{m.end()}" for m in re.finditer(rb"\x01+", bytes(hit))) if n else ""
                rows.append((len(words), n, len(found), hashlib.sha256(",".join(sorted(found)).encode("utf-8", "surrogatepass")).hexdigest(), n > 0, spans))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], ["doc_id", *names])

    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return own.mapInArrow(scan, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``docs`` without the hit spans; documents whose hit share exceeds ``max_coverage`` go as a whole. Others stay as they are."""
    docs = bounded_batches(docs)
    automata = build(benchmark, limits)
    at, c = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    @trimmed
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep, changed = b.column(at).to_pylist(), [], []
            for k, (data, words, hit, _) in enumerate(_marks(texts, automata)):
                n = sum(hit)
                keep.append(n <= limits.max_coverage * len(words))
                if n and keep[-1]:
                    changed.append(k)
                    texts[k] = cut_words(data, hit)
            out = pa.table(b)
            if changed:
                out = out.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
                if c is not None:
                    n = b.column(c).to_pylist()
                    for k in changed:
                        n[k] = len(texts[k])
                    out = out.set_column(c, b.schema.field(c), pa.array(n, b.schema.field(c).type))
            yield from out.filter(pa.array(keep, pa.bool_())).to_batches()

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(clean, docs.withColumn("text", F.col("text").cast("string")).schema)


def cut_words(data: bytes, hit: bytearray) -> str:
    """The text without its hit words, and without what stands between two of them."""
    parts, end, gone = [], 0, False
    for mark, m in zip(hit, WORD.finditer(data.lower()), strict=True):
        if not mark:
            gone = False
        elif gone:
            end = m.end()
        else:
            parts.append(data[end : m.start()])
            end, gone = m.end(), True
    return b"".join([*parts, data[end:]]).decode("utf-8", "surrogatepass")
