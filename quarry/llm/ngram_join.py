"""N-gram Jaccard join: near-duplicate components over word shingles, with signature trees.

1. Each text becomes its set of 64-bit shingle hashes; equal sets are one entity, named by a fingerprint of the set. Copies therefore
   cost one row each and are never paired.
2. Two sets with Jaccard >= t differ in at most (1 - t) / (1 + t) * (|x| + |y|) shingles. Hash space is cut into more parts than that,
   so at least one part holds the same shingles in both, whatever they are. Each set gives a signature per part, for its own size
   band and the next; sets with no signature in common cannot link. The holders of a signature are its shard. Within each task, and
   then for each range of signatures, holders are tied to the smallest of them: a hot signature is reduced before the shuffle.
3. Every link comes out of a signature tree. The sets of a shard, by blocks, become the leaves of a tree whose nodes hold OR-combined
   bitmaps, size ranges and collision counts. A dual traversal of a tree with itself, or with another, prunes pairs of nodes by their
   sizes, by the largest overlap that the bitmaps allow, and if all below them is in one component already. Pairs of leaves that
   remain are verified on the sets.
4. First each set goes to the shard of the tie in which it shares most signatures, and only its nearest partner in the tree is taken:
   that settles nearly all groups with no more pairs than sets. While shards hold several components, one set of each meets in trees
   again. At last all holders of a signature that is still held by several components are traversed in full: outsiders of the shard's
   largest component against everyone, by pairs of blocks. A link between any two sets is in one component by then, or found there.

Defined cases: a null or wordless text has an empty set, links with nothing and is its own component; fewer words than a shingle make
one shingle of all words; rows with one doc_id are rows of their own with one name; a null doc_id is in the component of its text,
whose id is the smallest that is not null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, release, settle, small, text_tasks, trimmed, unused

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
U = np.uint64


@dataclass(frozen=True)
class Near:
    """Links need den * |x & y| >= num * |x | y|."""

    words: int = 5
    num: int = 80
    den: int = 100
    #: Bytes of the files below for each task of the signature shuffle; a task sorts them, and holds one range of signatures at a time.
    file_bytes: int = 128_000_000
    #: Ranges of signatures in each of these tasks.
    ranges: int = 8
    #: Signatures that a task ties to each other before they are sent; some 40 MB.
    held: int = 500_000
    #: Sets in one block of a shard.
    block: int = 512
    #: Rows (a set in a shard) in one group of shards; some MB.
    group_rows: int = 2048
    #: A further round over components that are still apart needs the last to have joined one in so many of its sets.
    progress: int = 100
    fanout: int = 8


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits (the finaliser of MurmurHash3)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
        return h ^ (h >> U(33))


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of the text's k-word shingles."""
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return np.zeros(0, U)
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(w) for w in words], U)
    k = min(k, len(h))
    out = h[: len(h) - k + 1].copy()
    with np.errstate(over="ignore"):
        for j in range(1, k):
            out = mixed(out) + h[j : len(h) - k + 1 + j]
    return np.unique(mixed(out + U(k)))


def fingerprint(s: np.ndarray) -> int:
    """Names a set; as a signed 64-bit number."""
    with np.errstate(over="ignore"):
        return int(mixed(np.array([mixed(s ^ U(0x9E3779B97F4A7C15)).sum(dtype=U) + U(len(s))], U)).astype(np.int64)[0])


class Bands:
    """Size bands such that linked sets are in one band or in two that are next to each other."""

    def __init__(self, near: Near) -> None:
        self.near, self.first = near, [1]

    def of(self, n: int) -> int:
        while self.first[-1] <= n:
            b = self.first[-1]
            self.first.append(max(b + 1, (b - 1) * self.near.den // self.near.num + 1))
        return int(np.searchsorted(self.first, n, "right")) - 1

    def parts(self, band: int) -> tuple[int, int]:
        """For links whose larger set is in the band: the parts, and the most of them that can differ."""
        most = self.first[band + 1] - 1
        differ = 2 * most * (self.near.den - self.near.num) // (self.near.den + self.near.num)
        return differ + 1 + differ // 16, differ


#: Cuts of hash space that are tried before an empty part counts as a signature.
CUTS = 8


def signatures(s: np.ndarray, bands: Bands) -> np.ndarray:
    """A hash for each part of hash space and each of the two bands.

    Parts that are empty in many sets would bring them together for nothing. All parts that two linked sets share are empty ones only
    if both have at least ``m - differ`` empty parts; such sets, and no others, are cut once more by another hash, where the same
    holds, and only after the last cut do empty parts have signatures.
    """
    own = bands.of(len(s))
    bands.of(bands.first[own + 1])
    cuts: list[tuple[np.ndarray, np.ndarray]] = []
    out = []
    with np.errstate(over="ignore"):
        for band in (own, own + 1):
            m, differ = bands.parts(band)
            for k in range(CUTS):
                if k == len(cuts):
                    x = np.sort(mixed(s + U(k) * U(0xA24BAED4963EE407))) if k else s
                    cuts.append((x, np.concatenate([[U(0)], np.cumsum(mixed(x ^ U(0xD6E8FEB86659FD93)), dtype=U)])))
                x, g = cuts[k]
                at = np.searchsorted(((x >> U(32)) * U(m)) >> U(32), np.arange(m + 1, dtype=U))
                sig = mixed(g[at[1:]] - g[at[:-1]] + mixed(np.arange(m, dtype=U) + U(band + 1) * U(0x9E3779B97F4A7C15) + U(k) * U(0xD1342543DE82EF95)))
                empty = at[1:] == at[:-1]
                more = empty.sum() >= m - differ
                out.append(sig if more and k == CUTS - 1 else sig[~empty])
                if not more:
                    break
    return np.concatenate(out)


def ties(sig: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by signature, without repeats: the signatures, their holders, whether each is its signature's smallest, and that smallest."""
    by = np.lexsort((who, sig))
    sig, who = sig[by], who[by]
    new = np.ones(len(sig), bool)
    new[1:] = sig[1:] != sig[:-1]
    keep = new.copy()
    keep[1:] |= who[1:] != who[:-1]
    sig, who, new = sig[keep], who[keep], new[keep]
    return sig, who, new, who[np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0))]


#: kind 0: a document (doc_id, n, d); 1: signatures of a range (a) and their holders (b); 2: a tie (sig, d, x).
def _schema(id_type: str) -> str:
    return f"kind int, r long, doc_id {id_type}, n long, d long, sig long, x long, a binary, b binary"


def _batch(rows: dict, schema: pa.Schema, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([rows[f.name].cast(f.type) if f.name in rows and isinstance(rows[f.name], pa.Array) else pa.array(rows[f.name], f.type) if f.name in rows else pa.nulls(n, f.type) for f in schema], schema=schema)


def _arrow(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("kind", pa.int32()), ("r", pa.int64()), ("doc_id", id_type), ("n", pa.int64()), ("d", pa.int64()), ("sig", pa.int64()), ("x", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])


def tied(docs: DataFrame, near: Near) -> tuple[DataFrame, DataFrame]:
    """The documents' sets (doc_id, n, d), and ties (sig, d, x) between entities that hold one signature. Texts are read once."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = own.schema["doc_id"].dataType.simpleString()
    tasks = text_tasks(docs, near.file_bytes)
    bits = (near.ranges * tasks - 1).bit_length()

    def packed(sigs: list[np.ndarray], who: list[np.ndarray], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        sig, who, new, first = ties(np.concatenate(sigs), np.concatenate(who))
        rest = ~new
        if rest.any():
            yield _tie_batch(sig[rest], first[rest], who[rest], schema)
        sig, who = sig[new], who[new]
        r = (sig >> U(64 - bits)).astype(np.int64)
        cut = np.flatnonzero(np.diff(r, prepend=-1))
        ends = [*cut[1:], len(r)]
        yield _batch({"kind": [1] * len(cut), "r": r[cut], "a": [sig[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], "b": [who[i:j].tobytes() for i, j in zip(cut, ends, strict=True)]}, schema, len(cut))

    @trimmed
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, sigs, who, seen, held, schema = Bands(near), [], [], set(), 0, None
        for whole in batches:
            schema, n, d = _arrow(whole.schema.field(0).type), [], []
            for at in range(0, whole.num_rows, 256):
                for text in whole.column(1).slice(at, 256).to_pylist():
                    s = shingles(text, near.words)
                    n.append(len(s))
                    d.append(fingerprint(s))
                    if len(s) and d[-1] not in seen:
                        seen.add(d[-1])
                        sigs.append(signatures(s, bands))
                        who.append(np.full(len(sigs[-1]), d[-1], np.int64))
                        held += len(sigs[-1])
                    if held >= near.held:
                        yield from packed(sigs, who, schema)
                        sigs, who, seen, held = [], [], set(), 0
            yield _batch({"kind": [0] * len(n), "r": np.arange(len(n)) * 7919 + (d[0] if d else 0) % 1000003, "doc_id": whole.column(0), "n": n, "d": d}, schema, len(n))
        if sigs:
            yield from packed(sigs, who, schema)

    def met(a: list[bytes], b: list[bytes], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        sig, who, new, first = ties(np.concatenate([np.frombuffer(y, U) for y in a]), np.concatenate([np.frombuffer(y, np.int64) for y in b]))
        rest = ~new
        if rest.any():
            yield _tie_batch(sig[rest], first[rest], who[rest], schema)

    @trimmed
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, now, schema = [], [], None, None
        for x in batches:  # in the order of r
            schema = x.schema
            kind = x.column(0).to_numpy()
            if (kind != 1).any():
                yield x.filter(pa.array(kind != 1))
            packs = x.filter(pa.array(kind == 1))
            for r, sig, who in zip(packs.column(1).to_numpy(), packs.column(7), packs.column(8), strict=True):
                if r != now and a:
                    yield from met(a, b, schema)
                    a, b = [], []
                now = r
                a.append(sig.as_py())
                b.append(who.as_py())
        if a:
            yield from met(a, b, schema)

    schema = _schema(id_type)
    out = own.mapInArrow(sign, schema).repartition(tasks, "r").sortWithinPartitions("r").mapInArrow(meet, schema)
    out = settle(out.select("kind", "doc_id", "n", "d", "sig", "x"))
    return out.where("kind = 0").select("doc_id", "n", "d"), out.where("kind = 2").select("sig", "d", "x")


def _tie_batch(sig: np.ndarray, first: np.ndarray, other: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    n = len(sig)
    return _batch({"kind": np.full(n, 2, np.int32), "r": (sig >> U(40)).astype(np.int64), "d": first, "sig": sig.view(np.int64), "x": other}, schema, n)


def enough(common: int | np.ndarray, total: int | np.ndarray, near: Near) -> bool | np.ndarray:
    """Whether two sets of ``total`` elements together, of which ``common`` are in both, link."""
    return common * (near.den + near.num) >= near.num * total


def common(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


def sets_of(docs: DataFrame, who: DataFrame, entities: DataFrame, near: Near) -> DataFrame:
    """d, s (the set), m (its bitmap) of the entities named in ``who`` (d); one document of each is read again."""
    ids = settle(who.join(entities, "d").select(F.col("doc_id").alias("w_id"), F.col("d").alias("w_d")))
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    wanted = own.join(small(ids.select("w_id")), F.col("doc_id").eqNullSafe(F.col("w_id")), "left_semi").select("text")

    @trimmed
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                s = [shingles(t, near.words) for t in b.column(0).slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([fingerprint(x) for x in s], pa.int64()), pa.array([x.tobytes() for x in s], pa.binary()), pa.array([bitmap(x).tobytes() for x in s], pa.binary())], ["d", "s", "m"])

    # Rows that share an id with a wanted row come too; only wanted sets stay.
    made = wanted.mapInArrow(make, "d long, s binary, m binary")
    return settle(made.join(small(ids.select(F.col("w_d").alias("d"))), "d", "left_semi"))


def bitmap(s: np.ndarray) -> np.ndarray:
    """A bit for each shingle, in at least four times as many bits, a power of two; a larger bitmap folds onto a smaller one."""
    width = max(64, 1 << (4 * len(s) - 1).bit_length())
    out = np.zeros(width // 8, np.uint8)
    at = mixed(s + U(1)) & U(width - 1)
    np.bitwise_or.at(out, (at >> U(3)).astype(np.int64), np.uint8(1) << (at & U(7)).astype(np.uint8))
    return out.view(U)


def folded(m: np.ndarray, size: int) -> np.ndarray:
    return m if len(m) == size else np.bitwise_or.reduce(m.reshape(-1, size), 0)


def most_common(x: np.ndarray, n: int, y: np.ndarray, k: int) -> int:
    """The largest overlap of sets of n and k shingles that their bitmaps allow: a bit that one alone has is a shingle outside."""
    size = min(len(x), len(y))
    x, y = folded(x, size), folded(y, size)
    return min(n - int(np.bitwise_count(x & ~y).sum()), k - int(np.bitwise_count(y & ~x).sum()))


def _wanted(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The sets of ``ids`` (d); the others are left out before any shuffle."""
    return sets.join(small(settle(ids.select("d").distinct())), "d", "left_semi")


def verified(pairs: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """The pairs (a, b) that link, compared as sets; only the sets that are in a pair travel."""

    @trimmed
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = []
            for at in range(0, t.num_rows, 64):
                for x, y in zip(*(c.to_pylist() for c in t.slice(at, 64).columns[2:]), strict=True):
                    x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                    ok.append(bool(enough(common(x, y), len(x) + len(y), near)))
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pairs = settle(pairs)
    held = _wanted(sets, pairs.select(F.col("a").alias("d")).union(pairs.select("b")))
    one, two = (held.select(F.col("d").alias(d), F.col("s").alias(f"s{d}")) for d in "ab")
    return pairs.join(two, "b").join(one, "a").select("a", "b", "sa", "sb").mapInArrow(linked, "a long, b long")


class Tree:
    """Levels of nodes over the sets of many shards: OR-combined bitmaps, size ranges, most collisions, the component if there is one only,
    and the range of shards. Sets of a shard stand together, so a traversal goes down the subtrees of all shards at once."""

    def __init__(self, n: np.ndarray, bits: np.ndarray, comp: np.ndarray, shard: np.ndarray, fanout: int) -> None:
        # Sets with the same low bits stand together, so that nodes near the leaves hold alike sets.
        self.order = np.lexsort((n, *(bits[:, k] for k in range(min(4, bits.shape[1]))), shard))
        bits, n, comp, shard = bits[self.order], n[self.order], comp[self.order], shard[self.order]
        self.levels = [(bits, n, n, n - np.bitwise_count(bits).sum(1), comp, shard, shard)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, lost, comp, from_, to = self.levels[-1]
            cut = np.arange(0, len(low), fanout)
            first, last = np.minimum.reduceat(comp, cut), np.maximum.reduceat(comp, cut)
            several = (first != last) | np.logical_or.reduceat(comp == -1, cut)
            self.levels.append((np.bitwise_or.reduceat(bits, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(lost, cut), np.where(several, -1, first), np.minimum.reduceat(from_, cut), np.maximum.reduceat(to, cut)))


def may_link(one: tuple, two: tuple, a: np.ndarray, b: np.ndarray, near: Near, leaves: bool) -> np.ndarray:
    """Of pairs of nodes: whether sets below them are of one shard, can link and are not in one component."""
    (bits, low, high, lost, comp, from_, to), (bits2, low2, high2, lost2, comp2, from2, to2) = one, two
    ok = (from_[a] <= to2[b]) & (from2[b] <= to[a]) & ~((comp[a] == comp2[b]) & (comp[a] != -1)) & (high[a] * near.den >= near.num * low2[b]) & (high2[b] * near.den >= near.num * low[a])
    at = np.flatnonzero(ok)
    x, y = bits[a[at]], bits2[b[at]]
    if leaves:
        overlap = np.minimum(low[a[at]] - np.bitwise_count(x & ~y).sum(1), low2[b[at]] - np.bitwise_count(y & ~x).sum(1))
    else:
        # Common shingles have common bits; those that share a bit are at most the collisions of either side.
        overlap = np.minimum(np.bitwise_count(x & y).sum(1) + np.minimum(lost[a[at]], lost2[b[at]]), np.minimum(high[a[at]], high2[b[at]]))
    ok[at] = enough(overlap, low[a[at]] + low2[b[at]], near)
    return ok


Leaves = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def dual(one: Leaves, two: Leaves | None, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of one shard that may link and are not in one component; each side has sizes, bitmaps, components, shards.

    Without a second side, the pairs are those within the first, each once.
    """
    first = Tree(*one, near.fanout)
    second = first if two is None else Tree(*two, near.fanout)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(len(first.levels) - 1, len(second.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        i, j, a, b = stack.pop()
        if len(a) > 4096:
            stack += [(i, j, a[k : k + 4096], b[k : k + 4096]) for k in range(0, len(a), 4096)]
            continue
        if two is None and i == j:
            a, b = a[a <= b], b[a <= b]
        ok = may_link(first.levels[i], second.levels[j], a, b, near, i == j == 0)
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        if i == j == 0:
            if two is None:
                a, b = a[a < b], b[a < b]
                x, y = first.order[a], first.order[b]
                out.append((np.minimum(x, y), np.maximum(x, y)))
            else:
                out.append((first.order[a], second.order[b]))
        elif i >= j:
            a, b = _down(a, b, len(first.levels[i - 1][1]), near.fanout)
            stack.append((i - 1, j, a, b))
        else:
            b, a = _down(b, a, len(second.levels[j - 1][1]), near.fanout)
            stack.append((i, j - 1, a, b))
    return (np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _down(parents: np.ndarray, others: np.ndarray, n: int, fanout: int) -> tuple[np.ndarray, np.ndarray]:
    children = (parents[:, None] * fanout + np.arange(fanout)).ravel()
    ok = children < n
    return children[ok], np.repeat(others, fanout)[ok]


def _by_width(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of whole shards, and their bitmaps as wide as the narrowest of the shard, for each width there is."""
    maps = [np.frombuffer(m, U) for m in t.column("m").to_pylist()]
    _, shard = np.unique(t.column("g").to_numpy(), return_inverse=True)
    least = np.full(shard.max() + 1, 1 << 62)
    np.minimum.at(least, shard, [len(m) for m in maps])
    for width in np.unique(least):
        at = np.flatnonzero(least[shard] == width)
        yield at, np.stack([folded(maps[k], width) for k in at])


def _dealt(rows: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """The rows with their sets' sizes and bitmaps, and the group that their shard ``g`` is in; a group has some ``group_rows`` rows."""
    rows = settle(rows)
    groups = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // near.group_rows))
    maps = _wanted(sets, rows).select("d", (F.octet_length("s") / 8).cast("long").alias("n"), "m")
    return rows.withColumn("group", F.pmod(F.xxhash64(F.lit("group"), "g"), F.lit(groups)).cast("int")).join(maps, "d")


def nearest(n: np.ndarray, bits: np.ndarray, shard: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs that a dual traversal leaves, for each set the one with the most alike of the sets before it."""
    a, b = dual((n, bits, np.arange(len(n)), shard), None, near)
    alike = np.zeros(len(a))
    for at in range(0, len(a), 8192):
        i, j = a[at : at + 8192], b[at : at + 8192]
        both = np.minimum(n[i] - np.bitwise_count(bits[i] & ~bits[j]).sum(1), n[j] - np.bitwise_count(bits[j] & ~bits[i]).sum(1))
        alike[at : at + 8192] = both / (n[i] + n[j] - both)
    by = np.lexsort((a, -alike, b))
    a, b = a[by], b[by]
    first = np.diff(b, prepend=-1) != 0
    return a[first], b[first]


def _pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pa.table({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})


def nearest_pairs(members: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """Pairs (a, b) of near sets within blocks of shards (lead, d; each row once): no more pairs than members, and each from a tree."""
    blocks = members.groupBy("lead").agg(F.count("*").alias("k")).where("k > 1")
    blocks = settle(blocks.select("lead", F.ceil(F.col("k") / near.block).cast("int").alias("blocks")))
    rows = members.join(small(blocks), "lead").select(F.xxhash64("lead", F.pmod(F.xxhash64("d"), F.col("blocks"))).alias("g"), "d")
    rows = _dealt(rows, sets, near).select("group", "g", "d", "n", "m")

    def meet(t: pa.Table) -> pa.Table:
        d, n, g = (t.column(k).to_numpy() for k in ("d", "n", "g"))
        found = []
        for at, bits in _by_width(t):
            a, b = nearest(n[at], bits, g[at], near)
            found.append((d[at[a]], d[at[b]]))
        return _pairs(found)

    return rows.groupBy("group").applyInArrow(meet, "a long, b long").distinct()


def all_pairs(ties_: DataFrame, comp: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """Pairs (a, b) of different components that hold one signature and that sizes and bitmaps allow to link.

    All holders of a signature go to the shard of its smallest holder. A shard of more than ``block`` sets is dealt out by pairs of
    blocks, sets outside its largest component against all.
    """
    c = comp.select(F.col("node").alias("c_d"), F.col("root").alias("cd"))
    x = comp.select(F.col("node").alias("c_x"), F.col("root").alias("cx"))
    marked = ties_.join(c, ties_["d"] == c["c_d"], "left").join(x, ties_["x"] == x["c_x"], "left").select("sig", "d", "x", (F.coalesce("cd", "d") != F.coalesce("cx", "x")).alias("apart"))
    open_ = marked.groupBy("sig").agg(F.max("apart").alias("open"), F.min(F.least("d", "x")).alias("lead")).where("open").select("sig", "lead")
    held = ties_.join(open_, "sig").select("lead", F.explode(F.array("d", "x")).alias("d")).distinct()
    held = settle(held.join(comp.withColumnRenamed("node", "d"), "d", "left").select("lead", "d", F.coalesce("root", "d").alias("comp")))
    by_comp = held.groupBy("lead", "comp").agg(F.count("*").alias("n"))
    shards = settle(by_comp.groupBy("lead").agg(F.sum("n").alias("k"), F.max(F.struct("n", "comp")).alias("main")))
    blocks = lambda k: F.ceil(k / near.block).cast("int")
    hot = small(settle(shards.where(F.col("k") > near.block).select("lead", F.col("main.comp").alias("main"), blocks(F.col("k")).alias("nb"), blocks(F.col("k") - F.col("main.n")).alias("mb")).where("mb > 0")))
    few = held.join(small(settle(shards.where((F.col("k") <= near.block) & (F.col("k") > F.col("main.n"))).select("lead"))), "lead").select(F.col("lead").alias("g"), "d", "comp", F.lit(2).alias("role"))
    many = held.join(hot, "lead")  # without shards that are one component
    slot = lambda n: F.pmod(F.xxhash64("d"), F.col(n)).cast("int")
    until = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    probes = many.where("comp <> main").select("lead", "d", "comp", F.lit(0).alias("role"), slot("mb").alias("i"), until("nb").alias("j"))
    targets = many.select("lead", "d", "comp", F.lit(1).alias("role"), until("mb").alias("i"), slot("nb").alias("j"))
    dealt = probes.unionAll(targets).select(F.xxhash64("lead", "i", "j").alias("g"), "d", "comp", "role")
    rows = _dealt(few.unionAll(dealt), sets, near).select("group", "g", "role", "d", "comp", "n", "m")

    def meet(t: pa.Table) -> pa.Table:
        d, n, g, role, comp = (t.column(k).to_numpy() for k in ("d", "n", "g", "role", "comp"))
        found = []
        for at, bits in _by_width(t):
            part = lambda s: (n[at[s]], bits[s], comp[at[s]], g[at[s]])  # noqa: B023, E731
            own, one, two = (np.flatnonzero(role[at] == k) for k in (2, 0, 1))
            if len(own):
                a, b = dual(part(own), None, near)
                found.append((d[at[own[a]]], d[at[own[b]]]))
            if len(one) and len(two):
                a, b = dual(part(one), part(two), near)
                found.append((d[at[one[a]]], d[at[two[b]]]))
        return _pairs(found)

    return rows.groupBy("group").applyInArrow(meet, "a long, b long").distinct()


def apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components."""
    one = comp.select(F.col("node").alias("n_a"), F.col("root").alias("r_a"))
    two = comp.select(F.col("node").alias("n_b"), F.col("root").alias("r_b"))
    out = pairs.join(one, pairs["a"] == one["n_a"], "left").join(two, pairs["b"] == two["n_b"], "left")
    return out.where(F.coalesce("r_a", "a") != F.coalesce("r_b", "b")).select("a", "b")


def near_duplicates(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """doc_id, n_shingles, component_id of every document, the entity ``d`` of its set and the component's ``root`` entity."""
    docs = bounded_batches(docs)
    spark = docs.sparkSession
    sets_n, ties_ = tied(docs, near)
    release(spark)  # the signatures, which are most of what the join shuffles
    pairs = settle(ties_.groupBy(F.col("d").alias("a"), F.col("x").alias("b")).agg(F.count("*").alias("shared")))
    who = pairs.select(F.col("a").alias("d")).union(pairs.select("b")).distinct()
    entities = sets_n.groupBy("d").agg(F.min("doc_id").alias("doc_id"))
    sets = sets_of(docs, who, entities, near)
    first = settle(pairs.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("m")).select(F.col("m.a").alias("lead"), F.col("b").alias("d")))
    release(spark)
    members = first.union(first.select("lead", F.col("lead").alias("d")).distinct())
    links = settle(verified(nearest_pairs(members, sets, near), sets, near))
    comp = small(components(links))
    rest = pairs
    while True:
        release(spark)
        # Pairs within a component stay within one, so each round goes on with those that the last left.
        rest = settle(apart(rest, comp))
        reps = rest.join(comp.withColumnRenamed("node", "b"), "b", "left").groupBy(F.col("a").alias("lead"), F.coalesce("root", "b").alias("c")).agg(F.min("b").alias("d")).select("lead", "d")
        reps = settle(reps.union(rest.select(F.col("a").alias("lead"), F.col("a").alias("d")).distinct()))
        more = settle(apart(verified(nearest_pairs(reps, sets, near), sets, near), comp))
        joined = more.count()
        if joined:
            links = settle(links.unionAll(more))
            comp = small(components(links))
        if joined * near.progress <= reps.count():
            break
    release(spark)
    more = settle(verified(all_pairs(ties_, comp, sets, near), sets, near))
    if not more.isEmpty():
        comp = small(components(links.unionAll(more)))
    release(spark)
    rooted = sets_n.join(comp.select(F.col("node").alias("d"), "root"), "d", "left").withColumn("root", F.coalesce("root", "d"))
    least = rooted.where("n > 0").groupBy(F.col("root").alias("l_root")).agg(F.min("doc_id").alias("least"), F.count("*").alias("members")).where("members > 1")
    out = rooted.join(least, (F.col("root") == F.col("l_root")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), "d", "root")


def drop_near_duplicates(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id; repeated rows are one document."""
    docs = bounded_batches(docs)
    found = settle(near_duplicates(docs, near))
    release(docs.sparkSession)
    # Names that no column of the documents has.
    r_id, k_id, k_d, own_d = (unused(docs, x) for x in ("r_id", "k_id", "k_d", "own_d"))
    repeated = settle(found.groupBy(F.col("doc_id").alias(r_id)).agg(F.count("*").alias("rows")).where("rows > 1").select(r_id))
    gone = settle(found.where(~F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias(r_id)).union(repeated).distinct())
    text = F.col("text").cast("string")
    out = docs.withColumn("text", text).join(small(gone), F.col("doc_id").eqNullSafe(F.col(r_id)), "left_anti")
    if repeated.isEmpty():
        return out
    # Rows that share a doc_id are told apart by their sets.
    stay = found.where(F.col("component_id").eqNullSafe(F.col("doc_id"))).join(repeated, F.col("doc_id").eqNullSafe(F.col(r_id))).groupBy(F.col("doc_id").alias(k_id), "root").agg(F.min("d").alias(k_d)).select(k_id, k_d)
    at, schema = docs.columns.index("text"), docs.withColumn("text", text).schema.add(own_d, "long")

    @trimmed
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = pa.array([fingerprint(shingles(t, near.words)) for t in b.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, d], [*b.schema.names, own_d])

    several = docs.withColumn("text", text).join(small(repeated), F.col("doc_id").eqNullSafe(F.col(r_id)), "left_semi").mapInArrow(name, schema)
    kept = several.join(stay, F.col("doc_id").eqNullSafe(F.col(k_id)) & (F.col(own_d) == F.col(k_d)), "left_semi").dropDuplicates(["doc_id", own_d]).drop(own_d)
    return out.unionByName(kept)
