"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Examples are a bounded, hash-chosen sample of labelled documents (``per_class`` of each class; the labels alone are looked at to choose
them). All lower-cased words of the examples are terms, of either class. A term weighs (1 + log tf) * idf * (1 + G2): document frequencies
are counted over all documents, and G2, the log-likelihood ratio of term and class among the examples, lets words that tell the classes
apart weigh more. How much more was chosen by cross-validation over the labels that may be learnt from (``cross_validated``). A document's norm is over all its words; one that no example holds has the idf of a word of no document and no G2.

The examples form an inverted index whose postings are cut into blocks of examples, with each term's largest weight per block. A document's
terms times those maxima bound every block's cosines, so blocks are scored exactly in falling order of their bound until none can reach
the k-th neighbour. Neighbours vote with the square of their cosine, times what one example stands for in its class; an isotonic fit of
leave-one-out votes turns the share of toxic votes into a probability. The neighbours are returned as evidence. The index is broadcast:
terms are 64-bit hashes, and there are at most 2 * per_class examples.

Defined cases: a null or wordless text, or one without a word of any example, scores as such examples do; labels without a document or
with a null label are not learnt from; a document labelled twice counts as toxic if any label says so; of several texts with one doc_id
the greatest is the example; equal cosines go to the earlier example; without labelled examples of both classes every score is the share
of the one class there is, or 0; repeated rows each give a row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, trimmed

WORD = re.compile(r"[^\W\d_]+")
SLICE = 128
Terms = tuple[np.ndarray, np.ndarray]  # sorted hashes, and how often each occurs


@dataclass(frozen=True)
class Votes:
    per_class: int = 1500
    neighbours: int = 15
    #: Examples in one block of the index.
    block: int = 64
    #: A term in more than one of so many examples has a row of all examples in place of postings.
    common: int = 16
    #: Blocks that are scored between two looks at the bounds.
    step: int = 16
    #: Votes of the class shares that every document has besides its neighbours.
    prior_votes: float = 0.05
    threshold: float = 0.7
    #: How much the log-likelihood ratio of a term and the class raises its weight; see ``WEIGHINGS`` and ``cross_validated``.
    weighing: str = "whole"


#: Factors on the idf of a term, by its log-likelihood ratio G2.
WEIGHINGS = {"none": lambda g2: np.ones(len(g2)), "log": lambda g2: 1 + np.log1p(g2), "root": lambda g2: np.sqrt(1 + g2), "whole": lambda g2: 1 + g2, "square": lambda g2: (1 + g2) ** 2}


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def terms(text: str | None) -> Terms:
    """The hashes of the text's words, and how often each occurs."""
    words = Counter(WORD.findall((text or "").lower()))
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    by = np.argsort(h)
    return h[by], np.fromiter(words.values(), np.int64, len(words))[by]


def ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    n = end - start
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


class Index:
    """Examples' weights by term and block, and the votes."""

    def __init__(self, params: Votes, prior: float) -> None:
        self.params, self.prior, self.ids = params, prior, []
        self.vocab, self.weights, self.unseen = np.zeros(0, np.uint64), np.zeros(0), 1.0
        self.steps = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def fit(self, vocab: np.ndarray, df: np.ndarray, n_docs: int, examples: list[tuple[object, Terms, int]], stands_for: dict[int, float]) -> Index:
        self.vocab, label = vocab, np.array([y for _, _, y in examples])
        at = [np.searchsorted(vocab, t[0]) for _, t, _ in examples]
        held = [np.bincount(np.concatenate([a for a, y in zip(at, label, strict=True) if y == k]), minlength=len(vocab)) for k in (0, 1)]
        self.weights = (np.log((1 + n_docs) / (1 + df)) + 1) * WEIGHINGS[self.params.weighing](likelihood_ratio(held[1], held[0], (label == 1).sum(), (label == 0).sum()))
        self.unseen = math.log(1 + n_docs) + 1
        vectors = [self.vector(t) for _, t, _ in examples]
        # Examples whose strongest term is the same share blocks, which keeps the blocks' maxima apart.
        order = sorted(range(len(examples)), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]) if len(vectors[i][0]) else len(vocab), i))
        self.ids = [examples[i][0] for i in order]
        self.toxic = label[order].astype(np.float64)
        self.weight = np.array([stands_for[y] for y in label[order]])
        vectors = [vectors[i] for i in order]
        n, size = len(order), self.params.block
        self.blocks = -(-n // size)
        t, e, w = np.concatenate([v[0] for v in vectors]), np.repeat(np.arange(n, dtype=np.int32), [len(v[0]) for v in vectors]), np.concatenate([v[1] for v in vectors])
        by = np.lexsort((e, t))
        t, self.post_e, self.post_w = t[by], e[by], w[by]
        # The postings of terms that many examples hold are written out as rows with a place for every example.
        rows = np.flatnonzero(np.bincount(t, minlength=len(vocab)) * self.params.common > n)
        self.row_of = np.full(len(vocab), -1, np.int32)
        self.row_of[rows] = np.arange(len(rows))
        self.rows = np.zeros((len(rows), self.blocks * size))
        full = self.row_of[t] >= 0
        self.rows[self.row_of[t[full]], self.post_e[full]] = self.post_w[full]
        t, self.post_e, self.post_w = t[~full], self.post_e[~full], self.post_w[~full]
        # A cell holds a term's postings in one block.
        cell = t * self.blocks + self.post_e // size
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        self.cell_block = (cell[first] % self.blocks).astype(np.int32)
        self.cell_post = np.append(first, len(cell))
        self.cell_most = np.maximum.reduceat(self.post_w, first) if len(first) else np.zeros(0)
        self.term_cell = np.searchsorted(t[first], np.arange(len(vocab) + 1))
        raw = np.array([self.share(*self.nearest(*vectors[i], c, i)) for at in range(0, n, SLICE) for i, c in enumerate(self.common(vectors[at : at + SLICE]), at)])
        self.steps = isotonic(raw, self.toxic, self.weight)
        return self

    def vector(self, words: Terms) -> tuple[np.ndarray, np.ndarray]:
        """Places in the vocabulary and weights, of unit length over all words."""
        h, n = words
        at = np.searchsorted(self.vocab, h)
        known = np.zeros(len(h), bool) if not len(self.vocab) else self.vocab[np.minimum(at, len(self.vocab) - 1)] == h
        tf = 1 + np.log(n.astype(np.float64))
        ids, rest = at[known], tf[~known] * self.unseen
        w = tf[known] * self.weights[ids]
        norm = math.sqrt(float(w @ w) + float(rest @ rest))
        return ids, w / norm if norm else w

    def common(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the common terms add to the cosines of each vector with every example."""
        w = np.zeros((len(vectors), len(self.rows)))
        for i, (ids, v) in enumerate(vectors):
            row = self.row_of[ids]
            w[i, row[row >= 0]] = v[row >= 0]
        return w @ self.rows

    def nearest(self, ids: np.ndarray, w: np.ndarray, common: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples with the largest positive cosines, exactly; ties go to the earlier example."""
        k, size, step = self.params.neighbours, self.params.block, self.params.step
        best_e, best_s = np.zeros(0, np.int64), np.zeros(0)
        if not len(ids) or not self.ids:
            return best_e, best_s
        start, end = self.term_cell[ids], self.term_cell[ids + 1]
        cells, weight = ranges(start, end), np.repeat(w, end - start)
        block = self.cell_block[cells]
        bound = common.reshape(self.blocks, size).max(1) + np.bincount(block, self.cell_most[cells] * weight, self.blocks)
        order = np.argsort(-bound, kind="stable")
        for at in range(0, self.blocks, step):
            now = order[at : at + step]
            if bound[now[0]] <= 0 or len(best_s) == k and bound[now[0]] < best_s[-1] - 1e-12:
                break
            wanted = np.zeros(self.blocks, bool)
            wanted[now] = True
            mine = np.flatnonzero(wanted[block])
            from_, to = self.cell_post[cells[mine]], self.cell_post[cells[mine] + 1]
            post = ranges(from_, to)
            sims = np.bincount(self.post_e[post], self.post_w[post] * np.repeat(weight[mine], to - from_), self.blocks * size)
            sims = np.where(np.repeat(wanted, size), sims + common, 0)
            if without >= 0:
                sims[without] = 0
            hit = np.flatnonzero(sims > 0)
            e, s = np.concatenate([best_e, hit]), np.concatenate([best_s, sims[hit]])
            if len(s) > 8 * k:
                few = s >= np.partition(s, -k)[-k]
                e, s = e[few], s[few]
            top = np.lexsort((e, -s))[:k]
            best_e, best_s = e[top], s[top]
        return best_e, best_s

    def share(self, e: np.ndarray, s: np.ndarray) -> float:
        v = s * s * self.weight[e] if len(e) else np.zeros(0)
        a = self.params.prior_votes
        return (float(v @ self.toxic[e]) + a * self.prior) / (float(v.sum()) + a) if len(e) else self.prior

    def scores(self, texts: list[str | None]) -> list[tuple[float, str]]:
        """The probability of label 1, and the evidence, of each text."""
        if not self.ids:
            return [(self.prior, "")] * len(texts)
        vectors, out = [self.vector(terms(t)) for t in texts], []
        for v, c in zip(vectors, self.common(vectors), strict=True):
            e, s = self.nearest(*v, c)
            p = float(np.interp(self.share(e, s), *self.steps))
            out.append((min(1.0, max(0.0, p)), ",".join(f"{self.ids[i]}:{int(self.toxic[i])}:{x:.3f}" for i, x in zip(e[:3], s[:3], strict=True))))
        return out


def likelihood_ratio(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """G2 of each term and the class: a of n1 toxic and b of n0 other examples hold the term."""
    out, n = np.zeros(len(a)), n1 + n0
    for seen, of_class, held in ((a, n1, True), (b, n0, True), (n1 - a, n1, False), (n0 - b, n0, False)):
        expected = (a + b if held else n - a - b) * (of_class / n)
        some = seen > 0
        out[some] += 2 * seen[some] * np.log(seen[some] / expected[some])
    return np.maximum(out, 0)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the weighted monotone fit of y by x (pool adjacent violators): both ends of each pool."""
    pools: list[list[float]] = []  # weight, weighted y, first x, last x
    for v in np.unique(x):
        at = x == v
        pools.append([float(w[at].sum()), float(w[at] @ y[at]), float(v), float(v)])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    return np.array([x for p in pools for x in p[2:]]), np.repeat([p[1] / p[0] for p in pools], 2)


def learn(docs: DataFrame, labels: DataFrame, params: Votes = Votes()) -> Index:
    """The index of examples; held-out rows are not looked at."""
    docs = bounded_batches(docs)
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    known = labels.where(~is_held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1))
    of_class = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = of_class.get(1, 0) / max(1, sum(of_class.values()))
    index = Index(params, prior)
    if len(of_class) < 2:
        return index
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = known.where("toxic = 0").orderBy(order, "doc_id").limit(params.per_class).unionAll(known.where("toxic = 1").orderBy(order, "doc_id").limit(params.per_class))
    ids = chosen.collect()  # at most 2 * per_class ids
    few = docs.sparkSession.createDataFrame(ids, known.schema) if ids else chosen
    rows = own.join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    examples = [(r["doc_id"], (np.frombuffer(r["h"], np.uint64), np.frombuffer(r["n"], np.int64)), r["toxic"]) for r in _counted(rows).orderBy("doc_id").collect()]
    in_sample = Counter(y for _, _, y in examples)
    if len(in_sample) < 2:
        return index
    vocab = np.unique(np.concatenate([t[0] for _, t, _ in examples]))
    n_docs, df = document_frequencies(own, vocab)
    return index.fit(vocab, df, n_docs, examples, {y: of_class[y] / in_sample[y] for y in in_sample})


def _counted(rows: DataFrame) -> DataFrame:
    """doc_id, toxic, h, n: word counts of the examples, so that no text comes to the driver."""

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [terms(t) for at in range(0, b.num_rows, SLICE) for t in b.column(2).slice(at, SLICE).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([h.tobytes() for h, _ in found], pa.binary()), pa.array([n.tobytes() for _, n in found], pa.binary())], ["doc_id", "toxic", "h", "n"])

    return rows.mapInArrow(count, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, toxic int, h binary, n binary")


def document_frequencies(docs: DataFrame, vocab: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each term; each task sums up its counts first."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    size = len(vocab)

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = shared.value, np.zeros(size + 1, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                for text in b.column(0).slice(at, SLICE).to_pylist():
                    h = terms(text)[0]
                    i = np.minimum(np.searchsorted(known, h), size - 1) if size else np.zeros(0, np.int64)
                    seen[i[known[i] == h] if size else i] += 1
            seen[size] += b.num_rows
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["term", "n"])

    out = np.zeros(size + 1, np.int64)
    # A row a term at most.
    for b in docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow().to_batches():
        out[b.column(0).to_numpy()] = b.column(1).to_numpy()
    shared.destroy()
    return int(out[size]), out[:size]


def toxicity(docs: DataFrame, labels: DataFrame, params: Votes = Votes(), index: Index | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (id:label:cosine of the nearest three) of every document."""
    docs = bounded_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(index or learn(docs, labels, params))
    threshold = params.threshold

    @trimmed
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            scores, why = [], []
            for at in range(0, b.num_rows, SLICE):
                for s, e in model.scores(b.column(2).slice(at, SLICE).to_pylist()):
                    scores.append(s)
                    why.append(e)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(why, pa.string())], ["doc_id", "held_out", "score", "predicted", "evidence"])

    own = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(score, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int, evidence string")


def cross_validated(docs: DataFrame, labels: DataFrame, params: Votes = Votes(), weighings: tuple[str, ...] = tuple(WEIGHINGS), folds: int = 3) -> list[tuple[str, int, int, int]]:
    """(weighing, toxic documents found, documents called toxic, toxic documents) of each way to weigh, the best by F1 first.

    Only labels that may be learnt from take part: each fold of them is scored by what the other folds teach. Held-out labels are not read.
    """
    mine = labels.where(~is_held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    fold = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(folds))
    out = []
    for weighing in weighings:
        found = called = there = 0
        for k in range(folds):
            index = learn(docs, mine.where(fold != k), replace(params, weighing=weighing))
            asked = mine.where(fold == k).groupBy("doc_id").agg(F.max("toxic").alias("y"))
            scored = toxicity(docs.join(asked.select("doc_id"), "doc_id", "left_semi"), labels, params, index)
            r = scored.join(asked, "doc_id").agg(F.sum(F.col("predicted") * F.col("y")), F.sum("predicted"), F.sum("y")).first()
            found, called, there = found + (r[0] or 0), called + (r[1] or 0), there + (r[2] or 0)
        out.append((weighing, int(found), int(called), int(there)))
    return sorted(out, key=lambda r: -2 * r[1] / max(1, r[2] + r[3]))


def drop_toxic(docs: DataFrame, labels: DataFrame, params: Votes = Votes()) -> DataFrame:
    """``docs`` without the documents that are predicted toxic; the others stay as they are."""
    docs = bounded_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, params))
    give_back()  # the driver goes on without the examples
    at, threshold = docs.columns.index("text"), params.threshold

    @trimmed
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            ok = [s < threshold for k in range(0, b.num_rows, SLICE) for s, _ in model.scores(b.column(at).slice(k, SLICE).to_pylist())]
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
