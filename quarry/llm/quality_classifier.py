"""Quality by co-training two views: the text's content, and the page's metadata.

The content view is a logistic regression on hashed words and shape counts of the text (length, lines, case, digits, symbols, word
length); the metadata view is one on lang, source and n_chars, and never reads the text. Both learn from a bounded, hash-chosen sample
of labelled documents that are not held out. Then they exchange pseudo-labels for ``rounds``: in a pass over all other documents that are not held out,
every document that one view is sure of, by its calibrated probability, teaches the other view. What a view is taught comes to the
driver as the sums of its features by label and cell, in whole numbers, whatever the size of the corpus, and joins the sample as weighted
mean documents. Each view is calibrated on labelled documents that its training left out (Platt), the views' logits are
combined and calibrated on the same ones, and every document is scored where it is read.

Defined cases: a null or wordless text has only shape counts; null lang, source and n_chars are values of their own; of several rows with
one doc_id the greatest (text, lang, source, n_chars) is the example; equal scores need no order; without labels of both classes every
score is the share of the one class there is, or 0; repeated rows each give a row; an empty table gives an empty result; other columns
are not read.
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

from .common import bounded_batches, column_or_null, trimmed
from .toxicity import is_held_out

WORD = re.compile(r"[^\W\d_]+|[#*$%&|<>!?]")
SHAPES = 14
META = 64 + 32  # hashed lang and source, and powers of two of n_chars
#: Sums of features are whole multiples of its inverse, so their order does not matter.
UNIT = 1 << 20


@dataclass(frozen=True)
class CoTraining:
    per_class: int = 1500
    rounds: int = 2
    #: Calibrated probability from which a view teaches the other.
    sure: float = 0.95
    #: Share of a class's weight that what was taught may have.
    trust: float = 0.25
    #: Mean documents that a label is taught by.
    cells: int = 2
    features: int = 1 << 14
    threshold: float = 0.5

    @property
    def sizes(self) -> tuple[int, int]:
        return self.features + SHAPES, META


def content(text: str | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words with square-rooted frequencies, of unit length, then the shape counts."""
    shape = shapes(text)
    words = WORD.findall((text or "").lower())
    digest = xxhash.xxh3_64_intdigest
    ids, n = np.unique(np.array([digest(w) for w in words], np.uint64) % np.uint64(size), return_counts=True)
    w = np.sqrt(n)
    return np.concatenate([ids.astype(np.int64), np.arange(size, size + SHAPES)]), np.concatenate([w / np.sqrt(max(1.0, w @ w)), shape])


def shapes(text: str | None) -> np.ndarray:
    """Logs and shares of counts of the text."""
    out = np.zeros(SHAPES)
    t = text or ""
    if not t:
        out[0] = 0.5
        return out
    c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(c)
    blank = (c == 32) | ((c >= 9) & (c <= 13))
    words = max(1, int((~blank & np.concatenate([[True], blank[:-1]])).sum()))
    lines = t.split("\n")
    share = lambda x: float(np.count_nonzero(x)) / n
    out[1:] = [
        np.log1p(n) / 10, np.log1p(words) / 8, np.log1p(len(lines)) / 5, min(2.0, (n - np.count_nonzero(blank)) / words / 10),
        share((c >= 65) & (c <= 90)) * 3, share((c >= 48) & (c <= 57)) * 10, share(np.isin(c, np.frombuffer("#*$%&|<>".encode("utf-32-le"), np.uint32))) * 10,
        share((c == 33) | (c == 63)) * 10, share((c == 46) | (c == 44)) * 10, 1 - len(set(lines)) / len(lines), share(c > 127), min(2.0, words / len(lines) / 50), float(words < 50),
    ]
    return out / 2


def metadata(lang: str | None, source: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed lang and source, and the power of two of n_chars, each as one of its places."""
    size = 0 if n_chars is None or n_chars < 0 else min(31, int(n_chars).bit_length())
    ids = np.array([xxhash.xxh3_64_intdigest(f"lang {lang}") % 32, 32 + xxhash.xxh3_64_intdigest(f"source {source}") % 32, 64 + size])
    return ids, np.full(3, 0.6)


class Logistic:
    """L2-regularised, by gradient steps with momentum over all rows at once; rows are (ids, weights) or dense."""

    def __init__(self, size: int) -> None:
        self.w, self.b = np.zeros(size), 0.0

    def fit(self, rows: list, y: np.ndarray, weight: np.ndarray, steps: int = 150, rate: float = 4.0, ridge: float = 1e-4) -> Logistic:
        dense = not isinstance(rows[0], tuple)
        if dense:
            x = np.stack(rows)
        else:
            at, ids, v = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]), np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        weight = weight / weight.sum()
        rate = rate / 4 if dense else rate
        mw, mb = np.zeros_like(self.w), 0.0
        for _ in range(steps):
            z = (x @ self.w if dense else np.bincount(at, v * self.w[ids], len(rows))) + self.b
            d = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            g = (x.T @ d if dense else np.bincount(ids, v * d[at], len(self.w))) + ridge * self.w
            mw, mb = 0.9 * mw + g, 0.9 * mb + d.sum()
            self.w -= rate * mw
            self.b -= rate * 0.25 * mb
        return self

    def logit(self, row) -> float:
        return float((row[1] @ self.w[row[0]] if isinstance(row, tuple) else row @ self.w) + self.b)


def stacked(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slopes and intercept of the probabilities of y by the views' logits together (Newton steps, drawn towards half of each)."""
    x = np.column_stack([z, np.ones(len(z))])
    first = np.array([0.5] * z.shape[1] + [0.0])
    w = first.copy()
    weight = weight * len(y) / weight.sum()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w -= np.clip(np.linalg.solve(h, x.T @ (weight * (p - y)) + (w - first)), -2, 2)
    return w


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the probabilities of y by z, with the usual softened targets (Newton steps)."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([z, np.ones_like(z)], 1)
    ab = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        ab -= np.clip(np.linalg.solve(h, x.T @ (weight * (p - t)) + 1e-3 * (ab - [1, 0])), -2, 2)
    return max(float(ab[0]), 0.0), float(ab[1])


@dataclass
class Model:
    prior: float
    size: int
    views: list[tuple[Logistic, float, float]]
    #: Slopes of the views' logits and an intercept.
    both: np.ndarray | None = None

    def logits(self, text: str | None, lang: str | None, source: str | None, n_chars: int | None) -> tuple[list, list[float], list[float]]:
        """Each view's row, logit, and calibrated probability of label 1."""
        rows = [content(text, self.size), metadata(lang, source, n_chars)]
        z = [v.logit(row) for (v, _, _), row in zip(self.views, rows, strict=True)]
        return rows, z, [sigmoid(a * x + b) for (_, a, b), x in zip(self.views, z, strict=True)]

    def score(self, text: str | None, lang: str | None, source: str | None, n_chars: int | None) -> tuple[float, float, float]:
        """The combined probability of label 1, and each view's."""
        if not self.views:
            return self.prior, self.prior, self.prior
        _, z, p = self.logits(text, lang, source, n_chars)
        return sigmoid(float(self.both[:-1] @ z + self.both[-1])), *p


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-min(30.0, max(-30.0, x)))))


def learn(docs: DataFrame, labels: DataFrame, params: CoTraining = CoTraining()) -> Model:
    """Held-out rows are not looked at; features of at most 2 * per_class labelled documents come to the driver."""
    own = _views(docs)
    known = labels.where(~is_held_out(F.col("doc_id")) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    of_class = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    prior = of_class.get(1, 0) / max(1, sum(of_class.values()))
    if len(of_class) < 2:
        return Model(prior, params.features, [])
    order = F.md5(F.col("doc_id").cast("string"))
    few = known.where("quality = 0").orderBy(order, "doc_id").limit(params.per_class).unionAll(known.where("quality = 1").orderBy(order, "doc_id").limit(params.per_class)).collect()
    chosen = own.sparkSession.createDataFrame(few, known.schema)
    each = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.max(F.struct("text", "lang", "source", "n_chars")).alias("r")).select("doc_id", "quality", "r.*")
    rows = _featured(each, params).orderBy(order, "doc_id").collect()
    y = np.array([r["quality"] for r in rows])
    if len(set(y.tolist())) < 2:
        return Model(prior, params.features, [])
    x = [[(np.frombuffer(r[f"i{k}"], np.int64), np.frombuffer(r[f"w{k}"])) for r in rows] for k in (0, 1)]
    stands_for = np.array([of_class[k] / (y == k).sum() for k in y])
    fit = np.arange(len(y)) % 4 != 0  # the rest calibrates; rows come in hash order
    if len(set(y[fit].tolist())) < 2 or len(set(y[~fit].tolist())) < 2:
        fit = np.ones(len(y), bool)
    cal = ~fit if not fit.all() else fit
    taught: list[list[tuple[int, int, tuple[np.ndarray, np.ndarray]]]] = [[], []]  # of each view: label, documents, their mean
    for step in range(params.rounds + 1):
        parts, logits = [], []
        for k, size in enumerate(params.sizes):
            view = Logistic(size).fit(*_weighed([x[k][i] for i in np.flatnonzero(fit)], y[fit], taught[k], params))
            z = np.array([view.logit(x[k][i]) for i in np.flatnonzero(cal)])
            logits.append(z)
            parts.append((view, *platt(z, y[cal], stands_for[cal])))
        model = Model(prior, params.features, parts, stacked(np.column_stack(logits), y[cal], stands_for[cal]))
        if step < params.rounds:
            taught = exchange(own, model, {r["doc_id"] for r in rows}, params)
    return model


def _weighed(rows: list, y: np.ndarray, taught: list, params: CoTraining) -> tuple[list, np.ndarray, np.ndarray]:
    """Rows, labels and weights to fit: classes weigh the same here (calibration brings their shares back), and so many of that the mean documents."""
    weight = np.where(y == 1, 1 / max(1, (y == 1).sum()), 1 / max(1, (y == 0).sum()))
    more = []
    for label in (0, 1):
        n = sum(t[1] for t in taught if t[0] == label)
        if n:
            weight[y == label] *= 1 - params.trust
            more += [params.trust * t[1] / n for t in taught if t[0] == label]
    taught = sorted(taught, key=lambda t: t[0])  # as ``more`` has them
    return rows + [t[2] for t in taught], np.concatenate([y, np.array([t[0] for t in taught], int)]), np.concatenate([weight, more])


def _featured(rows: DataFrame, params: CoTraining) -> DataFrame:
    """doc_id, quality, and places and weights of both views, so that no text comes to the driver."""

    @trimmed
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(content(t, params.features), metadata(*m)) for t, *m in zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True)]
            cols = [pa.array([f[k][part].astype(np.float64 if part else np.int64).tobytes() for f in found], pa.binary()) for k in (0, 1) for part in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["doc_id", "quality", "i0", "w0", "i1", "w1"])

    return rows.mapInArrow(make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, quality int, i0 binary, w0 binary, i1 binary, w1 binary")


def exchange(own: DataFrame, model: Model, examples: set, params: CoTraining) -> list[list[tuple[int, int, tuple[np.ndarray, np.ndarray]]]]:
    """What each view is taught by all documents that the other is sure of: (label, documents, mean features) by label and cell."""
    shared = own.sparkSession.sparkContext.broadcast((model, examples))

    @trimmed
    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value
        sums = [np.zeros((2, params.cells, size + 1), np.int64) for size in params.sizes]  # the last place counts documents
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for doc, *row in zip(*(part.column(k).to_pylist() for k in range(5)), strict=True):
                    if doc in known:
                        continue
                    rows, _, p = m.logits(*row)
                    cell = xxhash.xxh3_64_intdigest(str(doc)) % params.cells
                    for k in (0, 1):
                        if max(p[k], 1 - p[k]) >= params.sure:
                            ids, w = rows[1 - k]
                            to = sums[1 - k][int(p[k] >= 0.5), cell]
                            to[ids] += np.rint(w * UNIT).astype(np.int64)
                            to[-1] += 1
        for view, s in enumerate(sums):
            label, cell, place = np.nonzero(s)
            n = len(place)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, view, np.int32)), pa.array(label.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(s[label, cell, place])], ["view", "label", "cell", "place", "n"])

    seen = own.where(~is_held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    # A row for each place of a mean document at most.
    t = seen.mapInArrow(teach, "view int, label int, cell int, place int, n long").groupBy("view", "label", "cell", "place").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    view, label, cell, place, n = (t.column(k).to_numpy() for k in range(5))
    out: list[list[tuple[int, int, tuple[np.ndarray, np.ndarray]]]] = [[], []]
    for k, size in enumerate(params.sizes):
        for lab in (0, 1):
            for c in range(params.cells):
                mine = (view == k) & (label == lab) & (cell == c)
                docs = int(n[mine & (place == size)].sum())
                if docs:
                    at = np.flatnonzero(mine & (place < size))
                    at = at[np.argsort(place[at])]
                    out[k].append((lab, docs, (place[at].astype(np.int64), n[at] / UNIT / docs)))
    return out


def _views(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), column_or_null(docs, "lang", "string").alias("lang"), column_or_null(docs, "source", "string").alias("source"), column_or_null(docs, "n_chars", "long").alias("n_chars"))


def quality(docs: DataFrame, labels: DataFrame, params: CoTraining = CoTraining(), model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, content_score, metadata_score, kept of every document."""
    docs = bounded_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model or learn(docs, labels, params))

    @trimmed
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = []
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                s += [m.score(*r) for r in zip(*(part.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True)]
            cols = [pa.array([r[k] for r in s], pa.float64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols, pa.array([r[0] >= params.threshold for r in s], pa.bool_())], ["doc_id", "held_out", "score", "content_score", "metadata_score", "kept"])

    own = _views(docs).withColumn("held_out", is_held_out(F.col("doc_id"))).select("doc_id", "held_out", "text", "lang", "source", "n_chars")
    return own.mapInArrow(score, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, content_score double, metadata_score double, kept boolean")
