import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm.toxicity import Index, Votes, cross_validated, drop_toxic, isotonic, learn, terms, toxicity

BAD = ["blorg", "snarfle", "vexxit"]


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(BAD) + rng.choice(["", "us", "ing"])
        docs.append((i, " ".join(w), "x"))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_nearest_is_exact():
    rng = np.random.default_rng(1)
    vocab = np.arange(40, dtype=np.uint64) * 7 + 3

    def draw():
        ids = np.sort(rng.choice(45, rng.integers(0, 12), replace=False))  # five of them no example holds
        return ids.astype(np.uint64) * np.uint64(7) + np.uint64(3), rng.integers(1, 4, len(ids))

    known = lambda t: (t[0][t[0] <= vocab[-1]], t[1][t[0] <= vocab[-1]])
    examples = [(i, known(draw()), i % 3 == 0) for i in range(203)]
    ix = Index(Votes(block=8, neighbours=7, step=2, common=8), 0.5).fit(vocab, rng.integers(1, 90, 40), 100, examples, {0: 1.0, 1: 1.0})
    assert 0 < len(ix.rows) < 40
    by_id = {i: ix.vector(c) for i, c, _ in examples}
    dense = np.zeros((203, 40))
    for row, i in enumerate(ix.ids):
        dense[row, by_id[i][0]] = by_id[i][1]
    for _ in range(60):
        ids, w = ix.vector(draw())
        q = np.zeros(40)
        q[ids] = w
        sims = dense @ q
        best = [i for i in np.lexsort((np.arange(203), -np.round(sims, 12))) if sims[i] > 1e-12][:7]
        e, s = ix.nearest(ids, w, ix.common([(ids, w)])[0])
        assert np.allclose(s, sims[best]) and len(s) == len(best)


def test_whole_table_is_as_by_brute_force(spark):
    """Document frequencies, weights, neighbours, votes and calibrated scores by plain dictionaries and loops."""
    docs, labels = corpus(240, 8)
    p = Votes(neighbours=5)
    rows = toxicity(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), p).collect()
    counts = {i: Counter(re.findall(r"[^\W\d_]+", t.lower())) for i, t, _ in docs}
    label = {i: y for i, _, y in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    df = Counter(w for c in counts.values() for w in c)
    n1, n = sum(label.values()), len(label)

    def g2(w):
        a, b = (sum(w in counts[i] for i in label if label[i] == y) for y in (1, 0))
        cells = [(a, (a + b) * n1 / n), (b, (a + b) * (n - n1) / n), (n1 - a, (n - a - b) * n1 / n), (n - n1 - b, (n - a - b) * (n - n1) / n)]
        return max(0.0, sum(2 * o * math.log(o / x) for o, x in cells if o))

    seen = {w for i in label for w in counts[i]}
    weight = {w: (math.log((1 + len(docs)) / (1 + df[w])) + 1) * (1 + g2(w)) for w in seen}
    top = math.log(1 + len(docs)) + 1
    vector = {}
    for i, c in counts.items():
        v = {w: (1 + math.log(k)) * weight.get(w, top) for w, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vector[i] = {w: x / norm for w, x in v.items()}

    def share(i, own):
        near = sorted(((sum(x * vector[e].get(w, 0) for w, x in vector[i].items() if w in seen), e) for e in label if e != own), key=lambda r: -r[0])[: p.neighbours]
        near = [(s, e) for s, e in near if s > 0]
        return (sum(s * s * label[e] for s, e in near) + p.prior_votes * n1 / n) / (sum(s * s for s, _ in near) + p.prior_votes), near

    knots = isotonic(np.array([share(i, i)[0] for i in sorted(label)]), np.array([float(label[i]) for i in sorted(label)]), np.ones(n))
    for r in rows:
        raw, near = share(r["doc_id"], None)
        assert abs(r["score"] - np.interp(raw, *knots)) < 1e-6 and r["predicted"] == int(r["score"] >= 0.7)
        assert [float(e.split(":")[2]) for e in r["evidence"].split(",")] == pytest.approx([s for s, _ in near[:3]], abs=6e-4)


def test_isotonic():
    x, y = isotonic(np.array([0, 1, 2, 3.0]), np.array([0, 1, 0, 1.0]), np.ones(4))
    assert list(y) == [0, 0, 0.5, 0.5, 1, 1] and list(x) == [0, 0, 1, 2, 3, 3]


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    odd = [(1000, None, None), (1001, "", "x"), (1002, "... 12", "x"), (1003, "snarfleing " * 9000, "x"), (0, docs[0][1], "x")]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string, toxic string")
    lab = spark.createDataFrame([*labels, (0, 1, 1), (5000, 1, 1), (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity(d, lab).collect()
    assert len(rows) == len(docs) + len(odd)
    truth = {i: t for i, _, t in labels}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 80 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    by = {r["doc_id"]: r for r in rows}
    assert by[1003]["predicted"] == 1 and by[1000]["predicted"] == by[1001]["predicted"] == 0 and 0 <= by[1002]["score"] <= 1
    kept = {r["doc_id"] for r in drop_toxic(d, lab).collect()}
    assert kept == {r["doc_id"] for r in rows if not r["predicted"]}


def test_no_labels(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity(d, none).first()["score"] == 0
    assert toxicity(d.where("doc_id < 0"), none).count() == 0
    assert learn(d, spark.createDataFrame([(0, 1, 1)], "doc_id long, quality int, toxic int")).prior in (0.0, 1.0)
    h, n = terms("Ab, ab! Longer")
    assert sorted(n) == [1, 2] and (np.diff(h.view(np.int64) >> 1) != 0).all() and len(terms(None)[0]) == 0


def test_empty_stage_and_clashing_columns(spark):
    docs, labels = corpus(60)
    d = spark.createDataFrame([(i, t, "x", "y", 3) for i, t, _ in docs], "doc_id long, text string, held_out string, score string, toxic int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert drop_toxic(d, lab).schema == d.schema and drop_toxic(d.where("doc_id < 0"), lab).count() == 0


def test_cross_validation_reads_no_held_out_label(spark):
    docs, labels = corpus(150, 5)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    flipped = [(i, q, 1 - y if held(i) else y) for i, q, y in labels]
    runs = [cross_validated(df, spark.createDataFrame(lab, "doc_id long, quality int, toxic int"), Votes(per_class=50), ("none", "whole")) for lab in (labels, flipped)]
    assert runs[0] == runs[1] and {r[0] for r in runs[0]} == {"none", "whole"}
    assert all(r[3] == sum(y for i, _, y in labels if not held(i)) for r in runs[0])
