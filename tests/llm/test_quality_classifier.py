import math
import random
import zlib

import numpy as np
import xxhash

from quarry.llm.quality_classifier import META, SHAPES, CoTraining, Logistic, _views, content, exchange, learn, metadata, platt, quality


def corpus(n=500):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        w = [rng.choice(words[:300] if good else words[200:]) for _ in range(rng.randint(60, 120) if good else rng.randint(10, 70))]
        docs.append((i, " ".join(w) if good else " | ".join(w).upper(), "en", f"s{i % 5}"))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    odd = [(900, None, None, None), (901, "", "en", "s0"), (902, "...", "xx", None), (0, *docs[0][1:]), (903, "long " * 50_000, "en", "s1")]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame([*labels, (None, 1, 0), (5000, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality(d, lab).collect()
    assert len(rows) == len(docs) + len(odd) and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 500]
    assert np.mean([r["kept"] == (r["doc_id"] % 4 != 0) for r in held]) > 0.95
    assert sorted((r[0], r[2]) for r in quality(d, lab).collect()) == sorted((r[0], r[2]) for r in rows)


def test_views_are_apart():
    ids, w = content("Ab ab cd!", 64)
    assert abs(w[:-SHAPES] @ w[:-SHAPES] - 1) < 1e-9 and len(ids) <= 3 + SHAPES and ids.max() == 64 + SHAPES - 1
    ids, w = metadata("en", "s", 1000)
    assert len(ids) == 3 and ids.max() < META and list(metadata("en", "s", 1023)[0]) == list(ids) != list(metadata("en", "s", None)[0])


def test_the_exchange_is_as_by_brute_force(spark):
    """All documents that one view is sure of, and only they, teach the other view, in exact sums."""
    docs, labels = corpus(300)
    d = spark.createDataFrame([(*r, 10 * r[0], 5) for r in docs], "doc_id long, text string, lang string, source string, n_chars long, score int").repartition(5)
    p = CoTraining(features=256, sure=0.8, rounds=1)
    m = learn(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), p)
    got = exchange(_views(d), m, {4, 8}, p)
    want = {}
    for i, text, lang, source in docs:
        if zlib.crc32(str(i).encode()) % 3 == 1 or i in (4, 8):
            continue
        rows = [content(text, 256), metadata(lang, source, 10 * i)]
        for k, (view, a, b) in enumerate(m.views):
            prob = 1 / (1 + math.exp(-(a * (rows[k][1] @ view.w[rows[k][0]] + view.b) + b)))
            if max(prob, 1 - prob) >= 0.8:
                v = want.setdefault((1 - k, int(prob >= 0.5), xxhash.xxh3_64_intdigest(str(i)) % 2), [np.zeros(256 + SHAPES), 0])
                v[0][rows[1 - k][0]] += rows[1 - k][1]
                v[1] += 1
    assert len(want) == sum(map(len, got)) > 2
    for k, view in enumerate(got):
        for (label, n, (ids, mean)), (_, (total, count)) in zip(view, sorted(x for x in want.items() if x[0][0] == k), strict=True):
            dense = np.zeros(len(total))
            dense[ids] = mean
            assert n == count and np.allclose(dense, total / count, atol=1e-5)


def test_clashing_columns(spark):
    docs, labels = corpus(80)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d = spark.createDataFrame([(*r, 1, 2, "x") for r in docs], "doc_id long, text string, lang string, source string, quality int, held_out int, r string")
    assert sorted(r[0] for r in quality(d, lab).collect()) == list(range(80))


def test_fits():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] > 0).astype(int)
    m = Logistic(3).fit(list(x), y, np.ones(400))
    assert np.mean([(m.logit(r) > 0) == t for r, t in zip(x, y, strict=True)]) > 0.95
    a, b = platt(np.array([-2, -1, 1, 2.0]), np.array([0, 0, 1, 1]), np.ones(4))
    assert a > 0.2 and abs(b) < 0.5


def test_no_labels(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality(d, none).first()["score"] == 0 and quality(d.where("doc_id < 0"), none).count() == 0
    assert not learn(d, spark.createDataFrame([(0, 1, 1)], "doc_id long, quality int, toxic int"), CoTraining()).views


def test_views_teach_each_other_where_metadata_tells(spark):
    """Few labels, many words, sources that tell: the exchange makes the content view right more often on rows that are held out."""
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(1500):
        good = rng.random() < 0.5
        text = " ".join(("g" if good else "b") + "abcdefghij"[rng.randrange(10)] + "abcdefghijklmnopqrst"[rng.randrange(20)] for _ in range(4)) + " " + " ".join(f"w{rng.randrange(60)}" for _ in range(12))
        docs.append((i, text, "en", f"{'fine' if good else 'poor'}{rng.randrange(3)}", 100))
        labels.append((i, int(good)))
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    few = [x for x in labels if x[0] not in set(held)][:60]
    lab = spark.createDataFrame([(i, y, 0) for i, y in few], "doc_id long, quality int, toxic int")
    truth, right = dict(labels), {}
    for rounds in (0, 2):
        model = learn(df, lab, CoTraining(rounds=rounds, sure=0.8))
        view, a, b = model.views[0]
        right[rounds] = sum((a * view.logit(content(docs[i][1], model.size)) + b > 0) == bool(truth[i]) for i in held) / len(held)
    assert right[2] > right[0] + 0.05
