import random
import re

import numpy as np

from quarry.llm.common import components
from quarry.llm.ngram_join import Bands, Near, bitmap, dual, folded, near_duplicates, signatures


def brute(docs, near):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(near.words, len(w))
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()

    s = [grams(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if s[i] and s[j] and near.den * len(s[i] & s[j]) >= near.num * len(s[i] | s[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((str(d), len(s[i]), str(least.get(root(i)) if s[i] else d)) for i, (d, _) in enumerate(docs))


def corpus(seed, n=160):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 3)))
    base = [[word() for _ in range(rng.choice([1, 3, 12, 40, 90, 200]))] for _ in range(12)]
    docs = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6, 12])):
            at = rng.randrange(len(w) + 1)
            if rng.random() < 0.5:
                w.insert(at, word())
            elif len(w) > 1:
                w.pop(at - 1)
        docs.append((rng.randrange(1000), rng.choice([" ", "\n", "  "]).join(w) if rng.random() < 0.9 else " ".join(w).upper()))
    return docs


def test_equals_brute_force(spark):
    for seed, near in ((1, Near(words=3, num=90, block=8)), (2, Near(block=8, fanout=2)), (3, Near(words=1, num=50, block=512))):
        docs = [*corpus(seed), (5000, None), (5001, ""), (5002, " \t"), (5003, "one"), (5004, "ONE"), (None, "one"), (None, None), (5005, "x y"), (5005, "x y"), (5006, " ".join(f"w{i}" for i in range(30_000))), (5007, " ".join(f"w{i}" for i in range(29_000)))]
        df = spark.createDataFrame([(*d, "e", 1) for d in docs], "doc_id long, text string, component_id string, root int")
        got = sorted((str(r[0]), r[1], str(r[2])) for r in near_duplicates(df, near).collect())
        assert got == brute(docs, near)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(7)
    for near in (Near(num=90), Near(num=80), Near(num=50)):
        for n in [1, 2, 3, 5, 8, 11, 19, 20, 40, 100, 333]:
            for _ in range(60):
                x = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
                drop, add = rng.integers(0, n // 5 + 2), rng.integers(0, n // 5 + 2)
                y = np.concatenate([x[drop:], rng.integers(0, 1 << 63, add).astype(np.uint64) * np.uint64(2) + np.uint64(1)])
                x, y = np.unique(x), np.unique(y)
                both = len(np.intersect1d(x, y))
                if len(y) and near.den * both >= near.num * (len(x) + len(y) - both):
                    assert len(np.intersect1d(signatures(x, Bands(near)), signatures(y, Bands(near))))


def test_sets_do_not_meet_in_empty_parts():
    rng = np.random.default_rng(9)
    near = Near()
    held = {}
    for i in range(3000):
        for x in signatures(np.unique(rng.integers(0, 1 << 62, rng.integers(5, 120)).astype(np.uint64)), Bands(near)).tolist():
            held.setdefault(x, set()).add(i)
    assert max(map(len, held.values())) == 1


def test_trees_lose_no_link():
    rng = np.random.default_rng(2)
    near = Near(num=80, fanout=3)
    for trial in range(20):
        base = [rng.integers(0, 1 << 62, 60).astype(np.uint64) for _ in range(4)]
        sets = [np.unique(np.concatenate([b[rng.random(60) > rng.choice([0.02, 0.1, 0.3])], rng.integers(0, 1 << 62, rng.integers(0, 8)).astype(np.uint64)])) for b in base for _ in range(15)]
        maps = [bitmap(s) for s in sets]
        size = min(map(len, maps))
        bits, n = np.stack([folded(m, size) for m in maps]), np.array([len(s) for s in sets])
        comp = np.arange(60) if trial % 2 else rng.integers(0, 9, 60)
        shard = rng.integers(0, 1 + trial % 3, 60) * 7 - 3
        half = (n[:30], bits[:30], comp[:30], shard[:30]), (n[30:], bits[30:], comp[30:], shard[30:])
        within = set(zip(*(x.tolist() for x in dual((n, bits, comp, shard), None, near)), strict=True))
        across = set(zip(*(x.tolist() for x in dual(*half, near)), strict=True))
        assert len(within) < 900 and all(i < j and shard[i] == shard[j] for i, j in within)
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                c = len(np.intersect1d(x, y))
                if comp[i] != comp[j] and shard[i] == shard[j] and near.den * c >= near.num * (len(x) + len(y) - c):
                    assert (min(i, j), max(i, j)) in within
                    assert not i < 30 <= j or (i, j - 30) in across


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    up = {}
    root = lambda i: i if up.setdefault(i, i) == i else root(up[i])
    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    for solo in (0, 20, 1000):
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), solo).collect()}
        assert got == {i: root(i) for i in up}


def test_one_of_each_group_stays(spark):
    from quarry.llm.ngram_join import drop_near_duplicates

    long = " ".join(f"w{i}" for i in range(100))
    rows = [(3, long, "a"), (1, long + " more", None), (2, "quite other words here now", "b"), (4, None, "c"), (5, "", None), (7, "same row of words here", "x"), (7, "same row of words here", "x"), (7, "a different text under one id", "y"), (8, "A DIFFERENT text under one id", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, d string")
    out = drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted((r[0], r[1] or "") for r in out.collect()) == sorted([(1, long + " more"), (2, rows[2][1]), (4, ""), (5, ""), (7, rows[5][1]), (7, rows[7][1])])
    assert drop_near_duplicates(df.where("doc_id < 6")).count() == 4


def test_every_link_comes_out_of_a_tree(spark, monkeypatch):
    from quarry.llm import ngram_join

    df = spark.createDataFrame(corpus(1, 60), "doc_id long, text string")
    linked = lambda: near_duplicates(df, Near(words=3, num=90)).where("root <> d").count()
    assert linked() > 0
    empty = np.zeros(0, np.int64)
    monkeypatch.setattr(ngram_join, "dual", lambda one, two, near: (empty, empty))
    assert len(ngram_join.nearest(np.array([5, 5]), np.ones((2, 1), np.uint64), np.zeros(2, int), Near())[0]) == 0
    # What the workers call is sent to them with these in place.
    monkeypatch.setattr(ngram_join, "nearest", lambda n, bits, shard, near: (empty, empty))
    assert linked() == 0


def test_nearest_takes_a_pair_for_each_set():
    rng = np.random.default_rng(3)
    from quarry.llm.ngram_join import nearest

    base = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(200) > 0.02], rng.integers(0, 1 << 62, 2).astype(np.uint64)])) for _ in range(90)]
    a, b = nearest(np.array([len(s) for s in sets]), np.stack([bitmap(s)[:16] for s in sets]), np.arange(90) // 45, Near())
    assert sorted(b) == [i for i in range(90) if i % 45] and (a < b).all() and (a // 45 == b // 45).all()


def test_clashing_columns_and_empty_stage(spark):
    from quarry.llm.ngram_join import drop_near_duplicates

    rows = [(1, "a b c", 1, 2, 3, 4), (1, "a b c", 1, 2, 3, 4), (2, "A b c", 5, 6, 7, 8), (3, "d", 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, r_id long, k_id long, k_d long, own_d long")
    assert sorted(tuple(r) for r in drop_near_duplicates(df).collect()) == [rows[0], rows[3]]
    empty = drop_near_duplicates(df.where("doc_id < 0"))
    assert empty.columns == df.columns and empty.count() == 0


def test_bitmaps_bound_the_overlap():
    from quarry.llm.ngram_join import bitmap, common, most_common

    rng = np.random.default_rng(5)
    for n in (1, 5, 60, 400):
        for _ in range(40):
            x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.random()], rng.integers(0, 1 << 63, rng.integers(1, n + 2)).astype(np.uint64)]))
            assert common(x, y) <= most_common(bitmap(x), len(x), bitmap(y), len(y)) <= min(len(x), len(y))


def test_ties_are_joined_once_a_round(spark, monkeypatch, tmp_path):
    """Each round looks once at the pairs that the last left apart, and at no others."""
    from quarry.llm import ngram_join

    real, calls = ngram_join.apart, []

    def apart(pairs, comp):
        out, log = real(pairs, comp), str(tmp_path / str(len(calls)))
        calls.append((pairs.count(), out.count(), log))

        def seen(batches):
            for b in batches:
                with open(log, "a") as f:
                    f.write(f"{b.num_rows} ")
                yield b

        return out.mapInArrow(seen, out.schema)

    monkeypatch.setattr(ngram_join, "apart", apart)
    near_duplicates(spark.createDataFrame(corpus(1), "doc_id long, text string"), Near(words=3, num=90, block=8)).count()
    for _, n, log in calls:
        assert n == (sum(map(int, open(log).read().split())) if n else 0)
    ties = calls[::2]  # every other call is for links
    assert ties[0][1] and all(now[0] == last[1] for last, now in zip(ties, ties[1:], strict=False))


def test_shuffle_files_go_when_a_step_is_settled(spark, monkeypatch):
    """The shuffle of the signatures leaves the disk before the sets are made."""
    import os
    import time

    from quarry.llm import ngram_join

    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    held = lambda: {f.split("_")[1] for top in dirs for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    before, made, left = held(), [], []

    def tied(*a, real=ngram_join.tied):
        out = real(*a)
        made.append(held() - before)
        return out

    def sets_of(*a, real=ngram_join.sets_of):
        until = time.time() + 30  # after other tests the cleaner has much to do
        while made[0] & held() and time.time() < until:
            time.sleep(0.1)
        left.append(made[0] & held())
        return real(*a)

    monkeypatch.setattr(ngram_join, "tied", tied)
    monkeypatch.setattr(ngram_join, "sets_of", sets_of)
    near_duplicates(spark.createDataFrame(corpus(1), "doc_id long, text string"), Near(words=3, num=90, block=8)).count()
    assert made[0] and left == [set()]
