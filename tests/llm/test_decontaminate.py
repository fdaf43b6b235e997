import hashlib
import random
import re

from quarry.llm.decontaminate import Limits, SuffixAutomaton, contamination, remove_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(doc, items, window):
    w, hit, found = low(doc), set(), set()
    for item, text in items:
        v = low(text)
        n = min(window, len(v))
        for k in range(len(v) - n + 1 if v else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[k : k + n]:
                    hit.update(range(i, i + n))
                    found.add(str(item) if item is not None else "")
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def cases():
    rng = random.Random(5)
    say = lambda n, k=4: " ".join(rng.choice("Ab,c é9".replace(" ", "")[:k] if k < 5 else ["a", "B.", "cé", "d-9", "e"]) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 3, 6, 9]), 5)) for i in range(12)] + [(100, None), (101, " ,. "), (3, "a B cé"), (10, "a B cé"), (None, "e e e e e e")]
    docs = [(i, say(rng.choice([0, 1, 5, 30, 60]), 5)) for i in range(40)] + [(7, None), (8, ""), (9, "a b CÉ"), (None, "e e e e e e e"), (7, items[0][1])]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for limits in (Limits(window=4), Limits(window=4, max_shard_words=12)):
        got = sorted((r[0] is None, r[0] or 0, *r[1:6]) for r in contamination(d, b, limits).collect())
        assert got == sorted((i is None, i or 0, *brute(t, items, 4)) for i, t in docs)


def test_random_automata():
    rng = random.Random(1)
    for _ in range(150):
        window = rng.randint(1, 5)
        items = [(str(i), [bytes([97 + rng.randrange(3)]) for _ in range(rng.randint(1, 9))]) for i in range(rng.randint(1, 5))]
        sam = SuffixAutomaton(window)
        for i, w in items:
            sam.add(i, w)
        sam.freeze()
        doc = [bytes([97 + rng.randrange(4)]) for _ in range(30)]
        hit, found = sam.scan(doc)
        e = brute(" ".join(x.decode() for x in doc), [(i, " ".join(x.decode() for x in w)) for i, w in items], window)
        assert (sum(hit), len(found)) == e[1:3]


def test_removal_keeps_clean_documents(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"Clean before. {passage.upper()}! " + "tail " * 30, 5, "x"), (2, "untouched, as it is\n", 20, "y"), (3, passage, 4, None), (4, None, None, None)], "doc_id long, text string, n_chars long, extra string")
    out = {r["doc_id"]: r for r in remove_contamination(docs, spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()}
    assert set(out) == {1, 2, 4} and out[2]["text"] == "untouched, as it is\n" and out[4]["n_chars"] is None
    assert out[1]["text"] == "Clean before. ! " + "tail " * 30 and out[1]["n_chars"] == len(out[1]["text"])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert contamination(none, items).count() == 0
    row = contamination(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items).first()
    assert (row["n_words"], row["n_hit"], row["items_sha256"]) == (2, 0, hashlib.sha256(b"").hexdigest())
