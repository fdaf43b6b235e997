import random
import re
from collections import Counter
from itertools import permutations

from quarry.llm.filter_audit import FILTERS, audit, filter_audit, joint_failures

SCHEMA = "doc_id long, text string, source string, A int, part string, good int"
LABELS = "doc_id long, quality int, toxic int, text string"


def table():
    rng = random.Random(8)
    texts = [None, "", "short", "Many CAPITALS HERE " * 30, "# plain " * 40, *(" ".join(rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(rng.choice([20, 60, 90]))) for _ in range(25)), "long unlike " * 40_000]
    docs = [(i, rng.choice(texts), rng.choice(["a", "a", "b", "", None]), 1, "p", 1) for i in range(300)]
    docs += [docs[5], docs[5], (None, "short", "a", 1, "p", 1), (None, "only here", "a", 1, "p", 1), (400, "only here", "c", None, None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for i in range(0, 300, 2)] + [(4, 1, 1, None), (None, 1, 1, "x"), (999, 1, 1, "x")]
    return docs, labels


def brute(docs, labels):
    good, toxic = {i for i, q, _, _ in labels if q == 1 and i is not None}, {i for i, _, t, _ in labels if t == 1 and i is not None}
    least, out, rows = {}, Counter(), []
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, s, *_ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and least[t] < i)
        rows.append((s or "", {f for f, x in zip(FILTERS, fails) if x}, i in good, i in toxic))
    parts = {r[0] for r in rows}
    for order in map("".join, permutations(FILTERS)):
        for part, fails, g, t in rows:
            falls = next((k for k, f in enumerate(order) if f in fails), None)
            for k, f in enumerate(order):
                key = (part, order, k + 1)
                out[key, "kept"] += falls is None or falls > k
                out[key, "removed"] += falls == k
                out[key, "redundant"] += f in fails and falls < k
                out[key, "unique_fails"] += fails == {f}
                out[key, "good_lost"] += falls == k and g
                out[key, "toxic_lost"] += falls == k and t
                out[part, f] += falls == k
    return {(p, o, k + 1): (*(out[(p, o, k + 1), c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), out[p, f]) for p in parts for o in map("".join, permutations(FILTERS)) for k, f in enumerate(o)}


def test_equals_a_run_of_every_order(spark):
    docs, labels = table()
    out = filter_audit(spark.createDataFrame(docs, SCHEMA).repartition(5), spark.createDataFrame(labels, LABELS)).collect()
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in out}
    want = brute(docs, labels)
    assert len(out) == len(got) == 600 * 4 and got == want


def test_shapley_shares_out_what_is_removed(spark):
    docs, labels = table()
    out = filter_audit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)).where("filter_order = 'ABCDE'").groupBy("part").agg({"shapley": "sum", "removed": "sum"}).collect()
    assert all(r["sum(shapley)"] == 120 * r["sum(removed)"] for r in out)


def test_other_numbers_of_filters(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("p", True, False), ("p", True, True), ("p", False, False)], "part string, x boolean, y boolean")
    joint = joint_failures(rows, "xy", {m: F.lit(1).cast("long") for m in ("n", "good", "toxic")})
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in audit(joint, "xy").collect()}
    assert got == {("xy", 1): (1, 2, 0, 1, 3), ("xy", 2): (1, 0, 1, 0, 1), ("yx", 1): (2, 1, 0, 0, 1), ("yx", 2): (1, 1, 1, 1, 3)}


def test_empty_tables(spark):
    none, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert filter_audit(none, labels).count() == 0
    out = filter_audit(spark.createDataFrame([(1, None, None, 1, "p", 1)], SCHEMA), labels).where("filter_order = 'EDCBA'").orderBy("step").collect()
    assert [(r["part"], r["kept"], r["removed"]) for r in out] == [("", 1, 0)] * 4 + [("", 0, 1)]
