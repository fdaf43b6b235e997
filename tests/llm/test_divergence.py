import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

from quarry.llm import divergence as module
from quarry.llm.divergence import Audit, divergence, share

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, p string, value int"


def table(n=400):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcXYZéß_9") for _ in range(rng.randint(1, 4))) for _ in range(60)] + ["ÉCOLE", "école", "İi", "🙂", "Σ"]
    rows = []
    for i in range(n):
        text = rng.choice([" ", "-", "\n"]).join(rng.choice(words[: rng.choice([5, 65])]) for _ in range(rng.choice([0, 4, 30])))
        rows.append((i, text, rng.choice(["en", "en", "fr", None]), rng.choice(["a", "b", "é", "Z", None]), "t", 1, "p", 1))
    rows += [rows[0], rows[0], (None, None, None, None, None, None, None, None), (900, None, "en", "silent", "t", 1, "p", 1), (901, "one Two", "rare", "a", "t", 1, "p", 1), (902, "", "rare", "b", "t", 1, "p", 1)]
    return rows + [(903, "Abc " * 60_000 + "x" * 100_000, "en", "a", "t", 1, "p", 1)]


def brute(rows, least=10, top=10):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        count[lang, source].update(terms)
        count[lang,].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in docs[lang].items() if d >= least]
        p = {}
        for key in [(lang,), *(g for g in groups if g[0] == lang)]:
            total = sum(count[key][t] for t in kept)
            p[key] = {t: 1 + 10**9 * (count[key][t] + 2) // (total + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for g in groups:
            if g[0] == lang:
                pairs = sorted((-sum(f(p[g][t], p[h][t]) for t in kept), h[1].encode()) for h in groups if h[0] == lang and h != g)
                terms = sorted((-f(p[g][t], p[lang,][t]), t.encode()) for t in kept if count[g][t] and p[g][t] > p[lang,][t])[:top]
                out += [(*g, part, i.decode(), -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, i) in enumerate(found, 1)]
    return sorted(out)


def test_equals_brute_force(spark):
    got = sorted(map(tuple, divergence(spark.createDataFrame(table(), SCHEMA).repartition(5)).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == brute(table()) and {r[2] for r in got} == {"pair", "term"} and any(r[0] == "rare" and r[4] == 0 for r in got)


def test_other_limits(spark):
    got = sorted(map(tuple, divergence(spark.createDataFrame(table(60), SCHEMA), Audit(min_documents=2, top=3)).collect()))
    assert got == brute(table(60), 2, 3)


def test_counts_beyond_64_bits(spark):
    """Shares are exact where counts times the scale outgrow a long."""
    rows = [(3 * 10**12, 3 * 10**12 + 1, 2), (1, 3 * 10**12 + 1, 2), (4 * 10**9, 5 * 10**9, 7), (5 * 10**9, 5 * 10**9, 7), (9 * 10**17, 9 * 10**18, 10**6)]
    out = spark.createDataFrame(rows, "n long, all_n long, v long").select("n", "all_n", "v", share(10**9).alias("p")).collect()
    assert [r["p"] for r in out] == [1 + 10**9 * (n + 2) // (all_n + 2 * v) for n, all_n, v in rows]


def test_small_tables_in_tasks(spark, monkeypatch):
    """Handing counts on early changes nothing."""
    monkeypatch.setattr(module, "HELD", 3)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 3 + ["fr"], "source": ["a", "a", "b", "a"], "text": ["x y z x", "w X", "x", ""]})
    total = Counter()
    for b in module._counted(iter([batch, batch])):
        for r in b.to_pylist():
            total[r["lang"], r["source"], r["term"], "n"] += r["n"]
            total[r["lang"], r["source"], r["term"], "d"] += r["d"]
    assert total["en", "a", "x", "n"] == 6 and total["en", "a", "x", "d"] == 4 and total["en", "b", "x", "d"] == 2 and ("fr", "a", None, "n") in total


def test_empty_table(spark):
    assert divergence(spark.createDataFrame([], SCHEMA)).count() == 0
