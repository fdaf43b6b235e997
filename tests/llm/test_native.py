import random
import re

from quarry.llm.mixing import Mix, mix_sources
from quarry.llm.quality_rules import quality_rules

W = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, h long, n long"


def rows(n=400):
    rng = random.Random(2)
    out = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(rng.choice([0, 3, 60, 200]))]
        text = "".join(w + rng.choice([" ", " ", "\n", "\t\x0b"]) for w in words)
        out.append((i, text + ("### $$ " * 60 if i % 29 == 0 else ""), rng.choice(["en", None]), rng.choice(["a", "a", "b", "Z", "é", None]), 1, 1))
    return out + [(500, None, None, None, 1, 1), (7, out[7][1], out[7][2], out[7][3], 1, 1), (None, "x y z " * 30, "en", "a", 1, 1), (501, "same three words " * 20_000, "en", "b", 1, 1)]


def test_base_counts(spark):
    got = sorted((str(r[0]), *r[1:7]) for r in quality_rules(spark.createDataFrame(rows(), SCHEMA)).collect())
    want = []
    for d, text, *_ in rows():
        text = text or ""
        w, at, cover = W.findall(text), {}, set()
        for i in range(len(w) - 2):
            at.setdefault(tuple(w[i : i + 3]), []).append(i)
        for v in at.values():
            if len(v) > 1:
                cover |= {p + k for p in v for k in range(3)}
        lines = [x for x in text.split("\n") if W.search(x)]
        want.append((str(d), len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)))
    assert got == sorted(want)


def test_thresholds_follow_the_group(spark):
    clean = [(i, " ".join(f"w{i}x{k}" for k in range(80)), "en", "s", 1, 1) for i in range(300)]
    junk = [(1000 + i, " ".join(f"### $$$ v{i}x{k}" for k in range(80)), "en", "s", 1, 1) for i in range(10)]
    usual = [(2000 + i, " ".join(f"# v{i}x{k}" for k in range(80)), "en", "symbols", 1, 1) for i in range(300)]
    kept = {r["doc_id"] for r in quality_rules(spark.createDataFrame(clean + junk + usual, SCHEMA)).where("kept").collect()}
    assert kept == {r[0] for r in clean + usual}


def test_mix_meets_its_targets(spark):
    for mix in (Mix(), Mix(weights=(1, 100), level_bits=8)):
        out = mix_sources(spark.createDataFrame(rows(3000), SCHEMA), mix).collect()
        assert len(out) == 3004 and all(r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in out)
        by = {}
        for r in out:
            s, t, k, most = by.get((r["source_size"], r["target"]), (0, 0, 0, 0))
            by[r["source_size"], r["target"]] = s + r["size"], t + r["taken"], k + 1, max(most, r["size"])
        assert abs(sum(t for _, t in by) / sum(r["size"] for r in out) - 1) < 1e-9
        for (size, target), (s, taken, _, most) in by.items():
            assert s == size and target <= 3 * size + 1e-6 and abs(taken - target) <= most
        assert sorted(map(str, out)) == sorted(map(str, mix_sources(spark.createDataFrame(rows(3000), SCHEMA).repartition(5), mix).collect()))


def test_empty_and_wordless(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mix_sources(none).count() == quality_rules(none).count() == 0
    r = mix_sources(spark.createDataFrame([(1, None, "en", None, 1, 1), (2, " ", "en", "a", 1, 1)], SCHEMA)).collect()
    assert all(x["taken"] == 0 and x["target"] == 0 for x in r)
