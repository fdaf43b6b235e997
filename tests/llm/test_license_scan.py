import itertools
import math
import random
import textwrap
from collections import Counter

from quarry.llm.license_scan import TEMPLATES, WORD, Matcher, license_scan

SCHEMA = "doc_id long, path string, text string, license string"


def test_best_is_exact():
    m = Matcher(TEMPLATES).weigh({"the": 90, "under": 20, "license": 5}, 100)
    rng = random.Random(1)
    for _ in range(400):
        c = Counter(rng.choice([*m.terms, "zzz", "qqq"]) for _ in range(rng.randint(1, 12)))
        v = {t: n * m.idf.get(t, 1.0 / n * n) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        all_ = []
        for name, k in zip(m.names, m.counts, strict=True):
            w = {t: n * m.idf[t] for t, n in k.items()}
            all_.append((-round(sum(v.get(t, 0) * x for t, x in w.items()) / norm / math.sqrt(sum(x * x for x in w.values())), 9), name))
        score, name = min(all_)
        got = m.best(c, 0.3)
        assert (got is None) if -score < 0.3 - 1e-9 else abs(got[0] + score) < 1e-6
        assert got is None or (-round(got[0], 9), got[1]) == (score, name) or abs(got[0] + score) < 1e-6
    assert WORD.findall("cc by-nc 4.0.") == ["cc", "by-nc", "4.0"]


def test_headers_files_and_inheritance(spark):
    filler = "quite ordinary words that say nothing of rights\n" * 40
    rows = [
        (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0.\n" + filler),
        (2, "a/b/c/code.txt", filler),
        (3, "a/b/own.txt", filler + "Released under the MIT License.\n" + filler),
        (4, "a/b/d/LICENSE.md", "This work is licensed under the GNU General Public License, version 3."),
        (5, "a/b/d/x.txt", filler), (6, "z/x.txt", filler), (7, "z/y.txt", None), (8, None, ""), (9, "a/top.txt", "the license of the work"),
        (10, "q/r/whole.txt", "Licensed under CC BY-NC 4.0."), (11, "q/r/s/t/u.txt", filler), (11, "q/r/s/t/u.txt", filler),
        (12, "q/other.txt", filler), (13, "ab/x.txt", filler),
    ]
    got = sorted((r["doc_id"], r["license"], r["origin"], r["licensed_by"], r["line"]) for r in license_scan(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect())
    assert got == [
        (1, "Apache-2.0", "file", None, 0), (2, "Apache-2.0", "inherited", "a", None), (3, "MIT", "header", None, 40),
        (4, "GPL-3.0", "file", None, 0), (5, "GPL-3.0", "inherited", "a/b/d", None), (6, None, "none", None, None),
        (7, None, "none", None, None), (8, None, "none", None, None), (9, "Apache-2.0", "inherited", "a", None),
        (10, "CC-BY-NC-4.0", "file", None, 0), (11, None, "none", None, None), (11, None, "none", None, None),
        (12, None, "none", None, None), (13, None, "none", None, None),
    ]
    assert license_scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_other_words_count_with_their_idf(spark):
    # Each short document has rare words of its own before its licence line; only the last is nothing but a licence.
    rows = [(i, f"d/{i}", " ".join(f"rare{i}x{k}" for k in range(12)) + "\nReleased under the MIT License.") for i in range(20)]
    rows += [(100 + i, f"e/{i}", "quite ordinary words under the sun") for i in range(300)] + [(999, "f/g", "Released under the MIT License."), (1000, "f/h", "nothing"), (1001, "d/x", "nothing")]
    out = license_scan(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in out}
    assert {got[i] for i in range(20)} == {("MIT", "header")}
    assert got[1001] == (None, "none") and got[999] == ("MIT", "file") and got[1000] == (None, "none")  # no file's name says that it is a licence


def test_undecided_lines_are_scored_exactly(spark):
    rows = [(1, "Released today under the MIT License."), (2, "today is today"), (3, "of the sun"), (4, None)]
    rows = [(i, f"p/{i}", t, "x") for i, t in rows]
    df = Counter(w for r in rows for w in set(WORD.findall((r[2] or "").lower())))
    m = Matcher(TEMPLATES).weigh(df, len(rows))
    idf = lambda w: math.log((1 + len(rows)) / (1 + df[w])) + 1
    line, wanted = WORD.findall(rows[0][2].lower()), WORD.findall("released under the mit license.")
    score = sum(idf(w) ** 2 for w in wanted) / math.sqrt(sum(idf(w) ** 2 for w in line) * sum(idf(w) ** 2 for w in wanted))
    out = {r["doc_id"]: r for r in license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert m.best(Counter(line), 0.5)[0] > score > 0.72
    assert abs(out[1]["score"] - score) < 1e-9 and out[1]["license"] == "MIT" and out[1]["line"] == 0


def test_wrapped_notices_and_licence_files(spark):
    mit, gpl = TEMPLATES["MIT"][-1], TEMPLATES["GPL-3.0"][-1]
    wrapped = lambda text, mark: "\n".join(f"{mark} {x}" for x in textwrap.wrap(text, 66))
    code = "\n".join(f"value{i} = compute{i}(other{i})" for i in range(300))
    rows = [(1, "p/LICENSE", "The MIT License\n\nCopyright (c) 2001 Some Body\n\n" + textwrap.fill(mit, 70)), (2, "p/src/a.py", code), (3, "g/a.c", wrapped("ab.c does things", "//") + "\n//\n" + wrapped(gpl, "//") + "\n\n" + code), (4, "g/b.c", code), (5, "b/COPYING", wrapped(TEMPLATES["BSD-3-Clause"][-1], "")), (6, "b/x/y/z", code)]
    got = {r["doc_id"]: (r["license"], r["origin"], r["licensed_by"]) for r in license_scan(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()}
    assert got == {1: ("MIT", "file", None), 2: ("MIT", "inherited", "p"), 3: ("GPL-3.0", "header", None), 4: (None, "none", None), 5: ("BSD-3-Clause", "file", None), 6: ("BSD-3-Clause", "inherited", "b")}


def test_query_is_as_by_brute_force(spark):
    """Best line or block, whole text and inheritance by loops."""
    rng = random.Random(5)
    said = [t for ts in TEMPLATES.values() for t in ts if len(t) < 90]
    word = lambda: rng.choice(["sun", "moon", "the", "of", "license", "work", "under", "x1", "y2", "z3"])
    rows = []
    for i in range(120):
        lines = [" ".join(word() for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 5))]
        if rng.random() < 0.5:
            lines.insert(rng.randint(0, len(lines)), rng.choice(["", word() + " "]) + rng.choice(said) + rng.choice(["", " " + word()]))
        rows.append((i, "/".join([rng.choice("ab") for _ in range(rng.randint(0, 3))] + [rng.choice(["LICENSE", "f.txt", "g"])]), "\n".join(lines), "x"))
    words = lambda t: Counter(WORD.findall(t.lower()))
    df = Counter(w for r in rows for w in words(r[2]))
    idf = lambda w: math.log((1 + len(rows)) / (1 + df[w])) + 1
    unit = lambda c: {w: n * idf(w) / math.sqrt(sum((k * idf(x)) ** 2 for x, k in c.items())) for w, n in c.items()}
    known = [(name, unit(words(t))) for name, ts in sorted(TEMPLATES.items()) for t in ts]

    def best(c):
        v = unit(c)
        return max(((round(sum(x * t.get(w, 0) for w, x in v.items()), 9), name) for name, t in known), key=lambda r: r[0]) if v else (0, None)

    own, by_dir = {}, {}
    for i, path, text, _ in rows:
        lines, found = text.split("\n"), []
        for at, line in enumerate(lines):
            found.append((*best(words(line)), at))
        at = 0
        for some, group in itertools.groupby(lines, key=lambda x: bool(words(x))):
            group = list(group)
            if some and len(group) > 1:
                found.append((*best(sum(map(words, group), Counter())), at))
            at += len(group)
        head = max((f for f in found if f[0] >= 0.72), key=lambda f: (f[0], -f[2]), default=None)
        whole = best(words(text))
        own[i] = head[0] if head else whole[0] if whole[0] >= 0.6 else None
        if own[i] is not None and path.rsplit("/", 1)[-1] == "LICENSE":
            d = path.rpartition("/")[0]
            by_dir[d] = min(by_dir.get(d, (0, "")), (-own[i], path))
    for r in license_scan(spark.createDataFrame(rows, SCHEMA)).collect():
        if own[r["doc_id"]] is not None:
            assert abs(r["score"] - own[r["doc_id"]]) < 1e-6 and r["origin"] in ("header", "file")
            continue
        up = r["path"].rpartition("/")[0]
        while up and up not in by_dir:
            up = up.rpartition("/")[0]
        assert (r["licensed_by"], r["origin"]) == ((up, "inherited") if up in by_dir else (None, "none"))
        assert up not in by_dir or abs(r["score"] + by_dir[up][0]) < 1e-6
