import itertools
import random
import re

import xxhash

from quarry.llm.line_dedup import Units, repeated_units, units

SCHEMA = "doc_id long, text string, n_chars long, uid string"


def cut(text, p):
    """Units by loops over characters and words, written apart from the operator's."""
    out, words, line = [], [], 0
    for m in re.finditer(r"[^ \t-\r]+|\n", text or ""):
        if m[0] == "\n":
            line += 1
        else:
            words.append((re.sub("[A-Z]", lambda x: x[0].lower(), m[0]), m.start(), m.end(), line))
    lines = [list(g) for _, g in itertools.groupby(range(len(words)), key=lambda i: words[i][3])]
    joined = lambda at: " ".join(words[i][0] for i in at)
    for at in lines:
        out.append((joined(at), words[at[0]][1], words[at[-1]][2]))
    if len(words) > p.min_words:
        own = [xxhash.xxh3_64_intdigest(w[0]) for w in words] + [0]
        h = [((own[i] ^ (own[i + 1] * 0x9E3779B97F4A7C15 % 2**64)) * 0xFF51AFD7ED558CCD) % 2**64 for i in range(len(words))]
        breaks = [i for i in range(len(h)) if all(h[k] > h[i] for k in range(max(0, i - p.reach), min(len(h), i + p.reach + 1)) if k != i)]
        for at in lines:
            edges = sorted({at[0], at[-1] + 1, *(b for b in breaks if at[0] <= b <= at[-1])})
            for i, j in zip(edges, edges[1:], strict=False):
                u = joined(range(i, j))
                if j - i < len(at) and j - i >= p.min_words and len(u.encode()) >= p.min_chars:
                    out.append((u, words[i][1], words[j - 1][2]))
    return out


def brute(rows, p):
    seen, out = set(), []
    for i, (doc, text) in sorted(enumerate(rows), key=lambda r: (r[1][0] is None, r[1][0] or 0, r[0])):
        gone, found = [], cut(text, p)
        for u, s, e in sorted(found, key=lambda x: x[1]):
            if u in seen:
                gone.append((s, e))
            seen.add(u)
        merged = []
        for s, e in sorted(gone):
            if merged and merged[-1][1] + 1 >= s:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        out.append((str(doc), len(text or ""), len(found), len(gone), sum(e - s for s, e in merged), ",".join(f"{s}:{e}" for s, e in merged)))
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghié") for _ in range(rng.randint(2, 8)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(5)]
    lines = [" ".join(word() for _ in range(9)) for _ in range(5)]
    rows = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40))) + " " + (rng.choice(passages) if rng.random() < 0.3 else "") + " " + " ".join(word() for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.5:
            parts.insert(0, rng.choice(lines))
        rows.append((i, "\n".join(parts)))
    rows += [(500, None), (501, ""), (None, passages[0]), (3, rows[3][1]), (502, "same words again and again here\n" * 3), (503, "x y " * 20_000)]
    df = spark.createDataFrame([(*r, 1, "u") for r in rows], SCHEMA).coalesce(3)
    for p in (Units(), Units(min_words=2, min_chars=1, reach=2)):
        assert sorted((str(r[0]), *r[1:]) for r in repeated_units(df, p).collect()) == brute(rows, p)


def test_a_passage_is_found_wherever_it_stands(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    rows, plain = [], []
    for i in range(60):
        passage = " ".join(word() for _ in range(55))
        for k in (0, 1):
            rows.append((2 * i + k, " ".join(word() for _ in range(30)) + " " + passage + " " + " ".join(word() for _ in range(30))))
        plain.append((1000 + i, " ".join(word() for _ in range(200))))
    got = {r["doc_id"]: r for r in repeated_units(spark.createDataFrame(rows + plain, "doc_id long, text string")).collect()}
    assert sum(got[2 * i + 1]["n_removed"] > 0 for i in range(60)) >= 58
    assert all(got[2 * i]["n_removed"] == 0 for i in range(60)) and all(got[i]["n_removed"] == 0 for i, _ in plain)


def test_empty(spark):
    assert repeated_units(spark.createDataFrame([], SCHEMA)).count() == 0


def test_short_lines_and_unspaced_passages():
    rng = random.Random(4)
    assert [(s, e) for u, s, e in units("All rights reserved.\n\nOK", Units()) if u in (b"all rights reserved.", b"ok")] == [(0, 20), (22, 24)]
    han = lambda n: "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(n))
    passage = han(400)
    one, two = ({u: e - s for u, s, e in units(han(k) + passage + han(90), Units())} for k in (70, 131))
    assert sum(one[u] for u in one.keys() & two.keys()) > 250


def test_short_lines_are_removed(spark):
    rows = [(1, "All rights reserved.", 0, "u"), (2, "my own words\nAll rights reserved.", 0, "u")]
    got = {r["doc_id"]: r["removed"] for r in repeated_units(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "", 2: "13:33"}


def test_a_line_is_found_inside_of_lines_and_any_id_will_do(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(30)]
    rows = [(f"a{i}", p) for i, p in enumerate(passages)] + [(f"b{i}", word() + " x " + p + " y " + word()) for i, p in enumerate(passages)] + [(None, passages[0]), ("c", None)]
    got = {r["doc_id"]: r for r in repeated_units(spark.createDataFrame(rows, "doc_id string, text string").coalesce(1)).collect()}
    assert sum(got[f"b{i}"]["n_removed"] > 0 for i in range(30)) >= 28 and all(got[f"a{i}"]["n_removed"] == 0 for i in range(30))
    assert got[None]["removed_chars"] == len(passages[0]) and got["c"]["n_units"] == 0


def test_ids_of_any_type_rank_by_value(spark):
    """Of 40 rows with one text the smallest id keeps it, however the rows are dealt out; an id that is null comes last."""
    text = "one line that every one of these rows has in full\nand another"
    rows = [(None if i == 17 else f"x{i:03d}", text) for i in range(40)]
    for n in (1, 7):
        for order in (rows, rows[::-1]):
            out = repeated_units(spark.createDataFrame(order, "doc_id string, text string").repartition(n)).collect()
            assert [r["doc_id"] for r in out if not r["n_removed"]] == ["x000"] and len(out) == 40
