import hashlib
import random
import re

import numpy as np

from quarry.llm.pii import CLASSES, KINDS, TAGS, Net, Tagger, base_spans, default_tagger, find, generated, luhn, owned, personal_data, redact, tags, valid, windows


def plain(text):
    """The base as it is stated."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_equals_the_patterns():
    rng = random.Random(1)
    bits = ["a", "B9", "@", ".", "-", " ", "+", "1", "12", "255", "256", "007", "(", ")", "é", "%", "_", "\n", "4111111111111111", "4111-1111 1111-1111", "+1 (555) 555-0100", "x@y.zz", "1.2.3.4"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))
        assert base_spans(text) == plain(text), text


def test_base_is_linear():
    for text in ("a" * 300_000, "a@" * 100_000, "1" * 300_000, "1." * 150_000, "+1" * 100_000, "a.b@c" * 60_000):
        base_spans(text)


def test_gradients():
    net = Net(hidden=3, batch=2, train_length=6)
    t = Tagger(net)
    for w in t.w.values():
        w += np.random.default_rng(3).normal(0, 0.2, w.shape).astype(np.float32)
    t.w = {k: v.astype(np.float64) for k, v in t.w.items()}
    c = np.random.default_rng(4).integers(0, CLASSES, (2, 6))
    y = np.array([[0, 1, 2, 2, 0, 5], [3, 4, 0, 0, 7, 8]])
    _, g = t.loss(c, y)
    for k in t.w:
        for at in [tuple(np.random.default_rng(i).integers(0, s) for s in t.w[k].shape) for i in range(3)] + ([(c[0, 1], 0)] if k[0] == "x" else []):
            if k == "t" and t.bar[at] < 0:
                continue
            old = t.w[k][at]
            t.w[k][at] = old + 1e-3
            up = t.loss(c, y)[0]
            t.w[k][at] = old - 1e-3
            down = t.loss(c, y)[0]
            t.w[k][at] = old
            assert abs((up - down) / 2e-3 - g[k][at]) < 2e-3, (k, at)


def test_viterbi_is_the_best_path():
    t = Tagger(Net(hidden=3))
    t.w["t"] += np.random.default_rng(1).normal(0, 1, (TAGS, TAGS)).astype(np.float32)
    c = np.random.default_rng(2).integers(0, CLASSES, (3, 4))
    e, _ = t.emissions(c)
    for row, got in enumerate(t.decode(c)):
        grid = np.stack(np.meshgrid(*[np.arange(TAGS)] * 4, indexing="ij"), -1).reshape(-1, 4)
        score = e[np.arange(4), row, grid].sum(1) + (t.w["s"] + t.bar_first)[grid[:, 0]] + (t.w["t"] + t.bar)[grid[:, :-1], grid[:, 1:]].sum(1)
        assert list(grid[score.argmax()]) == list(got)


def test_held_out_accuracy():
    right = found = there = 0
    texts = generated(999, 300)
    for (_, spans), (_, every) in zip(texts, find([x for x, _ in texts], default_tagger()), strict=True):
        right += len(set(spans) & set(every))
        found += len(every)
        there += len(spans)
    assert right > 0.9 * there and right > 0.95 * found


def test_windows_cover_each_anchor():
    text = ("word " * 30 + "1 " * 200 + "x" * 500 + "me@") * 3
    w = windows(text, Net())
    for m in re.finditer("[0-9@]", text):
        assert sum(a <= m.start() < b for _, _, a, b in w) == 1
        assert any(s <= m.start() and m.end() <= e for s, e, _, _ in w)
    assert all(e - s <= Net().window for s, e, _, _ in w)



def test_every_valid_form_lies_in_a_window():
    forms = [("john.smith (at) example.com", 0), ("john at example.com", 0), ("JOHN AT EXAMPLE.COM", 0), ("john [at] mail.example [dot] com", 0), ("fe:ab:cd:ef:ab:cd:ef:ab", 1), ("fe::ab:cd:ef", 1), ("(at)x.y", 0)]
    forms += [(text[s:e], kind) for text, spans in generated(5, 300) for s, kind, e in spans]
    for form, kind in forms:
        text = "words of no number " * 20 + form + " and more of them" * 20
        at = text.index(form)
        if valid(text, kind, at, at + len(form)):
            assert any(s <= at and at + len(form) <= e for s, e, _, _ in windows(text, Net())), form
    text = "ask john [at] mail.example [dot] com or fe:ab:cd:ef:ab:cd:ef:ab now"
    assert {(k, text[s:e]) for s, k, e in next(find([text], default_tagger()))[1]} == {(0, "john [at] mail.example [dot] com"), (1, "fe:ab:cd:ef:ab:cd:ef:ab")}


class Marked:
    """In place of the network: tags whatever it sees of runs of hex groups, as an IPv6 address."""

    net = Net()

    def decode(self, c):
        inside = np.isin(c, [ord(x) for x in "abcdef0123456789:"])
        return np.where(inside, np.where(np.diff(inside, axis=1, prepend=False) & inside, 3, 4), 0)


def test_long_spans_are_whole_wherever_they_begin():
    address = "2001:1db8:85a3:1111:2222:8a2e:1370:7334"
    for k in range(200):
        text = "12 z " * 60 + "z" * k + " " + address + " z" + " 12 z" * 60
        found = [text[s:e] for s, _, e in next(find([text], Marked()))[1]]
        assert found == [address], k


def test_cut_spans_are_joined():
    w = windows("1" * 400, Net())
    assert owned([(w[0], [(90, 0, 128)]), (w[1], [(90, 0, 140)])]) == [(90, 0, 140)]
    assert owned([(w[0], [(40, 0, 128)]), (w[1], [(64, 0, 140)])]) == [(40, 0, 128), (64, 0, 140)]  # reconcile makes them one
    assert owned([(w[0], [(90, 0, 120)]), (w[1], [(90, 0, 120)])]) == [(90, 0, 120)]

def test_rows(spark):
    long = "lorem ipsum " * 20_000 + "call +1 (555) 555-0100 or (555) 555-0100 now"
    rows = [(1, None, None), (2, "", None), (3, "Éé me.you@mail7.example.com 10.0.0.1, 4111 1111 1111 1111", None), (3, "no data here", "x"), (None, long, "y")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, spans string, n_chars long")
    got = personal_data(df).collect()
    assert len(got) == 5
    none = hashlib.sha256(b"").hexdigest()
    for r in got:
        if r["doc_id"] in (1, 2):
            assert r["base_sha256"] == none and r["spans"] == ""
    long_row = next(r for r in got if r["doc_id"] is None)
    assert long_row["n_phone"] == 1 and len(long_row["spans"].split(",")) == 2
    clean = {(r["doc_id"], r["text"], r["n_chars"]) for r in redact(df).collect()}
    assert (3, "no data here", 7) in clean and (1, None, 7) in clean and (3, "Éé <email> <ip>, <card>", 23) in clean
    assert personal_data(df.where("doc_id > 9")).count() == 0
    assert list(tags(4, [(1, 1, 3)])) == [0, 3, 4, 0] and KINDS[1] == "ip"
