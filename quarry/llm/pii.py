"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions for what they miss.

The base finds e-mail addresses, IPv4 addresses, card and phone numbers exactly as stated. The model finds other spellings (no plus
sign, other separators, IPv6, "name (at) host dot org"). It is trained in numpy from labelled spans: by default from generated text, or
from spans that the caller gives. A span of any kind's form has a digit, an @ sign, the word "at" or three colons that only hex digits part;
the text around any such anchor, anywhere in the whole text, is cut into overlapping windows. All windows of a batch run through the network
together, Viterbi decodes them, and the spans are reconciled over the whole text: a window speaks for the spans that begin in its
middle and for earlier ones that the window before does not hold whole, equal kinds that touch across windows become one, base spans win over what overlaps them, and a span must have its kind's
form (Luhn for cards, valid octets, number of digits). Nothing is shuffled; a text is decided where it is read.

Defined cases: a null text is empty and has no spans; rows repeat as they come; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, trimmed

KINDS = ("email", "ip", "card", "phone")
#: Tags: outside, then first and further characters of each kind.
TAGS = 1 + 2 * len(KINDS)
Span = tuple[int, int, int]  # start, kind, end

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_NUMBERS = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Every text that ``valid`` accepts has one of these.
_ANCHOR = re.compile(r"[0-9@]+|\b[aA][tT]\b|(?:[0-9a-fA-F]{0,4}:){3,}")
_SPELT = re.compile(r"[\w.%+-]+\s{0,2}(?:@|[\[({<]?\bat\b[\])}>]?)\s{0,2}[\w-]+(?:\.[\w-]+|\s{0,2}[\[({<]?\bdot\b[\])}>]?\s{0,2}[\w-]+)+", re.IGNORECASE)
_STOP = re.compile(r"\s?[\[(]?\.[\])]?\s?")


@dataclass(frozen=True)
class Net:
    hidden: int = 12
    window: int = 128
    context: int = 48
    steps: int = 320
    batch: int = 96
    train_length: int = 80
    rate: float = 0.02
    seed: int = 11


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind; each takes time in proportion to the text."""
    out: list[Span] = []
    end = 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        low = max(end, text.rfind("@", end, at) + 1)
        start = low + len(text[low:at].rstrip(_LOCAL))
        if start < at:
            out.append((start, 0, m.end()))
            end = m.end()
    for m in _NUMBERS.finditer(text):
        # A run of dotted numbers is read four at a time.
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, 1, at + size))
            at += size + 1
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def valid(text: str, kind: int, start: int, end: int) -> bool:
    """Whether a span has the form of its kind and stands alone."""
    s = text[start:end]
    if (start and text[start - 1].isalnum() and s[0].isalnum()) or (end < len(text) and text[end].isalnum() and s[-1].isalnum()):
        return False
    n = sum(c in "0123456789" for c in s)
    if kind == 0:
        return bool(_SPELT.fullmatch(s))
    if kind == 1:
        if ":" in s:
            try:
                return s.count(":") >= 3 and bool(ipaddress.IPv6Address(s))
            except ValueError:
                return False
        parts = _STOP.split(s)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 14 <= n <= 19 and luhn("".join(c for c in s if c in "0123456789")) and all(c in "0123456789 .-_/" for c in s)
    groups = re.findall("[0-9]+", s)
    return 10 <= n <= 15 and len(groups) >= 3 and all(len(g) <= 5 for g in groups) and all(c in "0123456789 .-()/+" for c in s) and (len(groups[-1]) >= 3)


# --- the network -------------------------------------------------------------------------------------------------------------

#: Character classes: ASCII by itself (letters without case), other letters, other characters, and beyond the text.
CLASSES = 131


def classes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(c < 128, c, 128 + ((c >= 0xC0) & (c < 0x2000)).astype(np.uint32) ^ 1).astype(np.int64)
    return out + 32 * ((out >= 65) & (out <= 90))


class Tagger:
    """Weights by name; gates are stacked as input, forget, output, candidate."""

    def __init__(self, net: Net) -> None:
        self.net = net
        rng, h = np.random.default_rng(net.seed), net.hidden
        f = lambda *s, by=0.1: rng.normal(0, by, s).astype(np.float32)
        self.w = {f"{k}{d}": v for d in "fb" for k, v in (("x", f(CLASSES, 4 * h, by=0.3)), ("u", f(h, 4 * h, by=0.3)))}
        for d in "fb":
            self.w[f"x{d}"][:, h : 2 * h] += 1.0  # remember at first
        self.w |= {"v": f(2 * h, TAGS), "b": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32), "s": np.zeros(TAGS, np.float32)}
        self.bar = np.zeros((TAGS, TAGS), np.float32)
        for j in range(2, TAGS, 2):  # a further character follows one of its own kind
            self.bar[[i for i in range(TAGS) if i not in (j - 1, j)], j] = -1e4
        self.bar_first = np.array([-1e4 if j and j % 2 == 0 else 0 for j in range(TAGS)], np.float32)

    def _run(self, c: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        n, length = c.shape
        h = self.net.hidden
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, tape = np.empty((length, n, h), np.float32), []
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            z = self.w[f"x{d}"][c[:, t]] + state @ self.w[f"u{d}"]
            gate, cand = 0.5 * np.tanh(0.5 * z[:, : 3 * h]) + 0.5, np.tanh(z[:, 3 * h :])
            before, old = state, cell
            cell = gate[:, h : 2 * h] * old + gate[:, :h] * cand
            th = np.tanh(cell)
            state = gate[:, 2 * h :] * th
            out[t] = state
            if keep:
                tape.append((t, gate, cand, old, th, before))
        return out, tape

    def emissions(self, c: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        f, tf = self._run(c, "f", keep)
        b, tb = self._run(c, "b", keep)
        both = np.concatenate([f, b], 2)
        return both @ self.w["v"] + self.w["b"], (both, tf, tb)

    def loss(self, c: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood per sequence, and its gradients."""
        e, (both, tf, tb) = self.emissions(c, True)
        length, n, _ = e.shape
        t, s = self.w["t"] + self.bar, self.w["s"] + self.bar_first
        sums = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = s + e[0]
        for k in range(1, length):
            alpha[k] = sums(alpha[k - 1][:, :, None] + t, 1) + e[k]
        for k in range(length - 2, -1, -1):
            beta[k] = sums(t[None] + (e[k + 1] + beta[k + 1])[:, None, :], 2)
        z = sums(alpha[-1], 1)
        rows, steps = np.arange(n), np.arange(length)
        gold = e[steps[:, None], rows, y.T].sum(0) + s[y[:, 0]] + t[y[:, :-1], y[:, 1:]].sum(1)
        de = np.exp(alpha + beta - z[:, None])
        g = {"s": de[0].mean(0), "t": np.zeros_like(t)}
        np.add.at(g["s"], y[:, 0], -1 / n)
        for k in range(1, length):
            g["t"] += np.exp(alpha[k - 1][:, :, None] + t + (e[k] + beta[k])[:, None, :] - z[:, None, None]).mean(0)
        np.add.at(g["t"], (y[:, :-1], y[:, 1:]), -1 / n)
        de[steps[:, None], rows, y.T] -= 1
        de /= n
        g["v"], g["b"] = np.einsum("knh,knt->ht", both, de), de.sum((0, 1))
        dh = de @ self.w["v"].T
        h = self.net.hidden
        for d, tape, part in (("f", tf, dh[:, :, :h]), ("b", tb, dh[:, :, h:])):
            gx, gu = np.zeros_like(self.w[f"x{d}"]), np.zeros_like(self.w[f"u{d}"])
            ds, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for k, gate, cand, old, th, before in reversed(tape):
                ds = ds + part[k]
                dc = dc + ds * gate[:, 2 * h :] * (1 - th * th)
                dz = np.concatenate([dc * cand, dc * old, ds * th], 1) * gate * (1 - gate)
                dz = np.concatenate([dz, dc * gate[:, :h] * (1 - cand * cand)], 1)
                np.add.at(gx, c[:, k], dz)
                gu += before.T @ dz
                ds, dc = dz @ self.w[f"u{d}"].T, dc * gate[:, h : 2 * h]
            g |= {f"x{d}": gx, f"u{d}": gu}
        return float((z - gold).mean()), g

    def train(self, examples: list[tuple[str, list[Span]]]) -> Tagger:
        """Adam over random crops of the labelled texts; the same examples and seed give the same weights."""
        net = self.net
        rng = np.random.default_rng(net.seed + 1)
        coded = [(classes(text), tags(len(text), spans)) for text, spans in examples if text]
        m, v = ({k: np.zeros_like(w) for k, w in self.w.items()} for _ in range(2))
        for step in range(1, net.steps + 1):
            c, y = np.full((net.batch, net.train_length), CLASSES - 1, np.int64), np.zeros((net.batch, net.train_length), np.int64)
            for row in range(net.batch):
                text, tag = coded[rng.integers(len(coded))]
                at = int(rng.integers(0, max(1, len(text) - net.train_length + 1)))
                n = min(net.train_length, len(text) - at)
                c[row, :n], y[row, :n] = text[at : at + n], tag[at : at + n]
                if y[row, 0] and y[row, 0] % 2 == 0:
                    y[row, 0] -= 1  # the crop cut off what came first
            _, g = self.loss(c, y)
            size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            rate = net.rate * (1 - 0.9 * step / net.steps)
            for k, x in g.items():
                x = x * min(1.0, 5 / max(size, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                self.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def decode(self, c: np.ndarray) -> np.ndarray:
        """The best tags of each window (Viterbi)."""
        e, _ = self.emissions(c)
        t, score = self.w["t"] + self.bar, self.w["s"] + self.bar_first + e[0]
        back = np.empty(e.shape, np.int8)
        for k in range(1, len(e)):
            via = score[:, :, None] + t
            back[k] = via.argmax(1)
            score = via.max(1) + e[k]
        out = np.empty(c.shape, np.int8)
        out[:, -1] = score.argmax(1)
        for k in range(len(e) - 1, 0, -1):
            out[:, k - 1] = back[k][np.arange(len(c)), out[:, k]]
        return out


def tags(n: int, spans: list[Span]) -> np.ndarray:
    y = np.zeros(n, np.int64)
    for start, kind, end in spans:
        y[start:end] = 2 + 2 * kind
        y[start] = 1 + 2 * kind
    return y


def generated(seed: int, n: int = 1500) -> list[tuple[str, list[Span]]]:
    """Texts of invented words with labelled spans of many spellings, and numbers that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    digits = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    part = ["an", "er", "th", "ou", "lo", "mi", "sta", "ver", "que", "ción", "é", "ß", "ung", "re", "eau", "ing", "tion", "ka", "pfu", "ñor"]
    word = lambda: "".join(pick(part) for _ in range(rng.integers(1, 4)))
    plain = lambda: "".join(c for c in word() if c.isascii()) or "ab"

    def email() -> str:
        at, dot = pick([("@", "."), (" (at) ", "."), (" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "(dot)"), (" @ ", ".")])
        return f"{plain()}{pick(['', '.', '_'])}{pick([plain(), digits(2)])}{at}{plain()}{dot}{pick(['com', 'org', 'example.com', 'net', 'de'])}"

    def ip() -> str:
        if rng.random() < 0.4:
            return ":".join(f"{x:x}" for x in rng.integers(0, 65536, 8))
        return pick([".", " . ", "[.]"]).join(str(x) for x in rng.integers(0, 256, 4))

    def card() -> str:
        body = digits(15)
        body += next(str(d) for d in range(10) if luhn(body + str(d)))
        sep = pick(["", " ", "-", ".", "/"])
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {a} {b} {c}", f"00{digits(2)} {a} {b} {c}", f"0{a} / {b} {c}"])

    def other() -> str:
        return pick([lambda: digits(rng.integers(1, 9)), lambda: f"{rng.integers(1900, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}", lambda: f"token = \"{rng.bytes(20).hex()}\"", lambda: f"{digits(2)}.{digits(2)}", lambda: f"{rng.integers(1, 9)}.{digits(1)}.{digits(1)}", lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"p. {digits(3)}-{digits(3)}", lambda: f"#{digits(4)}", lambda: f"@{plain()}", lambda: f"{digits(1)},{digits(3)},{digits(3)}", lambda: f"{plain()}{digits(2)}", lambda: f"CC BY-NC {digits(1)}.{digits(1)}"])()

    make, out = (email, ip, card, phone), []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.integers(1, 4)):
            text += "".join(word() + pick([" ", " ", " ", ", ", ". ", "\n"]) for _ in range(rng.integers(0, 9)))
            if rng.random() < 0.6:
                kind = int(rng.integers(0, 4))
                s = make[kind]()
                spans.append((len(text), kind, len(text) + len(s)))
                text += s
            else:
                text += other()
            text += pick([" ", ". ", ", ", "\n", " or ", " and "])
        text += word()
        out.append((text.upper(), spans) if rng.random() < 0.1 and "ß" not in text else (text, spans))
    return out


@lru_cache(maxsize=4)
def default_tagger(net: Net = Net()) -> Tagger:
    return Tagger(net).train(generated(net.seed))


def windows(text: str, net: Net) -> list[tuple[int, int, int, int]]:
    """(start, end, first, last) of overlapping windows around all anchors; a window speaks for spans that begin in [first, last)."""
    out: list[tuple[int, int, int, int]] = []
    areas: list[list[int]] = []
    reach = max(net.context, net.window // 2)  # a span that fits in the overlap of two windows lies in the area of its anchor
    for m in _ANCHOR.finditer(text):
        lo, hi = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if areas and lo <= areas[-1][1]:
            areas[-1][1] = max(hi, areas[-1][1])
        else:
            areas.append([lo, hi])
    half = net.window // 2
    for lo, hi in areas:
        starts = [lo, *range(lo + half, max(lo + half, hi - half), half)] if hi - lo > net.window else [lo]
        for k, s in enumerate(starts):
            out.append((s, min(hi, s + net.window), s if not k else s + half // 2, hi if k == len(starts) - 1 else s + half + half // 2))
    return out


def spans_of(decoded: np.ndarray, at: int) -> list[Span]:
    """The spans that a row of tags spells, moved by ``at``."""
    out, k = [], 0
    for k in np.flatnonzero(decoded % 2 == 1):
        kind, end = (int(decoded[k]) - 1) // 2, k + 1
        while end < len(decoded) and decoded[end] == 2 + 2 * kind:
            end += 1
        out.append((at + int(k), kind, at + int(end)))
    return out


def owned(parts: list[tuple[tuple[int, int, int, int], list[Span]]]) -> list[Span]:
    """The spans that count, of the windows of a text in order and the spans that each spells."""
    out: list[Span] = []
    before = -1  # where the window before ends
    for (s, e, first, last), spans in parts:
        late = [x for x in spans if x[0] < first and s < before < x[2]]
        for x in late:
            # What the window before cut at its end gives way, or is joined with the rest if it began before this window.
            out = [y for y in out if not (y[2] == before and y[0] >= s and x[0] < y[2])]
        out += late + [x for x in spans if first <= x[0] < last]
        before = e
    return out


def find(texts: list[str | None], tagger: Tagger) -> Iterator[tuple[list[Span], list[Span]]]:
    """Of each text: the base spans, and all spans."""
    net = tagger.net
    todo = [(i, w) for i, t in enumerate(texts) if t for w in windows(t, net)]
    found: dict[int, list[tuple[tuple[int, int, int, int], list[Span]]]] = {}
    for at in range(0, len(todo), 1024):
        part = todo[at : at + 1024]
        c = np.full((len(part), net.window), CLASSES - 1, np.int64)
        for row, (i, (s, e, _, _)) in enumerate(part):
            c[row, : e - s] = classes(texts[i][s:e])
        for (i, w), row in zip(part, tagger.decode(c), strict=True):
            found.setdefault(i, []).append((w, spans_of(row[: w[1] - w[0]], w[0])))
    for i, text in enumerate(texts):
        base = base_spans(text) if text else []
        yield base, reconcile(text, base, owned(found[i])) if i in found else base


def reconcile(text: str, base: list[Span], more: list[Span]) -> list[Span]:
    out: list[Span] = []
    for s in sorted(more):
        if out and out[-1][1] == s[1] and s[0] <= out[-1][2]:
            out[-1] = (out[-1][0], s[1], max(s[2], out[-1][2]))
        elif not out or s[0] >= out[-1][2]:
            out.append(s)
    ends, free = 0, []
    bounds = sorted((b[0], b[2]) for b in base)
    for s in out:
        while ends < len(bounds) and bounds[ends][1] <= s[0]:
            ends += 1
        if not any(b[0] < s[2] and s[0] < b[1] for b in bounds[ends : ends + 4]) and valid(text, s[1], s[0], s[2]):
            free.append(s)
    return sorted([*base, *free])


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    docs = bounded_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(tagger or default_tagger())
    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            rows = []
            for at in range(0, b.num_rows, 256):
                for base, every in find(b.column(1).slice(at, 256).to_pylist(), model):
                    kinds = [k for _, k, _ in base]
                    rows.append((*(kinds.count(k) for k in range(len(KINDS))), hashlib.sha256(_written(base).encode()).hexdigest(), _written(every)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], pa.int64() if i < len(KINDS) else pa.string()) for i in range(len(names)))], ["doc_id", *names])

    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return own.mapInArrow(scan, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} {'long' if n.startswith('n_') else 'string'}" for n in names))


def redact(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; texts without spans stay as they are."""
    docs = bounded_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(tagger or default_tagger())
    at, count = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    @trimmed
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            n = b.column(count).to_pylist() if count is not None else [None] * len(texts)
            for k in range(0, len(texts), 256):
                for i, (_, spans) in enumerate(find(texts[k : k + 256], shared.value), k):
                    if spans:
                        texts[i] = masked(texts[i], spans)
                        n[i] = len(texts[i])
            out = pa.table(b).set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
            if count is not None:
                out = out.set_column(count, b.schema.field(count), pa.array(n, b.schema.field(count).type))
            yield from out.to_batches()

    docs = docs.withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(clean, docs.schema)


def masked(text: str, spans: list[Span]) -> str:
    parts, end = [], 0
    for start, kind, stop in spans:
        if start >= end:
            parts += [text[end:start], f"<{KINDS[kind]}>"]
        end = max(end, stop)
    return "".join([*parts, text[end:]])
