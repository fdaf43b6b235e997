"""Byte-pair encoding and decoding with a tokenization automaton.

The merges of a tokenizer file are compiled into a deterministic automaton over tokens. It accepts exactly the token sequences that
encoding can give, so a word's encoding is the one path whose labels spell the word. It starts as one state with an arc back to itself
for each symbol, and takes one gadget a merge, in order. The gadget of (u, v) finds the state q that all arcs labelled u enter. If q
has an arc labelled v, the pair can still stand side by side, and then:

* a copy of q without its arc labelled v is made, and all arcs labelled u enter the copy from now on;
* each state that has an arc labelled u gets one labelled uv, into the state that the arc labelled v led to.

Arcs are never listed one by one. A copy is kept as its parent and the one arc that it lost, and the arcs labelled uv follow from those
labelled u at that moment, so an automaton has as many states as merges and one entry a state. ``Automaton.has`` looks an arc up.

Encoding reads a word's symbols by a table of token prefixes and goes on along arcs only: every beginning of a word has one path, so
each place in a word has one state, and the work grows with the word's length. Decoding emits the labels of the arcs.

Defined cases: a null text is an empty one and has no tokens; the empty text has none; texts of any length are encoded whole, words of
any length too; repeated rows are encoded each for itself; strings of special tokens in a text become those tokens, as with the
tokenizers library; ids that no token has are left out by decoding, as that library does; an empty table gives an empty result; all
columns of the input are passed through but for those that bear the names of the new ones.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import bounded_batches, give_back

#: What a worker remembers: so many runs, words and arcs each, of so many characters at most. A memory that is full is emptied.
REMEMBERED, REMEMBERED_LENGTH = 250_000, 40
#: The automaton is sent to every worker; a file beyond this is refused. Public vocabularies have 30,000 to 300,000 merges.
MOST_MERGES = 2_000_000
#: White space as the tokenizers' patterns see it.
SPACES = r"[\t-\r \x85\xa0  -     　]+"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if it is one, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


@dataclass
class Automaton:
    """States are numbered by age, 0 is the first. ``n`` tokens; symbols are the tokens that no merge makes."""

    n: int
    enters: list[int] = field(default_factory=list)  # token -> state that all arcs with this label enter
    born: list[int] = field(default_factory=list)  # token -> number of states when its arcs came; -1: it has no arcs
    first: list[int] = field(default_factory=list)  # token -> the token whose arcs its own were put beside; -1 for symbols
    owner: list[int] = field(default_factory=list)  # state -> token whose arcs entered it when it was made
    base: list[int] = field(default_factory=list)  # token -> state that its arcs entered at first
    lost: dict[int, int] = field(default_factory=dict)  # owner * n + label -> state, the first of the owner's without this arc

    @classmethod
    def of(cls, n: int, merges: list[tuple[int, int, int]]) -> Automaton:
        """From merges (u, v, uv), each gadget on top of those before it."""
        a = cls(n, [0] * n, [0] * n, [-1] * n, [-1], [0] * n, {})
        for _, _, w in merges:
            a.born[w] = -1
        for u, v, w in merges:
            if not a.has(a.enters[u], v) or a.born[u] < 0 or a.born[v] < 0:
                continue  # the two never stand side by side: nothing to merge, and no arcs for w
            after = a.enters[v]
            a.owner.append(u)
            copy = len(a.owner) - 1
            a.lost[u * n + v] = copy
            a.enters[u] = copy
            a.born[w], a.first[w] = copy + 1, u
            a.enters[w] = a.base[w] = after
        return a

    def has(self, state: int, label: int) -> bool:
        """Is there an arc?

        A state lacks one that it or a state it was copied from has lost. A label younger than the loss shares it, as its arcs were
        put beside those of its first part: so the loss of a first part counts if it is older than the label.
        """
        n, lost, born, first, owner, base = self.n, self.lost, self.born, self.first, self.owner, self.base
        if born[label] < 0:
            return False
        while state:
            token, x, until = owner[state], label, state
            while x >= 0:
                at = lost.get(token * n + x)
                if at is not None and at <= until:
                    return False
                until = min(until, born[x] - 1)
                x = first[x]
            state = base[token]
        return True


@dataclass
class Bpe:
    """A tokenizer file in compiled form: what encoding and decoding need, and no more."""

    labels: list[str]
    merges: list[tuple[int, int, int]]
    specials: dict[str, int]
    pattern: str
    end: str

    @classmethod
    def read(cls, text: str) -> Bpe:
        """From the JSON of a tokenizer file that normalises by NFC, spaces and lower case, splits by one pattern and merges byte letters."""
        made = json.loads(text)
        model, steps = made["model"], [x["type"] for x in made["normalizer"]["normalizers"]]
        split, letters = made["pre_tokenizer"]["pretokenizers"]
        odd = {k: model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)}
        if model["type"] != "BPE" or odd or steps != ["NFC", "Replace", "Lowercase"] or (split["type"], split["behavior"], split["invert"]) != ("Split", "Removed", True):
            raise ValueError("a tokenizer of another kind")
        if letters["type"] != "ByteLevel" or letters["use_regex"] or letters["add_prefix_space"] or made["decoder"] or made["post_processor"]:
            raise ValueError("a tokenizer of another kind")
        if any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in made["added_tokens"]):
            raise ValueError("special tokens of another kind")
        if len(model["merges"]) > MOST_MERGES:
            raise ValueError(f"more than {MOST_MERGES} merges")
        ids = model["vocab"] | {x["content"]: x["id"] for x in made["added_tokens"]}
        labels = [""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            labels[i] = token
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        merges = [(ids[u], ids[v], ids[u + v]) for u, v in pairs]
        if len({w for _, _, w in merges}) < len(merges):
            raise ValueError("two merges make one token")
        return cls(labels, merges, {x["content"]: x["id"] for x in made["added_tokens"]}, split["pattern"]["Regex"], model["end_of_word_suffix"] or "")


class Lately(dict):
    """What ``make`` gave for the keys met lately, as packed ids; it is emptied when it is full."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        made = self.make(key)
        if len(key) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = made
        return made


class Coder:
    """Texts to ids. Runs between blanks and words met lately are remembered; the automaton is asked for others."""

    def __init__(self, bpe: Bpe) -> None:
        self.n, self.arcs = len(bpe.labels), Automaton.of(len(bpe.labels), bpe.merges)
        self.split, self.spaces, self.odd_spaces = regex.compile(bpe.pattern).findall, re.compile(SPACES), re.compile("[\x1c-\x1f]")
        #: Does the pattern take a run of letters as one word?
        self.letters_are_words = bpe.pattern.startswith(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|")
        self.specials = bpe.specials
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(bpe.specials, key=len, reverse=True))) + ")") if bpe.specials else None
        ids = {t: i for i, t in enumerate(bpe.labels) if i not in bpe.specials.values()}
        # Symbols are bytes, and where words have an ending of their own, 256 + byte for the last one.
        self.ending = 256 if bpe.end else 0
        codes = {ids[c + end]: b + more for end, more in {"": 0, bpe.end: self.ending}.items() for b, c in enumerate(byte_letters()) if c + end in ids}
        self.unknown = {b + more for b in range(256) for more in (0, self.ending)} - set(codes.values())
        symbols = {i: (code,) for i, code in codes.items()}
        for u, v, w in bpe.merges:
            symbols[w] = symbols[u] + symbols[v]
        #: The table of token prefixes: prefix * 512 + symbol -> longer prefix. Of a prefix: the token that it is, or -1; its length; and the
        #: longest prefix that is a token, itself allowed or not.
        self.table, self.token, self.length, self.longest, self.shorter = {}, [-1], [0], [0], [0]
        above = [0]
        for t, spelt in symbols.items():
            if self.arcs.born[t] < 0:
                continue
            at = 0
            for s in spelt:
                before, at = at, self.table.setdefault(at * 512 + s, len(self.token))
                if at == len(self.token):
                    self.token.append(-1)
                    self.length.append(self.length[before] + 1)
                    above.append(before)
            self.token[at] = t
        for at in range(1, len(above)):  # what is above is older
            self.shorter.append(self.longest[above[at]])
            self.longest.append(at if self.token[at] >= 0 else self.shorter[at])
        #: Arcs looked up lately: state * n + label -> whether there is one.
        self.known: dict[int, bool] = {}
        self.words = Lately(self.word)
        self.runs = Lately(self.run)

    def run(self, run: str) -> bytes:
        if self.letters_are_words and run.isascii() and run.isalpha():
            return self.words[run]
        return b"".join(map(self.words.__getitem__, self.split(run)))

    def word(self, word: str) -> bytes:
        symbols = [*word.encode()]
        symbols[-1] += self.ending
        if self.unknown:
            symbols = [s for s in symbols if s not in self.unknown]
        return array("i", self.path(symbols)).tobytes()

    def path(self, symbols: list[int]) -> list[int]:
        """The labels of the one path that spells the symbols.

        The longest label comes first at each place, and where no arc leads on, the path goes back. A place has one state however it is
        reached, so a place without a way on is tried once.
        """
        n, width, table, token, known = len(symbols), self.n, self.table, self.token, self.known
        length, longest, shorter, enters = self.length, self.longest, self.shorter, self.arcs.enters
        if len(known) > REMEMBERED:
            known.clear()
        path, dead, at, state = [], set(), 0, 0
        while at < n:
            prefix, j = 0, at
            while j < n and (longer := table.get(prefix * 512 + symbols[j])) is not None:
                prefix = longer
                j += 1
            way = longest[prefix]
            while True:
                while way:  # the labels that spell what comes here, longer ones first
                    end = at + length[way]
                    if end not in dead:
                        arc = state * width + token[way]
                        if (there := known.get(arc)) is None:
                            there = known[arc] = self.arcs.has(state, token[way])
                        if there:
                            break
                    way = shorter[way]
                if way:
                    break
                dead.add(at)
                at, state, way = path.pop()
                way = shorter[way]
            path.append((at, state, way))
            at, state = end, enters[token[way]]
        return [token[way] for _, _, way in path]

    def plain(self, text: str) -> bytes:
        """The packed ids of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # Character by character where it matters: Python's own lower case looks around a capital sigma.
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        else:
            text = text.lower()
        # Python counts four separators as blanks that the patterns don't.
        runs = text.split() if self.odd_spaces.search(text) is None else self.spaces.sub(" ", text).split(" ")
        return b"".join(map(self.runs.__getitem__, runs))

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, four bytes each."""
        if self.cut is None or not any(s in text for s in self.specials):
            return self.plain(text)
        return b"".join(array("i", [self.specials[x]]).tobytes() if k % 2 else self.plain(x) for k, x in enumerate(self.cut.split(text)))


#: This worker's coder, by the number of its broadcast.
_held: dict[int, Coder] = {}


def _coder(sent) -> Coder:
    key = id(sent.value)
    if key not in _held:
        _held.clear()
        _held[key] = Coder(sent.value)
    return _held[key]


def read(path: str) -> Bpe:
    """The tokenizer file at a path that the driver can open."""
    with open(path, encoding="utf-8") as f:
        return Bpe.read(f.read())


def _added(df: DataFrame, name: str, kind) -> tuple[DataFrame, StructType]:
    """``df`` without a column of that name, and its schema with it as the last."""
    df = df.drop(*[c for c in df.columns if c.lower() == name.lower()])
    return df, StructType([*df.schema.fields, StructField(name, kind)])


def encode(docs: DataFrame, bpe: Bpe, text: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` without its text and with the ids of each text."""
    sent = docs.sparkSession.sparkContext.broadcast(bpe)
    kept, schema = _added(docs.drop(text), to, ArrayType(IntegerType(), False))
    free = f"{text}_" * (1 + max(map(len, kept.columns), default=0))  # no other column's name, whatever they are
    rows = docs.select(*[F.col(f"`{c}`") for c in kept.columns], F.coalesce(F.col(text).cast("string"), F.lit("")).alias(free))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent)
        for b in batches:
            found = [coder.encode(x) for x in b.column(b.num_columns - 1).to_pylist()]
            ends = np.fromiter(accumulate(map(len, found), initial=0), np.int64, len(found) + 1) // 4
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids], [*b.schema.names[:-1], to])
        give_back()

    return bounded_batches(rows).mapInArrow(run, schema)


def decode(encoded: DataFrame, bpe: Bpe, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the text that its ids stand for: the labels of the arcs, with a blank between; null ids give an empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(bpe)
    rows, schema = _added(encoded, to, StringType())
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = pa.array(sent.value.labels, pa.large_string())
        known = pa.array([x != "" for x in sent.value.labels])
        for b in batches:
            col = b.column(at).fill_null([])
            ends, flat = np.concatenate([[0], np.cumsum(pc.list_value_length(col).to_numpy(zero_copy_only=False))]), col.flatten()
            named = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(labels))).fill_null(False)
            safe = pc.if_else(named, flat, 0)
            named = pc.and_(named, known.take(safe))
            kept = np.concatenate([[0], np.cumsum(named.to_numpy(zero_copy_only=False))])
            lists = pa.LargeListArray.from_arrays(pa.array(kept[ends], pa.int64()), labels.take(safe.filter(named)))
            text = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, text], [*b.schema.names, to])
        give_back()

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, bpe: Bpe) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: encoded, and decoded from the ids."""
    both = decode(encode(docs.select("doc_id", "text"), bpe), bpe)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
