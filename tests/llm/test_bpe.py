import random
import unicodedata

import pytest

from quarry.llm import bpe

P = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer
PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def model():
    return bpe.read(PATH)


def merged(symbols, ranks):
    """Merges the leftmost pair of the least rank until none is left."""
    out = list(symbols)
    while True:
        best = min(((ranks[p], i) for i, p in enumerate(zip(out, out[1:])) if p in ranks), default=None)
        if best is None:
            return out
        i = best[1]
        out[i : i + 2] = [out[i] + out[i + 1]]


def automaton(merges):
    """An automaton and token numbers from merges of strings."""
    symbols = "abc"
    ids = {t: i for i, t in enumerate([*symbols, *(u + v for u, v in merges)])}
    return bpe.Automaton.of(len(ids), [(ids[u], ids[v], ids[u + v]) for u, v in merges]), ids


def test_arcs_are_what_merging_gives():
    """A pair of tokens has an arc exactly if merging their text gives them back; for random merges, also of a symbol with itself."""
    rng = random.Random(5)
    for _ in range(60):
        tokens, merges = list("abc"), []
        while len(merges) < 14:
            u, v = rng.choice(tokens), rng.choice(tokens)
            if u + v not in tokens and len(u + v) < 9:
                merges.append((u, v))
                tokens.append(u + v)
        a, ids = automaton(merges)
        ranks = {p: k for k, p in enumerate(merges)}
        for s in tokens:
            alone = merged(s, ranks) == [s]
            assert (a.born[ids[s]] >= 0) == alone
            for t in tokens:
                if alone and merged(t, ranks) == [t]:
                    assert a.has(a.enters[ids[s]], ids[t]) == (merged(s + t, ranks) == [s, t]), (merges, s, t)


def test_one_state_a_merge(model):
    a = bpe.Automaton.of(len(model.labels), model.merges)
    assert len(a.owner) == len(model.merges) + 1 == len(a.lost) + 1


def texts():
    rng = random.Random(3)
    alphabets = ["ab", "aeiou", "abcdefghijklmnopqrstuvwxyz", "th eandis'sΣİé!?.,0123 \n\t\x1c\x85\xa0", "の漢字🙂👍🏽é­​ﬁ"]
    out = ["".join(rng.choice(alpha) for _ in range(rng.randint(0, 60))) for alpha in alphabets for _ in range(300)]
    out += [t[:9] + rng.choice(["<|endoftext|>", "<|startoftext|><|endoftext|>", "<|endof"]) + t[9:] for t in out[::7]]
    return out + ["", " ", "x", "don't I'LL WE'RE", "a" * 50_000, "ab" * 20_000, "long words " * 30_000, "ΑΣ ΟΔΟΣ Σ", "é 가"]


def test_equals_the_library(model):
    lib, coder = Tokenizer.from_file(PATH), bpe.Coder(model)
    for t in texts():
        assert memoryview(coder.encode(t)).cast("i").tolist() == lib.encode(t, add_special_tokens=False).ids, t[:80]


def test_memories_that_fill_up_change_nothing(model, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    test_equals_the_library(model)


def test_each_white_space(model):
    lib, coder = Tokenizer.from_file(PATH), bpe.Coder(model)
    for c in [*range(0x400), *range(0x1600, 0x1700), *range(0x2000, 0x2100), *range(0x3000, 0x3010)]:
        t = f"a{chr(c)}b"
        if unicodedata.category(chr(c)) != "Cn":  # libraries know different versions of Unicode
            assert memoryview(coder.encode(t)).cast("i").tolist() == lib.encode(t, add_special_tokens=False).ids, hex(c)


def test_whole_tables_and_columns(spark, model):
    lib = Tokenizer.from_file(PATH)
    rows = [(i, t, "kept", [1], "old") for i, t in enumerate(texts())] + [(-1, None, None, None, None), (-1, "twice", "x", [2], None), (-1, "twice", "x", [2], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Source string, IDS array<int>, decoded string")
    out = bpe.decode(bpe.encode(docs, model), model)
    assert out.columns == ["doc_id", "Source", "ids", "decoded"]
    got = sorted((r["doc_id"], str(r["Source"]), r["ids"], r["decoded"]) for r in out.collect())
    want = []
    for i, t, s, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, str(s), ids, lib.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    none = bpe.digests(spark.createDataFrame([], "doc_id long, text string"), model)
    assert none.count() == 0 and none.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_decoding_any_ids(spark, model):
    lib = Tokenizer.from_file(PATH)
    rows = [[5, 6, 7], [49406, 10**6, -3, 0, 49407], [], None, [None, 3]]
    out = bpe.decode(spark.createDataFrame([(r,) for r in rows], "ids array<int>"), model).collect()
    assert [r["decoded"] for r in out] == [lib.decode([i for i in r or [] if i is not None and i >= 0], skip_special_tokens=False) for r in rows]


def test_refuses_other_kinds():
    with pytest.raises((ValueError, KeyError, TypeError)):
        bpe.read(P.path("byte_bpe_50k.json"))


def test_digests(spark, model):
    import hashlib

    sf = "/root/testdata/sf0.001/documents.parquet"
    lib = Tokenizer.from_file(PATH)
    for r, d in zip(bpe.digests(spark.read.parquet(sf), model).orderBy("doc_id").collect(), spark.read.parquet(sf).orderBy("doc_id").collect(), strict=True):
        ids = lib.encode(d["text"] or "", add_special_tokens=False).ids
        assert tuple(r) == (d["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
