import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_on_planted_documents(spark, tmp_path):
    rng = random.Random(1)
    vocab = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7))) for _ in range(2000)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = say(20)
    rows, labels = [], []
    for i in range(240):
        text = say(80)
        if i % 4 == 0:
            text += " zorgle vimquat zorgle"
        rows.append([i, text, "en", f"s{i % 3}", len(text)])
        labels.append((i, 1, int(i % 4 == 0)))
    rows[1][1] = rows[5][1] + " extra"  # a near copy: 1 stays, 5 goes
    rows[2][1] += " " + passage
    rows[3][1] = passage
    rows[6][1] += " write to me.you@mail7.example.com"
    rows.append([900, None, None, None, None])
    rows.append([901, "zorgle and vimquat of " + say(40), "en", "s0", 1])
    d = str(tmp_path)
    spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != "mixing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        seen.append({r[0]: r for r in docs.collect()})
    tox, near, clean, pii, mix = seen
    assert not any(i in tox for i in [*range(0, 240, 4), 901]) and len(tox) == 181
    assert set(tox) - set(near) == {5} and all(near[i] == tox[i] for i in near)
    assert set(near) - set(clean) == {3} and clean[2]["text"] == rows[2][1].removesuffix(passage) and all(clean[i] == near[i] for i in clean if i != 2)
    assert pii[6]["text"].endswith("write to <email>") and pii[6]["n_chars"] == len(pii[6]["text"])
    assert all(pii[i]["text"] == clean[i]["text"] for i in pii if i != 6)
    assert set(mix) == set(pii) and abs(sum(r["taken"] for r in mix.values()) / sum(r["size"] for r in mix.values()) - 1) < 0.1
    assert {r[0] for r in corpus_pipeline.run(spark, d).select("doc_id").collect()} == set(mix)
