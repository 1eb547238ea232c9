import random

import numpy as np

from docengine.llm import packing


def test_pack_against_the_bound():
    rng = random.Random(1)
    for n in (0, 1, 5, 300):
        sizes = np.array([rng.randint(1, 100) for _ in range(n)], dtype=np.int64)
        texts = [" ".join(rng.choice(("red", "blue", "green", "x1", "x2", "x3")) for _ in range(s)) for s in sizes]
        number = packing.pack(texts, sizes, 100)
        fill = np.bincount(number, weights=sizes) if n else np.zeros(0)
        assert (number >= 0).all() and (fill <= 100).all()
        if n == 300:
            assert len(fill) <= 1.05 * np.ceil(sizes.sum() / 100)


def test_bm25_equals_the_formula():
    texts = ["a b b c", "b d", "", "e e a"]
    index = packing.Bm25(texts)
    docs = [t.split() for t in texts]
    average = max(1.0, sum(map(len, docs)) / 4)
    want = []
    for doc in docs:
        score = 0.0
        for w in {"a", "b", "c"}:
            df = sum(w in x for x in docs)
            tf = doc.count(w)
            score += np.log1p((4 - df + 0.5) / (df + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(doc) / average)) if tf else 0
        want.append(score)
    assert np.allclose(index.scores(0), want)


def test_documents_round_trip(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(("ä", "loan", "x,", "--")) for _ in range(rng.randint(0, 70))), 5) for i in range(200)]
    rows += [(900, None, 5), (901, "", 5), (902, " \n\t", 5), (903, "w " * 1000, 5), (903, "w " * 1000, 5), (904, "k " * 64, 5), (905, "long" * 300_000, 5), (None, "no id", 5), (2**60 + 1, "big id", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = packing.pack_documents(df, 64).collect()
    text = {d: t or "" for d, t, _ in rows}
    fill: dict = {}
    for r in got:
        part = text[r["doc_id"]][r["start"] : r["stop"]]
        assert len(packing._TOKEN.findall(part)) == r["tokens"]
        assert (r["container"] is None) == (r["tokens"] == 0)
        if r["container"]:
            fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
    assert max(fill.values()) <= 64
    assert sum(r["tokens"] for r in got) == sum(len(packing._TOKEN.findall(t or "")) for _, t, _ in rows)
    assert {r["doc_id"] for r in got if r["parts"] > 1} == {d for d, t, _ in rows if len(packing._TOKEN.findall(t or "")) > 64}
    assert {r["doc_id"] for r in got} == set(text)
    assert packing.pack_documents(df.limit(0), 64).count() == 0


def test_packing_does_not_depend_on_the_partitions_and_cuts_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 50)
    rng = random.Random(3)
    rows = [(i, "one hot text of a copied record" if i % 3 == 0 else " ".join(rng.choice(("loan", "bank", "rate", "fee", "term")) for _ in range(rng.randint(1, 20)))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = ({(r["container"], r["doc_id"]) for r in packing.pack_documents(df.repartition(n), 64).collect()} for n in (1, 7))
    assert a == b
    shards: dict = {}
    for container, doc in a:
        if doc % 3 == 0:
            shards[container.split("-")[0]] = shards.get(container.split("-")[0], 0) + 1
    assert max(shards.values()) <= 4 * 50


def test_rare_words_bring_documents_together():
    from docengine.llm.words import WordIds

    ids, counts = WordIds(), np.zeros(packing.TABLE, dtype=np.int64)
    texts = [f"the common words of all and tractor{i % 5} plough{i % 5} harrow{i % 5} alone{i}" for i in range(50)]
    for t in texts:
        np.add.at(counts, (packing._ids(t, ids) % np.uint64(packing.TABLE)).astype(np.int64), 1)
    keys = [packing._lexical_key(t, ids, counts) for t in texts]
    assert all((keys[i] == keys[j]) == (i % 5 == j % 5) for i in range(50) for j in range(50))
