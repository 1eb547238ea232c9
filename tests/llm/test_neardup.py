import random

import numpy as np
from pyspark.sql import functions as F

from docengine.llm import golay, neardup

SCHEMA = "chunk_id string, raw_md_fragment string, text_for_embedding string, tid int, text int"


def test_golay_code():
    parity, lead, count = golay._tables()
    words = np.arange(4096) | parity << 12
    weights = np.array([int(w).bit_count() for w in words])
    assert sorted(set(weights.tolist())) == [0, 8, 12, 16, 24] and set(count.tolist()) == {1, 6}
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 24, 3000)
    a, valid = golay.nearby(x)
    distance = [(int(w) ^ int(words[i])).bit_count() for w, row, ok in zip(x, a, valid, strict=True) for i in row[ok]]
    assert max(distance) <= 4
    b, valid_b = golay.nearby(x ^ (1 << rng.integers(0, 24, len(x))))
    assert ((a[:, :, None] == b[:, None, :]) & valid[:, :, None] & valid_b[:, None, :]).any((1, 2)).all()


def _brute(rows, k=3, threshold=0.6, least=30):
    sets = []
    for cid, raw, emb, *_ in rows:
        text = raw if raw is not None else emb.split("\n\n", 1)[1] if emb and "\n\n" in emb else ""
        w = neardup.words(text)
        if cid is not None and len(w) >= least:
            sets.append((cid, frozenset(zip(*(w[i:] for i in range(k)), strict=False))))
    out = set()
    for i, (a, s) in enumerate(sets):
        for b, t in sets[i + 1 :]:
            if a != b and len(s & t) / len(s | t) >= threshold:
                out.add((min(a, b), max(a, b)))
    return out


def test_pairs_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for base in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(31, 200))]
        rows.append((f"b{base}", " ".join(words), None, 1, 2))
        for v in range(rng.randint(0, 3)):
            edited = list(words)
            for _ in range(rng.randint(0, len(words) // 18)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            if rng.random() < 0.4:  # a moved passage
                cut = rng.randrange(len(edited))
                edited = edited[cut:] + edited[:cut]
            rows.append((f"b{base}v{v}", None if v == 2 else " ".join(edited), "Doc\n\n" + " ".join(edited), 1, 2))
    rows += [rows[0], ("copy", rows[0][1].upper(), None, 0, 0), ("short", "a b c", None, 0, 0), ("null", None, None, 0, 0), (None, rows[0][1], None, 0, 0), ("empty", "", "x", 0, 0)]
    rows += [("long1", "far away from everything " * 60_000, None, 0, 0), ("long2", "far away from everything " * 60_000 + "end", None, 0, 0)]
    want = _brute(rows)
    got = {tuple(r) for r in neardup.near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and ("long1", "long2") in got


def test_empty_and_many_copies(spark):
    assert neardup.near_duplicate_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(f"c{i:03}", text, None, 0, 0) for i in range(60)] + [("other", text + " tail", None, 0, 0)]
    got = neardup.near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA))
    assert got.count() == 61 * 60 // 2
    assert got.where(F.col("chunk_id_a") >= F.col("chunk_id_b")).count() == 0


def test_components_equal_union_find(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(45)] + [(7, 7), (0, 1)]
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["node"]: r["label"] for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(n, n) == root(n) for n in parent)


def test_classes(spark):
    base = [f"t{i}" for i in range(60)]
    rows = [("a", " ".join(base), None, 0, 0), ("b", " ".join([*base[:57], "x", "y", "z"]), None, 0, 0), ("c", " ".join(base), None, 0, 0), ("d", " ".join(f"u{i}" for i in range(60)), None, 0, 0)]
    got = {r["chunk_id"]: (r["class_id"], r["links"]) for r in neardup.duplicate_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["a"] == got["b"] == got["c"] and got["a"][1] == 1 and got["d"][1] == 0 and got["d"][0] != got["a"][0]


def test_join_rows_do_not_depend_on_the_partitions(spark, monkeypatch):
    rng = random.Random(6)
    base = [rng.choice("abcdefghij") + str(rng.randint(0, 300)) for _ in range(80)]
    rows = [("x", " ".join(base)), ("y", " ".join([*base[:40], "new", *base[41:]]))] * 50
    counts = []
    for n in (1, 4, 16):
        texts = spark.createDataFrame(rows, "chunk_id string, text string").withColumn("tid", F.xxhash64("text")).repartition(n)
        keys = neardup.distinct_texts(texts).mapInPandas(neardup._key_rows(3, 30), neardup._KEYS)
        counts.append(neardup.shared_keys(keys).count())
    assert counts[0] == counts[1] == counts[2] > 0
    monkeypatch.setattr(neardup, "HOT_KEY", 1)  # every key of both texts is crowded: joined in blocks
    assert neardup.shared_keys(keys).count() == counts[0]
