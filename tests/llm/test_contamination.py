import random

from docengine.llm import contamination as c


def _brute(docs, items):
    windows = lambda w: {tuple(w[i : i + c.MIN_RUN]) for i in range(len(w) - c.MIN_RUN + 1)}
    held = [(i, windows(c.words(t))) for i, t in items]
    return {(d, i) for d, t in docs for i, s in held if windows(c.words(t)) & s}


def test_leaks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(c, "BITS", 1 << 16)  # many shingles share a place
    rng = random.Random(4)
    vocabulary = ["Über", "the", "of", "x1", "straße", "loan", "bank", "rate", "is", "to"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(5, 60))) for i in range(40)] + [(90, None), (91, ""), (92, "short"), (1, "again " + text(30))]
    docs = []
    for d in range(120):
        body = text(rng.randint(0, 80))
        if d % 3 == 0:
            w = (items[rng.randrange(40)][1]).split()
            cut = rng.randint(15, 40)
            body = f"{body}. {' - '.join(w[:cut]).upper()} {text(5)}"
        docs.append((d, body))
    docs += [(500, None), (501, ""), (502, items[3][1] * 2), (502, items[3][1] * 2), (503, (text(30) + " ") * 3_000), (None, items[3][1] + items[5][1]), (2**60 + 1, "x " + items[7][1] * 2)]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, item_id int, at int")
    ev = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    want = _brute(docs, [(i, t) for i, t in items])
    got = [(r["doc_id"], r["item_id"]) for r in c.leaks(df, ev).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert c.leaks(df, ev.limit(0)).count() == 0 and c.leaks(df.limit(0), ev).count() == 0
