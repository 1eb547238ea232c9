import random

from pyspark.sql import functions as F

from docengine.operators.shapes import greedy_pairs, header_path, pack_fill, skip_fill, slice_starts


def _greedy(ok):
    groups, i, g = [], 0, 0
    while i < len(ok):
        g += 1
        groups.append(g)
        if ok[i] and i + 1 < len(ok):
            groups.append(g)
            i += 1
        i += 1
    return groups


def test_greedy_pairs_equals_the_loop(spark):
    rng = random.Random(1)
    cases = [[rng.random() < 0.6 for _ in range(rng.randint(1, 12))] for _ in range(60)]
    rows = [(d, i, ok) for d, case in enumerate(cases) for i, ok in enumerate(case)]
    df = spark.createDataFrame(rows, "d int, i int, ok boolean")
    got = {(r["d"], r["i"]): r["merge_group"] for r in greedy_pairs(df, ["d"], ["i"], F.col("ok")).collect()}
    assert all([got[d, i] for i in range(len(case))] == _greedy(case) for d, case in enumerate(cases))


def test_header_path_equals_the_stack(spark):
    rng = random.Random(2)
    rows = [(d, i, rng.choice([None, 1, 2, 3, 6]), f"t{i}") for d in range(30) for i in range(rng.randint(1, 15))]
    df = spark.createDataFrame(rows, "d int, i int, level int, title string")
    got = {(r["d"], r["i"]): r["header_path"] for r in header_path(df, ["d"], ["i"], "level", "title").collect()}
    stack, doc = [], None
    for d, i, level, title in rows:
        if d != doc:
            stack, doc = [], d
        if level:
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, title))
        assert got[d, i] == (" > ".join(t for _, t in stack) or None)


def test_fills(spark):
    one = spark.createDataFrame([([5, 6, 7, 2],)], "sizes array<int>")
    items = F.transform("sizes", lambda x: F.struct(x.alias("size")))
    row = one.select(skip_fill(items, 13).alias("keep"), skip_fill(items, 1, 3).alias("forced"), pack_fill(F.col("sizes"), 11).alias("packs")).first()
    assert row["keep"] == [True, True, False, True]
    assert row["forced"] == [True, True, True, False]
    assert row["packs"] == [0, 0, 1, 1]


def test_slices_keep_a_contained_last_window(spark):
    df = spark.createDataFrame([(20,), (0,), (1,)], "n int").select("n", slice_starts(F.col("n"), 20, 2).alias("s"))
    assert {r["n"]: r["s"] for r in df.collect()} == {20: [0, 18], 0: [], 1: [0]}
