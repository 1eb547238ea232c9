import datetime as dt
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docengine.functions import bitmaps
from docengine.operators import orphans
from docengine.operators.orphans import chunk_reference_orphans, orphan_references


@given(st.sets(st.integers(0, bitmaps.SPAN - 1), max_size=300), st.integers(0, 60000), st.integers(0, 5000), st.sets(st.integers(0, bitmaps.SPAN - 1), max_size=300))
@settings(max_examples=60, deadline=None)
def test_bitmaps(a, start, length, b):
    a = a | set(range(start, min(bitmaps.SPAN, start + length)))
    left = bitmaps.decode(bitmaps.and_not(bitmaps.encode(np.array(sorted(a))), bitmaps.encode(np.array(sorted(b)))))
    assert left.tolist() == sorted(a - b)
    assert bitmaps.decode(bitmaps.encode(np.arange(bitmaps.SPAN))).tolist() == list(range(bitmaps.SPAN))


def test_orphans_equal_brute_force(spark):
    rng = random.Random(3)
    start = dt.datetime(2023, 11, 20)
    at = lambda: start + dt.timedelta(hours=rng.randint(0, 24 * 90))
    keys = [f"k{i}" for i in range(40)] + ["hot"] * 30
    events = [(rng.choice(keys), at(), rng.randint(0, 1)) for _ in range(300)] + [(None, at(), 0), ("k1", None, 1)]
    refs = [("t", str(i), rng.choice([*keys, "never"]), at()) for i in range(500)] + [("t", "n1", None, at()), ("t", "n2", "k1", None)]
    want = set()
    for _, ref, key, t in refs:
        if key and t:
            past = [(e, dead) for k, e, dead in events if k == key and e and e <= t]
            if not past or max(past)[1]:
                want.add(ref)
    r = spark.createDataFrame(refs, "ref_table string, ref_key string, key string, t timestamp_ntz")
    e = spark.createDataFrame(events, "key string, t timestamp_ntz, dead int")
    assert {x["ref_key"] for x in orphan_references(r, e, 3).collect()} == want


def test_uneven_ids_empty_tables_and_clashing_columns(spark):
    t = dt.datetime(2024, 1, 5)
    chunks = spark.createDataFrame([("a", " P1 ", t, 1), ("a", " P1 ", t, 1), ("b", "p2", t, 2), ("c", None, t, 3), ("d", "", t, 4)], "chunk_id string, parent_id string, ingested_at timestamp_ntz, key int")
    parents = spark.createDataFrame([("p1", t)], "chunk_id string, ingested_at timestamp_ntz")
    tomb = spark.createDataFrame([], "chunk_id string, deleted_at timestamp_ntz")
    cites = spark.createDataFrame([], "citation_id long, chunk_id string, created_at timestamp_ntz")
    cands = spark.createDataFrame([(1, "parents", "A", t)], "candidate_id long, namespace string, chunk_id string, retrieved_at timestamp_ntz")
    got = chunk_reference_orphans(chunks, parents, tomb, cites, cands)
    assert sorted(map(tuple, got.collect())) == [("candidates", "1", "2024-01"), ("chunks", "b", "2024-01")]


@given(st.sets(st.integers(0, 300_000), max_size=200), st.sets(st.integers(0, 300_000), max_size=200), st.integers(0, 200_000), st.integers(0, 60_000))
@settings(max_examples=40, deadline=None)
def test_bitmaps_of_any_positions(a, b, start, length):
    b = b | set(range(start, start + length))
    a = a | set(range(start + length // 2, start + length // 2 + 9000))
    x, y = (bitmaps.encode_any(np.array(sorted(s), dtype=np.int64)) for s in (a, b))
    assert bitmaps.decode_any(bitmaps.and_not_any(x, y)).tolist() == sorted(a - b)


def test_a_key_with_a_million_references_in_a_day(spark, monkeypatch):
    monkeypatch.setattr(orphans, "HOT", 100_000)
    day = "timestamp_ntz'2024-03-05 00:00:00'"
    refs = spark.range(1_000_000).selectExpr("'t' ref_table", "cast(id as string) ref_key", "'hot' key", f"{day} + make_dt_interval(0, 0, 0, id % 86400) t")
    events = spark.createDataFrame([("hot", dt.datetime(2024, 1, 1), 0), ("hot", dt.datetime(2024, 3, 5, 6), 1), ("hot", dt.datetime(2024, 3, 5, 12), 0)], "key string, t timestamp_ntz, dead int")
    assert orphan_references(refs, events, 2).count() == sum(6 * 3600 <= i % 86400 < 12 * 3600 for i in range(1_000_000))
