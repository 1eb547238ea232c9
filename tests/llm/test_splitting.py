import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docengine.llm.splitting import RangeMax, boundaries, cuts, oversized_chunk_pieces


@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.data())
@settings(max_examples=80, deadline=None)
def test_range_maximum_is_the_rightmost(values, data):
    lo = data.draw(st.integers(0, len(values) - 1))
    hi = data.draw(st.integers(lo + 1, len(values)))
    want = max(range(lo, hi), key=lambda i: (values[i], i))
    assert RangeMax(np.array(values)).argmax(lo, hi) == want


@given(st.text(alphabet="ab .\n|-é", max_size=400), st.integers(1, 60), st.integers(-2, 70))
@settings(max_examples=200, deadline=None)
def test_pieces_cover_the_text(text, limit, overlap):
    parts = cuts(text, limit, overlap)
    shared = max(0, min(overlap, (limit - 1) // 2))
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    assert all(b - a <= limit for a, b, _ in parts)
    assert all(q[0] == p[1] - shared for p, q in zip(parts, parts[1:], strict=False))
    assert text == "".join(text[a + (shared if i else 0) : b] for i, (a, b, _) in enumerate(parts))
    at, strength = boundaries(text)
    held = dict(zip(at.tolist(), strength.tolist(), strict=True))
    for a, b, kind in parts[:-1]:
        window = [held[p] for p in range(a + max(limit // 2, shared) + 1, a + limit + 1) if p in held]
        assert kind == max(window, default=0) and (kind == 0 or held[b] == kind)


def test_limits_of_files(spark):
    chunks = [("a", "d1", "x. " * 700, 1), ("a", "d1", "x. " * 700, 1), ("b", "d1", "y" * 1024, 1), ("c", "d2", "z" * 2049, 1), ("d", None, "q" * 2049, 1), ("e", "d1", None, 1), ("f", "d1", "", 1), ("g", "d1", "long word" * 200_000, 1)]
    c = spark.createDataFrame(chunks, "chunk_id string, doc_id string, raw_md_fragment string, target int")
    docs = spark.createDataFrame([("d1", "k"), ("d1", "k"), ("d2", "gone"), ("d3", None)], "doc_id string, config_id string").selectExpr("*", "timestamp_ntz'2024-01-01' parsed_at")
    k = spark.createDataFrame([("k", 256, 32)], "config_id string, prose_target_tokens int, prose_overlap_tokens int")
    rows = oversized_chunk_pieces(c, docs, k).collect()
    assert {r["chunk_id"] for r in rows} == {"a", "c", "d", "g"}
    assert len({(r["chunk_id"], r["piece_no"]) for r in rows}) == len(rows)
    assert all(r["tokens"] <= (256 if r["chunk_id"] in "ag" else 512) for r in rows)
    assert oversized_chunk_pieces(c.limit(0), docs, k).count() == 0 and oversized_chunk_pieces(c, docs.limit(0), k.limit(0)).count() > 0
