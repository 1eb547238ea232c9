import pytest
from pyspark.sql import functions as F

from docengine.functions import geometry as G
from docengine.functions import text as T
from docengine.operators import chunking as C
from docengine.operators import layout as L


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_text_functions(spark):
    lit = F.lit
    meta = T.base_meta(lit("d1"), lit("paragraph"), lit(1), lit(1), lit("A"))
    row = one(
        spark, T.content_id(lit("hello"), meta), T.normalize_page_markers(lit("x -- page 3 -- y")), T.sanitize_cell(lit(" a|b \n c ")), T.escape_markdown(lit("a*b")),
        T.worst_status(lit("pass|ERROR")), T.field_type(lit("Loan amount")), T.embedding_prefix(lit("d"), lit(1), lit(2), lit(None).cast("string"), lit("S")), T.is_list_block(lit("- a\n- b\nc")),
        T.fenced_json(lit('x ```json\n{"a": 1}\n``` y')),
    )
    assert list(row) == ["9dd483db4d594a91", "x --- Page 3 --- y", "a b c", "a\\*b", "error", "currency", "Document: d | Pages: 1-2 | Section: S", True, '{"a": 1}']


def test_geometry(spark):
    b = lambda *v: G.Box(*[F.lit(float(x)) for x in v])
    a, c = b(0, 0, 2, 2), b(1, 1, 3, 3)
    row = one(spark, G.iou(a, c), G.overlap_ratio(a, c), G.distance(b(0, 0, 1, 1), b(4, 5, 6, 7)), G.iou(a, b(5, 5, 6, 6)), G.overlaps(a, b(2, 2, 3, 3)), G.contains(a, b(1, 1, 2, 2)))
    assert list(row) == [pytest.approx(1 / 7), 0.25, 5.0, 0.0, True, True]


def test_page_split(spark):
    text = "pre\n--- Page 1 ---\na\n--- Page 2 ---\nb"
    df = C.lines(spark.createDataFrame([("d", text), ("e", "only")], "doc string, text string"), ["doc"], "text")
    got = {(r["doc"], r["page_no"]): r["lines"] for r in C.page_blocks(df, "doc").collect()}
    assert got == {("d", 1): ["a"], ("d", 2): ["b"], ("e", 1): ["only"]}


def test_structure_confidence(spark):
    c = [F.lit(x) for x in (2, 1, 1, 0)]
    row = one(spark, C.structure_confidence(*c, F.lit(True)), C.structure_confidence(F.lit(0), *c[1:], F.lit(True)))
    assert list(row) == [0.65, 1.0]


def test_suppress_equals_the_loop(spark):
    rows = [(1, 0.9, 0.0, 0.0, 1.0, 1.0), (2, 0.8, 0.0, 0.0, 1.0, 0.99), (3, 0.7, 0.5, 0.5, 1.5, 1.5), (4, 0.7, 2.0, 2.0, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "id int, score double, x0 double, y0 double, x1 double, y1 double").withColumn("page", F.lit(1))
    assert sorted(r["id"] for r in L.suppress(L.cleaned_boxes(df), ["page"], "id", 0.9).collect()) == [1, 3]


def test_tables(spark):
    text = "intro\n| a | b |\n| --- | --- |\n| 1 |\n| 2 | 3 | 4 |"
    df = C.lines(spark.createDataFrame([("k", text)], "k string, text string"), ["k"], "text")
    assert L.clean_tables(df, ["k"]).first()["table"] == "| a | b |  |\n| --- | --- | --- |\n| 1 |  |  |\n| 2 | 3 | 4 |"


def test_sentence_windows_lose_nothing(spark):
    text = " ".join(f"Sentence number {i} is here." for i in range(300))
    got = C.sentence_windows(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, text string"), ["k"], "text", 100, 3).where("k = 1").orderBy("window").collect()
    assert got[0]["first"] == 0 and got[-1]["last"] == 299
    assert all(b["first"] == a["last"] - 2 for a, b in zip(got, got[1:], strict=False))
