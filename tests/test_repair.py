from docengine.operators import chunking as C
from docengine.operators import repair as P
from pyspark.sql import functions as F


def _lines(spark, *texts):
    return spark.createDataFrame([(k, i, line) for k, t in enumerate(texts) for i, line in enumerate(t)], "k int, line_no int, line string")


def _repaired(step, spark, *texts):
    rows = step(_lines(spark, *texts), ["k"]).orderBy("k", "line_no").collect()
    return [[r["line"] for r in rows if r["k"] == k] for k in range(len(texts))], [r["repair"] for r in rows if r["repair"]]


def test_tables(spark):
    got, repairs = _repaired(P.repair_tables, spark, ["| a | b |", "| 1 | 2 |", "", "| x |", "text"], ["| a |", "| --- |", "| 1 |"], ["---", "a | b", "c | d"], [None, ""])
    assert got == [["| a | b |", "| --- | --- | --- |", "| 1 | 2 |", "", "| x |", "text"], ["| a |", "| --- |", "| 1 |"], ["---", "a | b", "| --- |", "c | d"], [None, ""]]
    assert repairs == ["table_repair"] * 2


def test_lists(spark):
    got, repairs = _repaired(P.repair_lists, spark, ["- a", "* b", "  more", "2. c", "end", "  indented"], ["1. x", "1. y"], ["  loose", "+ p", "- q"])
    assert got == [["- a", "- b more", "- c", "end", "  indented"], ["1. x", "1. y"], ["  loose", "+ p", "+ q"]]
    assert repairs == ["list_repair"] * 3


def test_sections(spark):
    got, repairs = _repaired(P.repair_sections, spark, ["text", "Key Terms:", "# Head", "Summary:", "", "Notes:", "lower:"], ["First:"])
    assert got == [["text", "", "Key Terms:", "# Head", "Summary:", "", "Notes:", "lower:"], ["First:"]]
    assert repairs == ["section_repair"]


def test_driver(spark):
    texts = spark.createDataFrame([(1, "# T\na | b\nc | d\n-- page 2 --\n- x\n* y"), (2, None), (3, ""), (4, "plain")], "k int, text string")
    got = {r["k"]: r for r in P.repair_text(texts, ["k"], "text").collect()}
    assert set(got) == {1, 3, 4} and got[1]["repaired"] == "# T\na | b\n| --- |\nc | d\n--- Page 2 ---\n- x\n- y"
    assert (got[1]["table_repairs"], got[1]["list_repairs"], got[1]["structure_confidence"]) == (1, 1, 0.65) and got[4]["structure_confidence"] == 1.0


def test_pages_that_run_on(spark):
    cases = [
        (["He said"], ["that it"], True, False), (["He said."], ["that it"], False, False), (["a:"], ["b"], True, False), (["a"], ["# H"], False, False),
        (["- a."], ["- b."], True, True), (["| a |"], ["| b |"], True, True), (["| a |"], ["| --- |"], False, False), (["[IMAGE] x."], ["# y"], True, True), ([""], ["x"], False, False), ([], ["x"], False, False),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(cases)], "i int, a array<string>, b array<string>")
    got = df.select("i", C.may_continue(F.col("a"), F.col("b")).alias("m"), C.may_continue(F.col("a"), F.col("b"), "low").alias("l")).orderBy("i").collect()
    assert [(bool(r["m"]), bool(r["l"])) for r in got] == [c[2:] for c in cases]


def test_tiny_chunks_merge_with_any_prose(spark):
    rows = [("d", 0, "a", 20, 1, 1, "table"), ("d", 1, "b", 300, 1, 3, "Paragraph"), ("d", 2, "c", 30, 2, 9, "table"), ("d", 3, "e", 40, 3, 9, "listelement"), ("d", 4, "f", 10, 6, 9, "mixed")]
    chunks = spark.createDataFrame(rows, "doc_id string, ord int, chunk_id string, tokens int, first_page int, last_page int, element_type string")
    got = sorted((r["merged_from"], r["element_type"]) for r in C.merge_tiny(chunks).collect())
    assert got == [(["a", "b"], "mixed"), (["c"], "table"), (["e"], "listelement"), (["f"], "mixed")]
