from docengine.functions import tables as B
from docengine.functions import text as T
from docengine.operators import layout as L
from docengine.operators import retrieval as R
from docengine.operators import template as E
from pyspark.sql import functions as F


def test_conversions(spark):
    html = "<table class='x'><TR><th>a &amp; b</th><th scope='col'>c</th></TR>\n<tr><td><b>1</b>\n2</td><td></td></tr><tr></tr></table>"
    row = spark.createDataFrame([(html, "```md\n| a | b |\n| --- | :-: |\n|1|\n text\n```", None)], "html string, md string, none string").select(
        B.html_cells(F.col("html")).alias("h"), B.markdown_cells(F.col("md")).alias("m"), B.cells_markdown(B.markdown_cells(F.col("md"))).alias("t"), B.html_cells(B.cells_html(B.html_cells(F.col("html")))).alias("again"),
        B.table_signature(B.html_cells(F.col("html"))).alias("s"), B.html_cells(F.col("none")).alias("n"), B.cells_markdown(B.html_cells(F.lit(""))).alias("e"), B.split_cells(F.lit(" a b   c\t\td ")).alias("c"),
    ).first()
    assert row["h"] == [["a & b", "c"], ["1 2", ""]] == row["again"] and row["m"] == [["a", "b"], ["1"]]
    assert row["t"] == "| a | b |\n| --- | --- |\n| 1 |  |" and row["s"] == "table_2x2" and row["n"] is None and row["e"] is None and row["c"] == ["a b", "c", "d"]


def test_tables_merge_by_head_or_word(spark):
    head = [["a", "b"]]
    rows = [("d", 0, [*head, ["1", "2"]], None), ("d", 1, [*head, ["3", "4"]], None), ("d", 2, [["x"]], None), ("d", 3, [["y"], ["z"]], "Fees (continued)"), ("d", 4, [["q"]], None)]
    got = L.merge_table_cells(spark.createDataFrame(rows, "doc string, n int, cells array<array<string>>, title string"), ["doc"], "n").orderBy("merge_group").collect()
    assert [r["cells"] for r in got] == [[["a", "b"], ["1", "2"], ["3", "4"]], [["x"], ["y"], ["z"]], [["q"]]]


def test_page_coverage(spark):
    cols = "page int, x0 double, y0 double, x1 double, y1 double"
    native = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.5), (2, 0.0, 0.0, 1.0, 1.0), (3, 0.0, 0.0, 1.0, 1.0)], cols)
    seen = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.3), (1, 0.0, 0.2, 1.0, 0.5), (2, 0.0, 0.0, 0.5, 1.0), (4, 0.1, 0.1, 0.1, 0.1)], cols)
    got = {r["page"]: (r["common"], r["covered"], r["strategy"]) for r in L.page_strategies(native, seen, ["page"]).collect()}
    assert got == {1: (500_000, 500_000, "FAST"), 2: (500_000, 1_000_000, "HI_RES"), 3: (0, 1_000_000, "FAST"), 4: (0, 0, "HI_RES")}


def test_template(spark):
    cells = [["Item", "Amount"], ["Fee", ""], ["", "___"], [None, "5"]]
    rows = spark.createDataFrame([("t", r, c, v) for r, line in enumerate(cells) for c, v in enumerate(line)], "t string, row int, col int, cell string")
    fields = E.cell_fields(rows, ["t"])
    got = {(r["row"], r["col"]): (r["name"], r["context"], r["field_type"]) for r in fields.collect()}
    assert got == {
        (1, 1): ("Fee", "Row header: Fee | Column header: Amount | Previous: Fee", "empty_cell"), (2, 0): ("Item", "Column header: Item", "empty_cell"),
        (2, 1): ("Amount", "Column header: Amount", "underscore_line"), (3, 0): ("Item", "Column header: Item", "empty_cell"),
    }
    values = spark.createDataFrame([("1/1", "$5", "Doc: d | P1-1"), ("2/1", None, None), ("9/9", "x", "y")], "field_id string, value string, citation string")
    out = E.filled(rows, fields.withColumn("field_id", F.concat_ws("/", "row", "col")), values, ["t"])
    assert {(r["row"], r["col"]): r["cell"] for r in out.where("col = 1").collect()} == {(0, 1): "Amount", (1, 1): "$5 [Doc: d | P1-1]", (2, 1): "", (3, 1): "5"}
    text = spark.createDataFrame([(1, "Loan amount: ____ and ☐ Yes ☐ No"), (2, None)], "k int, text string")
    assert {(r["name"], r["type"]) for r in E.text_fields(text, ["k"], "text").collect()} == {("Loan amount", "currency"), ("Yes", "checkbox"), ("No", "checkbox")}


def test_values_and_pools(spark):
    cases = [("1,000", "1000.0", True), ("a ", "a", True), ("1", "2", False), (None, "x", None), ("1", "one", False)]
    df = spark.createDataFrame(cases, "a string, b string, want boolean").select(T.same_value(F.col("a"), F.col("b")).alias("got"), "want")
    assert all(r["got"] == r["want"] for r in df.collect())
    a = spark.createDataFrame([("d", 1, "x")], "doc_id string, m int, only string")
    b = spark.createDataFrame([("unknown", "s")], "doc_id string, m string")
    pool = R.chunk_pool(a, b)
    assert pool.columns == ["doc_id", "only", "kind"] and {r["kind"] for r in pool.collect()} == {"child", "parent"}
    assert [r["doc_id"] for r in R.all_doc_ids(a, b).collect()] == ["d"]
    assert R.ingest_stats(spark.createDataFrame([], "token_count int"), b).first().asDict() == {"children": 0, "parents": 1, "avg_tokens": 0.0}
