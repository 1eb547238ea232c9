from docengine.operators import layout as L


def test_cells_are_made_before_the_join(spark):
    """Over large pages the pairs are many times the texts: above the join nothing may be split."""
    box = "x0 double, y0 double, x1 double, y1 double"
    tables = spark.createDataFrame([(1, 7, 0.0, 0.0, 1.0, 1.0), (1, 8, 0.0, 0.0, 0.5, 1.0)], f"page int, table_id int, {box}")
    texts = [(1, "a  b\tc "), (2, " one "), (3, " "), (4, None), (5, "d e")]
    spans = [(1, k, x, 0.0, x + 0.4, 0.5, text) for k, text in texts for x in (0.3,)]
    got = L.table_texts(tables, spark.createDataFrame(spans, f"page int, id int, {box}, text string"), ["page"], "id")
    above = got._jdf.queryExecution().optimizedPlan().toString().split("Join ")[0]
    assert "Generate" not in above and "split" not in above
    rows = {(r["table_id"], r["id"], r["nth"], r["cell"]) for r in got.collect()}
    # well inside 7; half over 8
    assert rows == {(7, 1, 0, "a"), (7, 1, 1, "b"), (7, 1, 2, "c"), (7, 2, 0, "one"), (7, 5, 0, "d e"), (8, 1, 0, "a  b\tc"), (8, 2, 0, "one"), (8, 3, 0, ""), (8, 4, 0, None), (8, 5, 0, "d e")}
    edges = {(r["nth"], round(r["x0"], 6), round(r["x1"], 6)) for r in got.where("table_id = 7 and id = 1").collect()}
    assert edges == {(0, 0.3, 0.433333), (1, 0.433333, 0.566667), (2, 0.566667, 0.7)}


def test_rows_of_a_text_follow_each_other(spark):
    """Over large pages the texts pass by the tables, not the tables by the texts: what repeats stands together,
    and the tasks aren't put together by the size of what is shuffled, as the rows are many times as many."""
    box = "x0 double, y0 double, x1 double, y1 double"
    tables = spark.createDataFrame([(1, t, 0.0, 0.0, 1.0, 1.0) for t in range(40)], f"page int, table_id int, {box}")
    spans = spark.createDataFrame([(1, k, 0.1, 0.1, 0.2, 0.2, f"a  {k}") for k in range(40)], f"page int, id int, {box}, text string")
    got = L.table_texts(tables, spans, ["page"], "id")
    rows = [(r["id"], r["nth"]) for r in got.collect()]
    assert len(rows) == 40 * 40 * 2
    assert sum(a != b for a, b in zip([None, *rows], rows)) == 40 * 2
    assert got.rdd.getNumPartitions() == L.TASKS * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_boxes_without_an_area_hold_and_give_no_cells(spark):
    box = "x0 double, y0 double, x1 double, y1 double"
    tables = spark.createDataFrame([(1, 7, 0.0, 0.0, 1.0, 1.0), (1, 8, 1.0, 0.0, 0.0, 1.0), (1, 9, None, 0.0, 1.0, 1.0)], f"page int, table_id int, {box}")
    spans = spark.createDataFrame([(1, 1, 0.2, 0.2, 0.2, 0.4, "a"), (1, 2, 0.4, 0.2, 0.2, 0.4, "b"), (1, 3, 0.2, None, 0.4, 0.4, "c"), (1, 4, 0.2, 0.2, 0.4, 0.4, "d")], f"page int, id int, {box}, text string")
    assert [(r["table_id"], r["id"], r["cell"]) for r in L.table_texts(tables, spans, ["page"], "id").collect()] == [(7, 4, "d")]
