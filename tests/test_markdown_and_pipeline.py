import numpy as np
from pyspark.sql import functions as F

from docengine import pipeline
from docengine.functions import providers
from docengine.operators import chunking as C
from docengine.operators import markdown as M
from docengine.operators import retrieval as R


def _lines(spark, text):
    return C.lines(spark.createDataFrame([("k", text)], "k string, text string"), ["k"], "text")


def test_model_markdown(spark):
    raw = "```markdown\n[TABLE]a\n\n\n\nb [HEADER]Head[/HEADER]\n[/TABLE]\n```"
    row = spark.range(1).select(M.clean_model_markdown(F.lit(raw)).alias("x")).first()
    assert row["x"] == "# Head\n\na\n\nb"


def test_page_windows_anchor(spark):
    df = spark.createDataFrame([("d", p, f"k{p}") for p in (1, 2, 3, 4, 9, 10)], "doc string, page int, key string")
    got = sorted((r["first_page"], r["last_page"], r["members"]) for r in M.page_windows(df, ["doc"]).collect())
    assert got == [(1, 3, 3), (4, 4, 1), (9, 10, 2)]


def test_embedding_is_deterministic(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta gamma"), (3, None), (4, "")], "i int, t string")
    got = {r["i"]: r["values"] for r in providers.embed(df, "t", 64).collect()}
    assert got[1] == got[2] and got[3] is None and abs(np.linalg.norm(got[1]) - 1) < 1e-6 and not any(got[4])


def test_pipeline(spark):
    text = "lead\n# One\nalpha beta\n-- page 2 --\n## Two\ngamma delta\n# Three\nomega"
    docs = spark.createDataFrame([("d", text), ("e", None)], "doc_id string, text string")
    children, parents = pipeline.chunk(docs)
    got = [(r["first_page"], r["last_page"], r["header_path"], r["text"]) for r in children.orderBy("ord").collect()]
    assert got == [(1, 1, "One", "lead\n# One\nalpha beta"), (2, 2, "One > Two", "## Two\ngamma delta"), (2, 2, "Three", "# Three\nomega")]
    assert parents.agg(F.sum("child_count")).first()[0] == 3
    packed = pipeline.query(pipeline.index(children), children, "gamma delta").orderBy("rank").collect()
    assert packed[0]["text"].startswith("## Two") and all(r["kept"] for r in packed)


def test_upsert_prefers_the_new_row(spark):
    old = spark.createDataFrame([("a", 1, "old"), ("b", 1, "old")], "id string, v int, x string")
    new = spark.createDataFrame([("a", 1, "new"), ("c", 1, "new")], "id string, v int, x string")
    assert sorted((r["id"], r["x"]) for r in R.upsert(old, new, ["id"], "v").collect()) == [("a", "new"), ("b", "old"), ("c", "new")]


def test_model_markdown_query_keeps_brackets_and_backticks(spark, tmp_path):
    from hashlib import md5

    from docengine.plans.markdown import model_markdown

    rows = [(1, "see [1] and `x`", "memo"), (2, "a\n```sql\nselect 1\n```\nb", "memo"), (3, "a [TABLE]| b |[/TABLE] c", "memo"), (4, "plain", "memo"), (5, None, "memo"), (6, "x", None)]
    spark.createDataFrame(rows, "doc_id long, text string, doc_type string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["cleaned_md5"] for r in model_markdown(spark, str(tmp_path)).collect()}
    want = {1: "see [1] and `x`", 2: "a\nselect 1\nb", 3: "a | b | c", 4: "plain"}
    assert got == {i: md5(f"# memo\n\n{t}".encode()).hexdigest() for i, t in want.items()}


def test_process_documents(spark):
    table = ["| n | v |", "| --- | --- |", *[f"| r{i} | {i} |" for i in range(30)]]
    prose = " ".join(f"Sentence number {i} of the long section says a little." for i in range(80))
    text = "\n".join(["-- page 1 --", "# Terms", "Short lead.", "", *table, "", "- item a", "* item b", "  and more", "-- page 2 --", "## Risks", prose, "[IMAGE]", "a chart", "", "its note", "[/IMAGE]", "tail"])
    docs = spark.createDataFrame([("d", text, 1), ("d", text, 1), ("n", None, 2), ("e", "", 3)], "doc_id string, text string, ord int")
    children, parents = pipeline.process_documents(docs)
    rows = children.orderBy("ord").collect()
    kinds = [r["element_type"] for r in rows]
    tables = [r for r in rows if "| n | v |" in r["text"]]
    assert len(tables) == 2 and all("| --- | --- |" in r["text"] for r in tables) and "| r18 | 18 |" in tables[0]["text"] and "| r18 | 18 |" in tables[1]["text"]
    assert sum(r["text"].count("| r5 | 5 |") for r in rows) == 1 and any("- item a\n- item b and more" in r["text"] for r in rows)
    windows = [r for r in rows if "Sentence number" in r["text"]]
    assert len(windows) >= 2 and all(r["tokens"] <= 2048 for r in rows) and all(f"Sentence number {i} " in "".join(r["text"] for r in windows) for i in range(80))
    assert any("[IMAGE]\na chart\n\nits note\n[/IMAGE]" in r["text"] for r in rows) and {"mixed"} <= set(kinds)
    ids = [r["chunk_id"] for r in rows]
    held = {r["parent_id"]: r for r in parents.collect()}
    assert len(set(ids)) == len(ids) and {r["doc_id"] for r in rows} == {"d"}
    assert sorted(c for p in held.values() for c in p["child_ids"]) == sorted(ids) and all(r["chunk_id"] in held[r["parent_id"]]["child_ids"] for r in rows)
    assert {p["parent_type"] for p in held.values()} == {"heading_based"}
    questions = spark.createDataFrame([("q", "a chart and its note")], "question_id string, question string")
    packs = pipeline.answer_context(pipeline.index(children), children, parents, questions).orderBy("place").collect()
    assert packs[0]["kind"] == "primary" and any("a chart" in r["text"] for r in packs) and any(r["kind"] == "parent" for r in packs)
    assert len({r["chunk_id"] for r in packs}) == len(packs)
