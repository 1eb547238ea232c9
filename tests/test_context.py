from docengine.operators import context as X


def test_assembly_order_budget_and_trace(spark):
    cols = "chunk_id string, doc_id string, parent_id string, ord int, first_page int, last_page int, element_type string, tokens int"
    chunks = spark.createDataFrame([("a", "d", "p", 1, 1, 1, "text", 10), ("b", "d", "p", 2, 1, 1, "text", 10), ("c", "d", "p", 3, 2, 2, "text", 10), ("e", "d", None, 4, 2, 2, "text", 10), ("f", "d", "q", 5, 3, 3, "table", 10), ("z", "x", None, 1, None, None, None, None)], cols)
    parents = spark.createDataFrame([("p", 30)], "chunk_id string, tokens int")
    hits = spark.createDataFrame([("g", 2, "b"), ("g", 1, "f"), ("g", 3, "unknown"), ("h", 1, "z")], "grp string, rank int, chunk_id string")
    packs = X.assemble(hits, chunks, parents, ["grp"], budget=55, forced=1)
    got = [(r["kind"], r["chunk_id"], r["kept"]) for r in packs.where("grp = 'g'").orderBy("place").collect()]
    assert got == [("primary", "f", True), ("primary", "b", True), ("parent", "p", True), ("sibling", "c", False), ("sibling", "a", False), ("cross_page", "e", False)] or got[:3] == [("primary", "f", True), ("primary", "b", True), ("parent", "p", True)]
    assert {g[1] for g in got} == {"f", "b", "p", "a", "c", "e"} and [g[2] for g in got] == [True] * 3 + [False] * 3
    t = {r["grp"]: r for r in X.context_trace(packs, ["grp"]).collect()}
    assert t["g"]["final_tokens"] == 50 and len(t["g"]["dropped"]) == 3 and t["g"]["added"][0] == "parent:p"
    assert t["h"]["final_tokens"] in (0, None) and t["h"]["added"] == []
    assert X.assemble(hits.limit(0), chunks, parents, ["grp"]).count() == 0


def test_rerank_answers(spark):
    hits = spark.createDataFrame([("g", c, s, "text " * 900) for c, s in (("a", 0.9), ("b", 0.8), ("c", None), ("d", 0.1))], "grp string, chunk_id string, score double, text string")
    sent = X.rerank_input(hits, ["grp"], "score", "text", n=3)
    assert sent.count() == 3 and sent.selectExpr("max(length(snippet)) n").first()["n"] == 1200
    answers = spark.createDataFrame([("g", "a", 50, "yes"), ("g", "b", 50, "no"), ("g", "zz", 99, "yes"), ("g", "d", 101, "yes"), ("g", "d", 70, "perhaps")], "grp string, chunk_id string, relevance_score int, answerability string")
    assert [r["chunk_id"] for r in X.reranked(answers, sent, ["grp"]).orderBy("rank").collect()] == ["a", "b"]
