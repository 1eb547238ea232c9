import pandas as pd
from docengine.llm import scans
from pyspark.sql import functions as F

from tests.llm.test_scans import _pages


def test_classes_are_those_of_the_column(spark):
    words = ["insurance", "1oan", "rnodern", "wh|le", "$um", "ﬁnal", "dull", "straße", "m-n", "y0u", ""]
    rows = spark.createDataFrame([(w,) for w in words], "word string").select("word", scans.confusion_class(F.col("word")).alias("c")).collect()
    assert {r["word"]: r["c"] for r in rows} == {w: scans.class_of(w) for w in words}
    at_once = str.maketrans(scans._ALIKE | scans._AS_TWO)
    assert all(scans.class_of(w) == w.translate(at_once) for w in words)


def test_lines_are_made_distinct_once(spark):
    lines = scans.marked_lines(_pages(spark))
    above = lines._jdf.queryExecution().optimizedPlan().toString().split("Union")[0]
    assert above.count("Aggregate") == 1
    got = lines.collect()
    assert len(got) == len(set(got)) and set(got) == set(scans.marks(_pages(spark)).select(*lines.columns).collect()) and got


def test_running_lines_are_hashed_once(monkeypatch):
    folded = []
    monkeypatch.setattr(scans, "fold", lambda line, own=scans.fold: folded.append(line) or own(line))
    pages = pd.DataFrame({"doc_id": ["d"] * 5, "page_no": range(1, 6), "raw_lines": [["Acme Bank", "", None, "text", f"Page {n}"] for n in range(1, 6)]})
    edges, words = scans._read(iter([pages]))
    assert len(folded) == 3  # Acme Bank, text, a page number's rest
    assert edges["form"].nunique() == 2 and len(edges) == 30 and edges["first"].notna().sum() == 15
    assert set(words["word"].tolist()) >= {"acme", "bank", "text"} and words["zone"].isna().all()
    assert list(words.columns) == list(edges.columns) == [c.split()[0] for c in scans._SEEN.split(", ")]
