import json

import pytest
from docengine.functions import providers
from docengine.operators import layout as L
from docengine.sources import readers, sinks, state
from pyspark.sql import functions as F


def test_progress(spark, tmp_path):
    p = state.Progress(spark, str(tmp_path / "jobs"))
    assert p.names() == []
    p.save("a", "x.pdf", 1, 49, "hi_res", [{"pages": 50}])
    p.save("a", "x.pdf", 2, 99)
    p.save("b", "y.pdf", 0, 0)
    assert p.names() == ["a", "b"] and p.load("a")["last_page"] == 99 and p.load("a")["version"] == "1.0"
    assert p.delete("a") and not p.delete("a") and p.names() == ["b"]
    with pytest.raises(FileNotFoundError):
        p.load("a")
    with pytest.raises(ValueError):
        p.load("../b")


def test_artifacts_images_ranges_and_settings(spark, tmp_path):
    sinks.write_run(spark.createDataFrame([("f", 1)], "field_id string, value int"), str(tmp_path / "runs"), "r1", "fields")
    assert state.read_artifact(spark, str(tmp_path / "runs"), "r1", "fields").first()["value"] == 1 and state.read_artifact(spark, str(tmp_path / "runs"), "r2", "fields") is None
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "a.png").write_bytes(b"png")
    (tmp_path / "i" / "b.txt").write_text("no")
    assert [bytes(r["content"]) for r in state.read_images(spark, str(tmp_path / "i")).collect()] == [b"png"]
    pages = spark.range(5).withColumnRenamed("id", "page")
    count = lambda *a: state.pages_in_range(pages, "page", *a).count()
    assert (count(1, 3), count(3, 99), count(2), count(7, 9)) == (2, 2, 3, 0)
    changes = spark.createDataFrame([("f", "added")], "field_id string, change string")
    for _ in range(2):
        state.write_delta_log(changes, str(tmp_path / "log"), "r1")
    assert spark.read.json(str(tmp_path / "log" / "delta")).count() == 2
    (tmp_path / "env").write_text("# note\nSIZE=7\nNAME='x y'\nOTHER=1\nbroken\n")
    got = state.settings({"SIZE": 1, "NAME": None, "ON": False, "RATE": 0.5}, str(tmp_path / "env"), {"ON": "true", "RATE": "2", "HOME": "h"})
    assert got == {"SIZE": 7, "NAME": "x y", "ON": True, "RATE": 2.0} and state.settings({"A": 1}, str(tmp_path / "none"), {}) == {"A": 1}


def test_writers(spark, tmp_path):
    chunks = spark.createDataFrame([("d1", "a", "t"), ("d2", "b", "u"), ("d2", "", "skipped")], "doc_id string, chunk_id string, text string")
    sinks.write_chunks(chunks, str(tmp_path / "c"))
    sinks.write_chunks(spark.createDataFrame([("d2", "c", "v")], "doc_id string, chunk_id string, text string"), str(tmp_path / "c"))
    assert {(r["doc_id"], r["chunk_id"]) for r in spark.read.parquet(str(tmp_path / "c")).collect()} == {("d1", "a"), ("d2", "c")}
    sinks.write_jsonl(chunks, str(tmp_path / "j.jsonl"))
    assert readers.read(spark, str(tmp_path / "j.jsonl")).count() == 3


def test_provider_seam(spark, tmp_path):
    log = tmp_path / "calls"

    def call(values):
        with open(log, "a") as f:
            f.write(json.dumps(values) + "\n")
        if "bad" in values:
            raise RuntimeError("no")
        return [v.upper() for v in values]

    rows = spark.createDataFrame([("a",), ("b",), ("a",), (None,), ("bad",)], "t string").coalesce(1)
    got = [r["answer"] for r in providers.provided(rows, "t", call, batch=2, retries=1, wait=0).collect()]
    assert got == ["A", "B", "A", None, None]
    assert [json.loads(x) for x in log.read_text().splitlines()] == [["a", "b"], ["bad"], ["bad"]]


def test_recursive_reading_order(spark):
    boxes = [("title", 0, 0, 10, 1), ("l1", 0, 2, 4, 3), ("l2", 0, 4, 4, 6), ("r1", 6, 2, 10, 5), ("r2", 6, 5.5, 10, 6), ("foot", 0, 7, 10, 8)]
    df = spark.createDataFrame([("p", k, float(a), float(b), float(c), float(d)) for k, a, b, c, d in boxes], "page string, id string, x0 double, y0 double, x1 double, y1 double")
    assert [r["id"] for r in L.xy_cut(df, ["page"], "id").orderBy("place").collect()] == ["title", "l1", "l2", "r1", "r2", "foot"]
    points = df.select("page", F.concat("id", F.lit("?")).alias("text"), *[(F.col(c) * 1000).alias(c) for c in ("x0", "y0", "x1", "y1")])
    blocks = df.select("page", "id", *[(F.col(c) * 1000).alias(c) for c in ("x0", "y0", "x1", "y1")])
    extra = spark.createDataFrame([("p", "empty", 90_000.0, 90_000.0, 91_000.0, 91_000.0)], "page string, id string, x0 double, y0 double, x1 double, y1 double")
    filled = {r["id"]: r["filled"] for r in L.filled_blocks(blocks.unionByName(extra), points, ["page"], "id").collect()}
    assert filled == {**{k: f"{k}?" for k, *_ in boxes}, "empty": None}
