import zipfile

from docengine.sources import readers, sinks
from docengine.streaming.ingest import stream_latest


def test_office_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:p/></w:document>')
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>x</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", "<worksheet><sheetData/></worksheet>")
    with zipfile.ZipFile(tmp_path / "c.pptx", "w") as z:
        z.writestr("ppt/slides/slide1.xml", '<p xmlns:a="a"><sp><ph type="title"/><a:p><a:t>T</a:t></a:p></sp><sp><a:p><a:t>body</a:t></a:p></sp></p>')
    (tmp_path / "d.html").write_text("<div><p>one<h1>two</h1></div>")
    (tmp_path / "e.docx").write_bytes(b"broken")
    got = [(r["path"][-6:], r["page_index"], r["block_type"], r["level"], r["text"], r["cells"]) for r in readers.read_office(spark, str(tmp_path)).collect()]
    kinds = {g[:5] for g in got}
    assert {("a.docx", 0, "title", 2, "Head"), ("a.docx", 0, "text", None, "Body"), ("c.pptx", 0, "title", 1, "T"), ("c.pptx", 0, "text", None, "body"), ("d.html", 0, "text", None, "one"), ("d.html", 0, "title", 1, "two")} <= kinds
    assert any(g[2] == "error" and g[0] == "e.docx" for g in got)
    assert [g[5] for g in got if g[0] == "b.xlsx"] == [[["x", "", "5"]]]


def test_text_and_csv(spark, tmp_path):
    (tmp_path / "a.md").write_text("para one\nmore\n# Head\ntext\n\nlast")
    got = [(r["block_type"], r["level"], r["text"]) for r in readers.read(spark, str(tmp_path / "a.md")).orderBy("block_ord").collect()]
    assert got == [("text", None, "para one more"), ("title", 1, "Head"), ("text", None, "text"), ("text", None, "last")]
    (tmp_path / "b.csv").write_text("x,y\n1,\n")
    assert readers.read(spark, str(tmp_path / "b.csv")).first()["cells"] == [["x", "y"], ["1", ""]]
    names = ["zeta", "alpha", "mid", *(f"r{i * 7919 % 1000}" for i in range(3000))]
    (tmp_path / "c.csv").write_text("name\n" + "\n".join(names) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert [c[0] for c in readers.read(spark, str(tmp_path / "c.csv")).first()["cells"]] == ["name", *names]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_upsert_and_stream(spark, tmp_path):
    schema = "namespace string, id string, values array<float>, v int"
    sinks.upsert_vectors(spark, spark.createDataFrame([("n", "a", [1.0], 1), ("n", "", [1.0], 1), ("n", "b", [], 1)], schema), str(tmp_path / "t"), "v")
    sinks.upsert_vectors(spark, spark.createDataFrame([("n", "a", [2.0], 2), ("n", "c", [3.0], 1)], schema), str(tmp_path / "t"), "v")
    assert sinks.latest_version(spark, str(tmp_path / "t")) == 1
    stored = lambda: sorted((r["id"], r["values"]) for r in sinks.read_vectors(spark, str(tmp_path / "t")).collect())
    assert stored() == [("a", [2.0]), ("c", [3.0])]
    many = spark.range(300).selectExpr("'n' namespace", "concat('k', id) id", "array(cast(id as float)) values", "1 v").select(*[c.split()[0] for c in schema.split(", ")])
    sinks.upsert_vectors(spark, many, str(tmp_path / "t"), "v")
    sinks.upsert_vectors(spark, spark.createDataFrame([("n", "k7", [0.5], 2), ("n", "a", [9.0], 1)], schema), str(tmp_path / "t"), "v")
    assert len(stored()) == 302 and ("k7", [0.5]) in stored() and ("a", [2.0]) in stored()
    assert len([x for x in (tmp_path / "t" / "v=3").iterdir() if x.name.startswith("vector_bucket=")]) == 2 and sinks.read_vectors(spark, str(tmp_path / "none")) is None
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "k int, t int")
    rows.write.parquet(str(tmp_path / "s"))
    assert sorted(map(tuple, stream_latest(spark, str(tmp_path / "s"), rows.schema, ["k"], "t").collect())) == [(1, 2), (2, 1)]
