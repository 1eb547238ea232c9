"""Readers: files of many formats as rows of blocks.

All give ``path, page_index, block_ord, block_type, level, text, cells``. Office formats
are unpacked with the standard library, file by file, in ``mapInPandas``.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCKS = "path string, page_index int, block_ord int, block_type string, level int, text string, cells array<array<string>>"
_COLUMNS = [c.split()[0] for c in BLOCKS.split(", ")]
_BLOCK_TAGS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6"}


class _Leaves(HTMLParser):
    """Texts of the innermost block elements in document order; unclosed ones end where
    the next begins."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.tag: str | None = None
        self.text: list[str] = []

    def _flush(self) -> None:
        if self.tag:
            self.blocks.append((self.tag, "".join(self.text)))
        self.tag, self.text = None, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCK_TAGS:
            if self.tag and "".join(self.text).strip():
                self._flush()
            self.tag, self.text = tag, []

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK_TAGS and self.tag:
            self._flush()

    def handle_data(self, data: str) -> None:
        if self.tag:
            self.text.append(data)

    def close(self) -> None:
        super().close()
        self._flush()


def html_leaves(html: str) -> list[tuple[str, str]]:
    parser = _Leaves()
    parser.feed(html or "")
    parser.close()
    return parser.blocks


def html_blocks(df: DataFrame, key: str, html: str, keep_blank: bool = False) -> DataFrame:
    """Blocks of an HTML column: ``key, block_ord, tag, level, text``. Of nested block
    elements only the innermost count, so no text comes twice."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, page in pdf.itertuples(index=False):
                for i, (tag, text) in enumerate(html_leaves(page)):
                    if keep_blank or text.strip():
                        out.append((k, i, tag, int(tag[1]) if tag[0] == "h" else None, text.strip()))
            table = pd.DataFrame(out, columns=[key, "block_ord", "tag", "level", "text"])
            table["level"] = table["level"].astype("Int32")
            yield table

    return df.select(key, html).mapInPandas(run, f"`{key}` {kind}, block_ord int, tag string, level int, text string")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV file as string cells in column order, the header first: ``cells,
    is_row, place``; place (start of the row's split, number within it) orders the rows as
    the file does, and no row moves for it."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    place = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    cells = df.select(F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in df.columns]).alias("cells"), F.lit(1).alias("is_row"), place.alias("place"))
    head = spark.createDataFrame([(list(df.columns), 0, (-1, -1))], "cells array<string>, is_row int, place struct<start: long, row: long>")
    return head.unionByName(cells)


def read_csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file as one table block, whose cells are gathered in one row; ``read_csv`` keeps
    the rows of large files apart."""
    table = read_csv(spark, path).groupBy().agg(F.array_sort(F.collect_list(F.struct("place", "cells"))).alias("rows"))
    cells = F.transform("rows", lambda r: r["cells"])
    none = F.lit(None)
    return table.select(F.lit(path).alias("path"), F.lit(0).alias("page_index"), F.lit(0).alias("block_ord"), F.lit("table").alias("block_type"), none.cast("int").alias("level"), none.cast("string").alias("text"), cells.alias("cells"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Markdown and plain text: headings are titles of their level, blank lines end
    paragraphs, a heading ends the paragraph before it."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    rows = files.select("path", F.posexplode(F.split("text", "\r?\n", -1)).alias("i", "line"))
    level = F.when(F.col("line").rlike("^#{1,6} "), F.length(F.regexp_extract("line", "^(#+)", 1)))
    w = Window.partitionBy("path").orderBy("i")
    rows = rows.withColumn("level", level).withColumn("blank", F.trim("line") == "")
    before = F.lag("blank", 1, True).over(w) | F.lag("level").over(w).isNotNull()
    rows = rows.withColumn("block", F.sum((F.col("level").isNotNull() | before).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("not blank")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: F.trim(x["line"])), " ")
    blocks = rows.groupBy("path", "block").agg(F.max("level").alias("level"), text.alias("text"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("block")) - 1
    return blocks.select(
        "path", F.lit(0).alias("page_index"), place.alias("block_ord"), F.when(F.col("level").isNotNull(), "title").otherwise("text").alias("block_type"), "level",
        F.regexp_replace("text", "^#+ +", "").alias("text"), F.lit(None).cast("array<array<string>>").alias("cells"),
    )


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _texts(node: ElementTree.Element, name: str) -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) == name)


def _docx(path: str, data: bytes) -> list[tuple]:
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    out = []
    for p in (x for x in root.iter() if _local(x.tag) == "p"):
        text = _texts(p, "t").strip()
        if not text:
            continue
        style = next((v for x in p.iter() if _local(x.tag) == "pStyle" for k, v in x.attrib.items() if _local(k) == "val"), "")
        title = "heading" in style.lower() or "title" in style.lower()
        level = (int(style[-1]) if style[-1:].isdigit() else 1) if title else None
        out.append((path, 0, len(out), "title" if title else "text", level, text, None))
    return out


def _pptx(path: str, data: bytes) -> list[tuple]:
    z = zipfile.ZipFile(io.BytesIO(data))
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    out = []
    for page, name in enumerate(slides):
        k = 0
        for shape in (x for x in ElementTree.fromstring(z.read(name)).iter() if _local(x.tag) == "sp"):
            text = "\n".join(t for p in shape.iter() if _local(p.tag) == "p" and (t := _texts(p, "t").strip()))
            if text:
                title = any(_local(x.tag) == "ph" and x.attrib.get("type") in ("title", "ctrTitle") for x in shape.iter())
                out.append((path, page, k, "title" if title else "text", 1 if title else None, text, None))
                k += 1
    return out


def _xlsx(path: str, data: bytes) -> list[tuple]:
    z = zipfile.ZipFile(io.BytesIO(data))
    names = z.namelist()
    shared = [_texts(x, "t") for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(x.tag) == "si"] if "xl/sharedStrings.xml" in names else []
    out = []
    sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    for name in sheets:
        rows: list[list[str]] = []
        for row in (x for x in ElementTree.fromstring(z.read(name)).iter() if _local(x.tag) == "row"):
            cells: list[str] = []
            for c in (x for x in row if _local(x.tag) == "c"):
                column = 0
                for letter in re.match(r"[A-Z]*", c.attrib.get("r", "")).group():
                    column = column * 26 + ord(letter) - 64
                cells += [""] * (max(0, column - 1 - len(cells)))
                value = next((x.text or "" for x in c if _local(x.tag) == "v"), "") or _texts(c, "t")
                cells.append(shared[int(value)] if c.attrib.get("t") == "s" and value else value)
            rows.append(cells)
        if any(any(r) for r in rows):
            wide = max(map(len, rows))
            out.append((path, len(out), 0, "table", None, None, [r + [""] * (wide - len(r)) for r in rows]))
    return out


def _html(path: str, data: bytes) -> list[tuple]:
    out = []
    for tag, text in html_leaves(data.decode("utf-8", "replace")):
        if text.strip():
            out.append((path, 0, len(out), "title" if tag[0] == "h" else "text", int(tag[1]) if tag[0] == "h" else None, text.strip(), None))
    return out


_PARSERS = {"docx": _docx, "pptx": _pptx, "xlsx": _xlsx, "html": _html, "htm": _html}


def read_office(spark: SparkSession, path: str) -> DataFrame:
    """DOCX, PPTX, XLSX and HTML files. A file that can't be read gives one row of type
    ``error`` with the reason, and the others are read on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in pdf.itertuples(index=False):
                try:
                    rows = _PARSERS[name.rsplit(".", 1)[-1].lower()](name, data)
                except Exception as e:  # noqa: BLE001  any broken file
                    rows = [(name, 0, 0, "error", None, f"{type(e).__name__}: {e}", None)]
                table = pd.DataFrame(rows, columns=_COLUMNS)
                table["level"] = table["level"].astype("Int32")
                yield table

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, BLOCKS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch by the path's suffix; an unknown one is an error."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in _PARSERS:
        return read_office(spark, path)
    if suffix in ("txt", "md"):
        return read_text(spark, path)
    if suffix == "csv":
        return read_csv_table(spark, path)
    if suffix in ("jsonl", "json"):
        return read_jsonl(spark, path)
    raise ValueError(f"no reader for .{suffix}")
