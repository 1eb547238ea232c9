"""Templates: fields from empty cells, underscores and boxes; their values put back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions import text as T

#: A label with a line to write on, and a box to tick with its text.
LABEL = r"([A-Za-z\s]+):\s*_+"
BOX = r"☐\s*([A-Za-z\s]+)"
_LEAD = r"(?i)^(Name|Address|Amount|Date|Type|Status):?\s*"


def cell_fields(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Fields in table cells that are empty or hold underscores, named by the row's first
    cell, else the column's head, else the cell before.

    cells: ``*by, row, col, cell`` from 0. Result: ``*by, row, col, context, name,
    field_type``. Null cells count as empty; the head row has no fields.
    """
    text = F.trim(F.coalesce("cell", F.lit("")))
    rows = cells.withColumn("_c", text)
    line = Window.partitionBy(*by, "row").orderBy("col")
    rows = rows.withColumn("_row", F.first("_c").over(line)).withColumn("_before", F.coalesce(F.lag("_c").over(line), F.lit("")))
    column = Window.partitionBy(*by, "col").orderBy("row")
    rows = rows.withColumn("_head", F.first("_c").over(column))
    told = rows.where((F.col("row") > 0) & ((F.col("_c") == "") | F.col("_c").contains("_")))
    some = lambda name, x, cond: F.when(cond & (x != ""), F.concat(F.lit(f"{name}: "), x))
    context = F.concat_ws(" | ", some("Row header", F.col("_row"), F.col("_row") != F.col("_c")), some("Column header", F.col("_head"), F.lit(True)), some("Previous", F.col("_before"), F.lit(True)))
    before = F.nullif(F.regexp_replace("_before", _LEAD, ""), F.lit(""))
    name = F.coalesce(F.when(F.col("_row") != F.col("_c"), F.nullif(F.col("_row"), F.lit(""))), F.nullif(F.col("_head"), F.lit("")), F.when(F.col("_before") != "", F.coalesce(before, F.lit("Field"))), F.lit("Field"))
    return told.select(*by, "row", "col", context.alias("context"), name.alias("name"), F.when(F.col("_c") == "", "empty_cell").otherwise("underscore_line").alias("field_type"))


def text_fields(texts: DataFrame, by: Sequence[str], text: str) -> DataFrame:
    """Fields in running text: labels before underscores and texts of boxes: ``*by, nth,
    name, field_type, type``. Null texts give none."""
    found = lambda pattern: F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)), lambda x: F.trim(x))
    lines = texts.select(*by, F.posexplode(found(LABEL)).alias("nth", "name")).withColumn("field_type", F.lit("underscore_line")).withColumn("type", T.field_type(F.col("name")))
    boxes = texts.select(*by, F.posexplode(found(BOX)).alias("nth", "name")).withColumn("field_type", F.lit("checkbox")).withColumn("type", F.lit("checkbox"))
    return lines.unionByName(boxes)


def filled(cells: DataFrame, fields: DataFrame, values: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cells with the values of their fields: ``*by, row, col, cell``. fields: ``*by, row,
    col, field_id``; values: ``field_id, value, citation``. A cell without field or value
    stays; a citation follows its value in brackets."""
    held = fields.join(values, "field_id").select(*by, "row", "col", F.coalesce("value", F.lit("")).alias("_v"), "citation")
    new = F.concat("_v", F.coalesce(F.concat(F.lit(" ["), F.nullif(F.col("citation"), F.lit("")), F.lit("]")), F.lit("")))
    return cells.join(held, [*by, "row", "col"], "left").select(*by, "row", "col", F.when(F.col("_v").isNotNull(), new).otherwise(F.col("cell")).alias("cell"))


def extraction_queries(fields: DataFrame) -> DataFrame:
    """The question asked for each field: its name and description."""
    return fields.withColumn("question", F.concat_ws(": ", "name", F.nullif(F.col("description"), F.lit(""))))


def first_amount(text: Column) -> Column:
    """The first amount of money in a text; null without one."""
    return F.nullif(F.regexp_extract(text, r"([$€£]\s?[0-9][0-9,]*(?:\.[0-9]+)?)", 1), F.lit(""))


def extracted(packs: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    """The first value that the kept chunks of each pack hold, in the pack's order: ``*by,
    value, chunk_id``; a pack without one has nulls. packs: ``*by, place, chunk_id, kept`` and
    what ``value`` reads."""
    rows = packs.withColumn("_v", F.when(F.col("kept"), value))
    first = F.min(F.when(F.col("_v").isNotNull(), F.struct("place", "_v", "chunk_id")))
    return rows.groupBy(*by).agg(first.alias("_f")).select(*by, F.col("_f._v").alias("value"), F.col("_f.chunk_id").alias("chunk_id"))
