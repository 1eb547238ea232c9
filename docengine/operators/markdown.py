"""Markdown: rendering of blocks, cleaning of model output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.operators.shapes import anchored_groups

def render_block(kind: Column, level: Column, text: Column) -> Column:
    """One block: titles with their level's marks (at most six), lists item by item, code
    in a fence, images in brackets, the rest as it is."""
    clean = F.trim(F.coalesce(text, F.lit("")))
    marks = F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(level, F.lit(1)))))
    return (
        F.when(kind == "title", F.concat(marks, F.lit(" "), clean))
        .when(kind == "list", F.concat(F.lit("- "), F.regexp_replace(clean, "\n", "\n- ")))
        .when(kind == "code", F.concat(F.lit("```\n"), clean, F.lit("\n```")))
        .when(kind == "image", F.concat(F.lit("[IMAGE]\n"), clean, F.lit("\n[/IMAGE]")))
        .otherwise(clean)
    )


def document_markdown(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """Per document its non-empty pages in order, each below its marker: ``doc, pages, markdown``."""
    full = pages.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    part = F.concat(F.lit("--- Page "), F.col(page).cast("string"), F.lit(" ---\n\n"), F.col(text))
    every = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), part.alias("t"))))
    return full.groupBy(doc).agg(F.count("*").alias("pages"), F.array_join(F.transform(every, lambda x: x["t"]), "\n\n").alias("markdown"))


def clean_model_markdown(text: Column) -> Column:
    """Model output as plain Markdown: fences and table placeholders away, the first
    [HEADER] hoisted to the top, runs of blank lines cut to one."""
    out = F.regexp_replace(text, r"```[a-z]*[ \t]*\n?", "")
    out = F.regexp_replace(out, r"\[/?TABLE\]", "")
    header = F.regexp_extract(out, r"\[HEADER\]([^\[]*)\[/HEADER\]", 1)
    out = F.regexp_replace(out, r"\[HEADER\][^\[]*\[/HEADER\]\n?", "")
    out = F.when(header != "", F.concat(F.lit("# "), F.trim(header), F.lit("\n\n"), out)).otherwise(out)
    return F.btrim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"), F.lit(" \t\r\n"))


def is_title(text: Column) -> Column:
    """Short text in capitals or with a heading mark."""
    t = F.trim(text)
    return (F.length(t) < 100) & (t != "") & (((F.upper(t) == t) & t.rlike("[A-Z]")) | t.startswith("#"))


def is_table_like(text: Column) -> Column:
    """Tabs, or more than three double blanks and a digit."""
    return text.contains("\t") | ((F.regexp_count(text, F.lit("  ")) > 3) & text.rlike("[0-9]"))


def page_windows(rows: DataFrame, by: Sequence[str], size: int = 3) -> DataFrame:
    """Groups of rows ``page, key`` whose page lies less than ``size`` pages after the
    group's first one: ``*by, group, first_page, last_page, members``."""
    every = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("page", "key"))).alias("items"))
    group = anchored_groups(F.transform("items", lambda x: x["page"].cast("double")), F.lit(size))
    placed = every.withColumn("groups", group).select(*by, F.explode(F.arrays_zip("items", "groups")).alias("z"))
    return placed.groupBy(*by, (F.col("z.groups") + 1).alias("group")).agg(F.min("z.items.page").alias("first_page"), F.max("z.items.page").alias("last_page"), F.count("*").alias("members"))
