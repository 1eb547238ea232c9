"""Lines, pages, sections, chunks and parents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions import text as T
from docengine.operators.shapes import greedy_pairs, pack_fill, runs, slice_starts


# Prose kinds, and how a list line begins.
PROSE = ("paragraph", "heading", "customheader")
LIST_START = r"^([-*+]|[0-9]+\.)\s+"


def lines(df: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """One row per line: ``*key, line_no, line``; null texts give none."""
    return df.where(F.col(text).isNotNull()).select(*key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def page_blocks(line_rows: DataFrame, doc: str) -> DataFrame:
    """Pages between marker lines: ``doc, page_no, start_line, end_line, lines``. What
    stands before the first marker is left out; a text without markers is page 1."""
    marked = runs(line_rows.withColumn("page", T.marker_page(F.col("line"))), [doc], ["line_no"], F.col("page").isNotNull(), name="block")
    any_marker = F.max("block").over(Window.partitionBy(doc))
    kept = marked.withColumn("_any", any_marker).where("_any = 0 or block > 0")
    body = F.array_sort(F.collect_list(F.when(F.col("page").isNull(), F.struct("line_no", "line"))))
    return kept.groupBy(doc, "block").agg(
        F.coalesce(F.max("page"), F.lit(1)).alias("page_no"), F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.transform(body, lambda x: x["line"]).alias("lines")
    )


def may_continue(lines: Column, next_lines: Column, aggressiveness: str = "medium") -> Column:
    """Whether a page's lines run on in the next page's: prose without . ! or ? at its end
    (not with ``low``), a list, a table of about as many columns, an image block left open,
    or, with ``high``, images on both pages. Pages without text never do."""
    s, t = F.trim(F.try_element_at(lines, F.lit(-1))), F.trim(F.try_element_at(next_lines, F.lit(1)))
    body, next_body = F.array_join(lines, "\n", ""), F.array_join(next_lines, "\n", "")
    cells = lambda x: F.size(F.split(x, r"\|", -1))
    out = s.rlike(LIST_START) & t.rlike(LIST_START)
    out = out | (s.contains("|") & t.contains("|") & ~t.rlike(r"^[\s|:-]+$") & (F.abs(cells(s) - cells(t)) <= 1))
    tags = lambda x, tag: F.size(F.split(x, tag, -1))
    out = out | (tags(body, r"\[IMAGE\]") > tags(body, r"\[/IMAGE\]"))
    if aggressiveness != "low":
        out = out | ((s != "") & ~s.rlike(r"[.!?]$") & (t != "") & ~t.rlike(r"^[#*|\[-]"))
    if aggressiveness == "high":
        out = out | (body.contains("[IMAGE]") & next_body.contains("[IMAGE]"))
    return F.coalesce((F.size(lines) > 0) & (F.size(next_lines) > 0) & (F.btrim(body, F.lit(" \t\n")) != "") & (F.btrim(next_body, F.lit(" \t\n")) != "") & out, F.lit(False))


def merge_continued_pages(pages: DataFrame, aggressiveness: str = "medium") -> DataFrame:
    """Pairs of successive pages whose text runs on, merged: ``doc_id, merge_group,
    page_nos, structure_confidence, n_lines``; page_nos is the range from the first page to
    the last. pages: ``doc_id, page_no, raw_lines, structure_confidence``, one row per page."""
    w = Window.partitionBy("doc_id").orderBy("page_no")
    rows = pages.select("doc_id", "page_no", "structure_confidence", "raw_lines", F.size("raw_lines").alias("n"))
    ok = may_continue(F.col("raw_lines"), F.lead("raw_lines").over(w), aggressiveness)
    return (
        greedy_pairs(rows, ["doc_id"], ["page_no"], ok)
        .groupBy("doc_id", "merge_group")
        .agg(F.sequence(F.min("page_no"), F.max("page_no")).alias("page_nos"), F.round(F.avg("structure_confidence"), 6).alias("structure_confidence"), F.sum("n").alias("n_lines"))
    )


def structure_groups(elements: DataFrame, by: Sequence[str], order: Sequence[str], is_heading: Column) -> DataFrame:
    """Adds ``group``: a heading opens a new group if the current one has a heading; what
    stands before the first heading belongs to its group."""
    out = runs(elements, by, order, is_heading, name="_headings")
    return out.withColumn("group", F.greatest(F.lit(1), F.col("_headings"))).drop("_headings")


def homogeneous(kind: Column) -> Column:
    """Aggregate: the only kind of a group, or ``mixed``."""
    return F.when(F.count_distinct(kind) == 1, F.min(kind)).otherwise("mixed")


def can_merge(w: Window, least: int = 100, most: int = 2048) -> Column:
    """Whether a tiny chunk may merge with the next: first pages near, together small enough,
    and kinds that agree; a tiny chunk agrees with any prose. Uses ``tokens, first_page,
    element_type``."""
    nxt = lambda c: F.lead(c).over(w)
    tiny = (F.col("tokens") < least) | (nxt("tokens") < least)
    near = F.abs(F.col("first_page") - nxt("first_page")) <= F.when(tiny, 2).otherwise(1)
    kind, other = F.lower("element_type"), F.lower(nxt("element_type"))
    prose, other_prose = kind.isin(*PROSE), other.isin(*PROSE)
    agree = (kind == "mixed") | (other == "mixed") | (kind == other) | (prose & other_prose) | (tiny & (prose | other_prose))
    return (F.col("tokens") < least) & near & (F.col("tokens") + nxt("tokens") <= most) & agree


def merge_tiny(chunks: DataFrame, least: int = 100, most: int = 2048) -> DataFrame:
    """Greedy merging of tiny chunks with their next one: ``doc_id, merge_group, tokens,
    merged_from, element_type``."""
    w = Window.partitionBy("doc_id").orderBy("ord", "chunk_id")
    rows = greedy_pairs(chunks, ["doc_id"], ["ord", "chunk_id"], can_merge(w, least, most))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ord", "chunk_id"))), lambda x: x["chunk_id"])
    return rows.groupBy("doc_id", "merge_group").agg(F.sum("tokens").alias("tokens"), ids.alias("merged_from"), homogeneous(F.col("element_type")).alias("element_type"))


def pack_paragraphs(df: DataFrame, key: Sequence[str], text: str, target: int = 512) -> DataFrame:
    """Non-blank lines of each text, packed up to ``target`` tokens: ``*key, pack,
    paragraphs, tokens``."""
    parts = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != "")
    sized = df.where(F.col(text).isNotNull()).select(*key, F.transform(parts, lambda x: T.tokens(x)).alias("sizes"))
    placed = sized.select(*key, F.explode(F.arrays_zip(F.col("sizes").alias("size"), pack_fill(F.col("sizes"), target).alias("pack"))).alias("x"))
    return placed.groupBy(*key, F.col("x.pack").alias("pack")).agg(F.count("*").alias("paragraphs"), F.sum("x.size").alias("tokens"))


def sentence_windows(df: DataFrame, key: Sequence[str], text: str, target: int = 512, look_back: int = 3) -> DataFrame:
    """Sentences packed up to ``target`` tokens; every window but the first begins with
    the last ``look_back`` sentences before it: ``*key, window, first, last``. The first
    and last sentence numbers count from 0; no sentence is lost."""
    parts = T.sentences(F.col(text))
    sized = df.where(F.col(text).isNotNull()).select(*key, F.transform(parts, lambda x: T.tokens(x)).alias("sizes"))
    placed = sized.select(*key, F.posexplode(pack_fill(F.col("sizes"), target)).alias("i", "window"))
    own = placed.groupBy(*key, "window").agg(F.min("i").alias("lo"), F.max("i").alias("last"))
    return own.select(*key, "window", F.greatest(F.lit(0), F.col("lo") - F.when(F.col("window") > 0, look_back).otherwise(0)).alias("first"), "last")


def windows(df: DataFrame, key: Sequence[str], n: Column, size: int, overlap: int) -> DataFrame:
    """Overlapping windows over n items: ``*key, start, stop``."""
    return df.select(*key, n.alias("_n"), F.explode(slice_starts(n, size, overlap)).alias("start")).select(*key, "start", F.least(F.col("start") + size, F.col("_n")).alias("stop"))


def soft_parents(chunks: DataFrame) -> DataFrame:
    """Adds ``parent_run``: runs of successive chunks with one section label; labels that
    begin with Untitled count per page."""
    w = Window.partitionBy("doc_id").orderBy("ord", "chunk_id")
    label = F.when(F.col("section_label").startswith("Untitled"), F.concat(F.lit("Untitled "), F.col("first_page").cast("string"))).otherwise(F.coalesce("section_label", F.lit("")))
    rows = chunks.withColumn("_label", label)
    return runs(rows, ["doc_id"], ["ord", "chunk_id"], F.lag("_label").over(w).isNull() | (F.lag("_label").over(w) != F.col("_label")), "parent_run").drop("_label")


def heading_parents(chunks: DataFrame, level: int = 2) -> DataFrame:
    """Adds ``parent_run``: runs of successive chunks under one heading of the level in
    their path; chunks with a shorter path join the current run."""
    w = Window.partitionBy("doc_id").orderBy("ord", "chunk_id")
    part = F.get(F.split("header_path", " > "), F.lit(level - 1))
    held = chunks.withColumn("_part", part).withColumn("_held", F.last("_part", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    starts = F.lag("chunk_id").over(w).isNull() | (F.lag("_held").over(w).isNotNull() & (F.lag("_held").over(w) != F.col("_held")))
    return runs(held, ["doc_id"], ["ord", "chunk_id"], starts, "parent_run").drop("_part", "_held")


def parent_rollup(rows: DataFrame) -> DataFrame:
    """Parents of the runs: pages, lines, children in order, first path, tokens of the text."""
    inorder = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ord", "chunk_id", c))), lambda x: x[c])
    text = F.array_join(inorder("text"), "\n\n")
    return rows.groupBy("doc_id", "parent_run").agg(
        F.min("first_page").alias("first_page"), F.max("last_page").alias("last_page"), F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "chunk_id"))), lambda x: x["chunk_id"]), ",").alias("children"),
        F.min_by("header_path", F.struct("ord", "chunk_id")).alias("header_path"), F.count("*").alias("child_count"), T.tokens(text).alias("tokens"),
    )


def structure_confidence(repairs: Column, tables: Column, lists: Column, sections: Column, headings: Column) -> Column:
    """Confidence in a text's structure from its repairs: 1 without any, else less by up
    to .3 for their number and by their kinds, a little more with headings."""
    score = 1.0 - F.least(F.lit(0.3), 0.1 * repairs) - 0.15 * tables - 0.1 * lists - 0.05 * sections + F.when(headings, 0.1).otherwise(0.0)
    return F.when(repairs == 0, 1.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6))


def located(blocks: DataFrame, points: DataFrame, by: Sequence[str], at: str) -> DataFrame:
    """Points by the block whose lines hold them: a join on ``by`` and a range."""
    p = points.withColumnRenamed(at, "_at")
    return blocks.join(p, list(by)).where((F.col("_at") >= F.col("start_line")) & (F.col("_at") <= F.col("end_line"))).withColumnRenamed("_at", at)


def page_batches(pages: DataFrame, by: Sequence[str], page: str, size: int = 3) -> DataFrame:
    """Pages, counted from 1, in batches of ``size``: ``*by, batch, pages``."""
    return pages.groupBy(*by, F.floor((F.col(page) - 1) / size).alias("batch")).agg(F.sort_array(F.collect_set(page)).alias("pages"))


def image_pieces(df: DataFrame, key: Sequence[str], text: str, least: int = 4096) -> DataFrame:
    """Texts of images within their marks; one of ``least`` tokens or more is cut at blank
    lines: ``*key, nth, piece``."""
    parts = F.when(T.tokens(F.col(text)) >= least, F.split(text, "\n\n", -1)).otherwise(F.array(text))
    rows = df.where(F.col(text).isNotNull()).select(*key, F.posexplode(parts).alias("nth", "_p"))
    return rows.select(*key, "nth", F.concat(F.lit("[IMAGE]\n"), "_p", F.lit("\n[/IMAGE]")).alias("piece"))
