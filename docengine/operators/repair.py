"""Repairs of Markdown lines: tables without rule, lists of mixed markers, labels without a
blank line before them. Every repair takes and gives rows ``*by, line_no, line`` whose order
within ``by`` is ``line_no``; it adds ``repair`` with its name where it changed something. Columns named in ``carried``,
which are equal within ``by``, stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions import text as T
from docengine.operators.chunking import structure_confidence

# What counts as a rule below a table's head, a list item and a label.
RULE = r"^[\s|:-]+$"
ITEM = r"^([-*+]|[0-9]+\.)\s+(.+)$"
LABEL = r"^[A-Z][a-z]+(\s+[A-Z][a-z]+)*:\s*$"


def _renumbered(rows: DataFrame, by: Sequence[str], parts: Column, repair: Column, carried: Sequence[Column]) -> DataFrame:
    """Each row's lines one after another under new numbers; ``repair`` marks the first."""
    each = rows.withColumn("_repair", repair).select(*by, *carried, "line_no", "_repair", F.posexplode(parts).alias("_k", "line"))
    w = Window.partitionBy(*by).orderBy("line_no", "_k")
    return each.withColumn("repair", F.when(F.col("_k") == 0, F.col("_repair"))).withColumn("line_no", (F.row_number().over(w) - 1).cast("int")).select(*by, *carried, "line_no", "line", "repair")


def repair_tables(lines: DataFrame, by: Sequence[str], carried: Sequence[Column] = ()) -> DataFrame:
    """Two or more lines with pipes in a row of which none is a rule get one, as wide as the
    first has pipes, below the first. A lone line with pipes stays as it is."""
    s = F.trim("line")
    w = Window.partitionBy(*by).orderBy("line_no")
    rows = lines.withColumn("_pipe", F.coalesce(s.contains("|"), F.lit(False))).withColumn("_rule", F.coalesce(s.rlike(RULE), F.lit(False)))
    part = F.col("_pipe") | F.col("_rule")
    # a block begins at the first line with a pipe; rules before it do not belong to it
    rows = rows.withColumn("_block", F.sum((~part).cast("int")).over(w)).withColumn("_part", part)
    within = Window.partitionBy(*by, "_block").orderBy("line_no")
    rows = rows.withColumn("_begun", F.max((F.col("_pipe") & F.col("_part")).cast("int")).over(within))
    whole = Window.partitionBy(*by, "_block", "_begun")
    member = (F.col("_begun") == 1) & F.col("_part")
    rows = rows.withColumn("_n", F.sum(member.cast("int")).over(whole)).withColumn("_ruled", F.max((member & F.col("_rule")).cast("int")).over(whole))
    first = member & (F.sum(member.cast("int")).over(Window.partitionBy(*by, "_block", "_begun").orderBy("line_no")) == 1)
    rows = rows.withColumn("_fix", first & (F.col("_n") >= 2) & (F.col("_ruled") == 0))
    fix = F.col("_fix")
    pipes = F.length(s) - F.length(F.replace(s, F.lit("|"), F.lit("")))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- "), pipes), "|"), F.lit("|"))
    return _renumbered(rows, by, F.when(fix, F.array("line", rule)).otherwise(F.array("line")), F.when(fix, "table_repair"), carried)


def repair_lists(lines: DataFrame, by: Sequence[str], carried: Sequence[Column] = ()) -> DataFrame:
    """A list is an item with what follows it: more items, and indented lines without marker,
    which go on the item before. Where the markers of a list differ (2. differs from 1.),
    every item gets the first one's marker and its lines are joined to one."""
    s = F.trim("line")
    w = Window.partitionBy(*by).orderBy("line_no")
    item = F.coalesce(s.rlike(ITEM), F.lit(False))
    more = F.coalesce((s != "") & ~item & F.col("line").rlike(r"^\s"), F.lit(False))
    rows = lines.withColumn("_item", item).withColumn("_more", more)
    rows = rows.withColumn("_block", F.sum((~(F.col("_item") | F.col("_more"))).cast("int")).over(w))
    within = Window.partitionBy(*by, "_block").orderBy("line_no")
    rows = rows.withColumn("_nth", F.sum(F.col("_item").cast("int")).over(within))
    rows = rows.withColumn("_in", (F.col("_item") | F.col("_more")) & (F.col("_nth") > 0))
    marker = F.when(F.col("_item"), F.regexp_extract(s, ITEM, 1))
    every = within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_mark", marker).withColumn("_first", F.first("_mark", ignorenulls=True).over(every))
    rows = rows.withColumn("_mixed", F.max((F.col("_item") & (F.col("_mark") != F.col("_first"))).cast("int")).over(every) == 1)
    change = F.col("_in") & F.col("_mixed")
    # the lines of one item share its number
    own = F.when(change, F.struct(F.col("_block").alias("b"), F.col("_nth").alias("i"), F.lit(0).alias("l"))).otherwise(F.struct(F.col("_block").alias("b"), F.lit(0).cast("long").alias("i"), F.col("line_no").alias("l")))
    content = F.when(F.col("_item"), F.regexp_extract(s, ITEM, 2)).otherwise(s)
    rows = rows.withColumn("_own", own).withColumn("_change", change).withColumn("_text", F.when(change, content).otherwise(F.col("line")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("_text", F.lit("")).alias("t")))), lambda x: x["t"]), " ")
    told = rows.groupBy(*by, *carried, "_own", "_change").agg(F.min("line_no").alias("line_no"), joined.alias("_t"), F.first("_first", ignorenulls=True).alias("_first"), F.max(F.col("_mark") != F.col("_first")).alias("_other"))
    line = F.when(F.col("_change"), F.concat("_first", F.lit(" "), "_t")).otherwise(F.col("_t"))
    return _renumbered(told, by, F.array(line), F.when(F.col("_change") & F.col("_other"), "list_repair"), carried)


def repair_sections(lines: DataFrame, by: Sequence[str], carried: Sequence[Column] = ()) -> DataFrame:
    """A line ``Title Case:`` below text that is no heading gets a blank line before it."""
    before = F.trim(F.lag("line").over(Window.partitionBy(*by).orderBy("line_no")))
    fix = F.coalesce(F.trim("line").rlike(LABEL) & (before != "") & ~before.rlike(r"^#+\s+") & ~before.rlike("^#+$"), F.lit(False))
    rows = lines.withColumn("_fix", fix)
    return _renumbered(rows, by, F.when(F.col("_fix"), F.array(F.lit(""), F.col("line"))).otherwise(F.array("line")), F.when(F.col("_fix"), "section_repair"), carried)


def repair_text(texts: DataFrame, by: Sequence[str], text: str) -> DataFrame:
    """All repairs of each text in their order, page markers first: ``*by, repaired,
    table_repairs, list_repairs, section_repairs, structure_confidence``. Null texts give no row."""
    rows = texts.where(F.col(text).isNotNull()).select(*by, F.posexplode(F.split(T.normalize_page_markers(F.col(text)), "\n", -1)).alias("line_no", "line"))
    names = ["repair_tables", "repair_lists", "repair_sections"]
    counts: list[Column] = []
    for name, step in zip(names, (repair_tables, repair_lists, repair_sections), strict=True):
        rows = step(rows, by, counts).withColumn(name, F.count("repair").over(Window.partitionBy(*by))).drop("repair")
        counts.append(F.col(name))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    told = rows.groupBy(*by, *names).agg(body.alias("repaired"), F.max(F.trim("line").startswith("#")).alias("_heading"))
    t, li, se = (F.col(n) for n in names)
    score = structure_confidence(t + li + se, t, li, se, F.coalesce("_heading", F.lit(False)))
    return told.select(*by, "repaired", t.alias("table_repairs"), li.alias("list_repairs"), se.alias("section_repairs"), score.alias("structure_confidence"))
