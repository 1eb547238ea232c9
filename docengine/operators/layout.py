"""Page layout: suppression, reading order, grids, spatial joins and tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions import tables as B
from docengine.functions import text as T
from docengine.functions.geometry import box, overlap_ratio
from docengine.functions.text import sanitize_cell
from docengine.operators.shapes import anchored_groups, greedy_pairs, runs


#: How a table says that it goes on.
CONTINUED = r"\((continued|cont\.|续|续表)\)"
PARTS = 16  # groups that the texts of a page are dealt to
TASKS = 4  # tasks for each shuffle partition, where the rows are many times those shuffled


def cleaned_boxes(df: DataFrame, scale: float = 1.0) -> DataFrame:
    """Boxes with x0 < x1 and y0 < y1, scaled."""
    return df.where("x0 < x1 and y0 < y1").withColumns({c: F.col(c) * scale for c in ("x0", "y0", "x1", "y1")})


def suppress(boxes: DataFrame, by: Sequence[str], key: str, limit: float = 0.9) -> DataFrame:
    """Greedy non-maximum suppression per page: best score first, a box is kept if its IoU
    with every kept one is at most ``limit``. Ties go to the smaller key."""
    types = dict(boxes.dtypes)
    names = [*by, key, "score", "x0", "y0", "x1", "y1"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", key], ascending=[False, True])
        x0, y0, x1, y1 = (pdf[c].to_numpy(dtype=float) for c in ("x0", "y0", "x1", "y1"))
        area = np.maximum(x1 - x0, 0) * np.maximum(y1 - y0, 0)
        left, keep = np.arange(len(pdf)), []
        while len(left):
            best, rest = left[0], left[1:]
            keep.append(best)
            common = np.maximum(np.minimum(x1[rest], x1[best]) - np.maximum(x0[rest], x0[best]), 0) * np.maximum(np.minimum(y1[rest], y1[best]) - np.maximum(y0[rest], y0[best]), 0)
            union = area[rest] + area[best] - common
            left = rest[~(np.divide(common, union, out=np.zeros(len(rest)), where=union > 0) > limit)]
        return pdf.iloc[keep]

    return boxes.select(*names).groupBy(*by).applyInPandas(run, ", ".join(f"{c} {types[c]}" for c in names))


def bands(df: DataFrame, by: Sequence[str], lo: str, hi: str, name: str, key: str) -> DataFrame:
    """Adds the number of the band of overlapping intervals [lo, hi]; a gap starts the next."""
    w = Window.partitionBy(*by).orderBy(lo, hi, key)
    before = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = (before.isNull() | (before < F.col(lo))).cast("int")
    return df.withColumn("_starts", starts).withColumn(name, F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_starts")


def reading_order(df: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Order by cuts: bands of y from the top, in each band columns of x from the left, in
    each column from the top. Adds ``band, column, place``."""
    out = bands(df, by, "y0", "y1", "band", key)
    out = bands(out, [*by, "band"], "x0", "x1", "column", key)
    w = Window.partitionBy(*by).orderBy("band", "column", "y0", "x0", key)
    return out.withColumn("place", F.row_number().over(w))


def xy_cut(df: DataFrame, by: Sequence[str], key: str, depth: int = 4) -> DataFrame:
    """Reading order by recursive cuts: bands of y from the top, in each band columns of x,
    in each column bands of y again, and so on ``depth`` times; what no cut parts is read
    from the top. Adds ``place``. Unlike ``reading_order`` it reads a column to its end
    before the next, however its lines stand to those beside them."""
    out, path = df, []
    for k in range(depth):
        for axis in "yx":
            name = f"_{axis}{k}"
            out = bands(out, [*by, *path], f"{axis}0", f"{axis}1", name, key)
            path.append(name)
    w = Window.partitionBy(*by).orderBy(*path, "y0", "x0", key)
    return out.withColumn("place", F.row_number().over(w)).drop(*path)


def grid_rows(df: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Table rows from the y-centres of texts: a text that lies half the median gap or more
    below its row's first text opens the next row. Adds ``row, column`` from 0."""
    mid = (F.col("y0") + F.col("y1")) / 2
    pages = df.withColumn("_y", mid).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("_y").alias("y"), "x0", F.col(key).alias("k")))).alias("t"))
    gaps = F.when(F.size("t") > 1, F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.get("t", i)["y"] - F.get("t", i - 1)["y"]))
    ordered = F.array_sort(gaps)
    n = F.size(gaps)
    median = F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2)
    pages = pages.withColumn("_least", 0.5 * median)
    pages = pages.withColumn("rows", anchored_groups(F.transform("t", lambda x: x["y"]), F.col("_least")))
    flat = pages.select(*by, F.explode(F.arrays_zip("t", "rows")).alias("z")).select(*by, F.col("z.t.k").alias(key), F.col("z.rows").alias("row"), F.col("z.t.x0").alias("_x"))
    return flat.withColumn("column", F.row_number().over(Window.partitionBy(*by, "row").orderBy("_x", key)) - 1).drop("_x")


RASTER = 64  # cells of a page at most, to either side


def touching_pairs(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pairs of boxes of one page that meet; the boxes of a and b come as ``a.*`` and ``b.*``.
    Boxes meet in the cells of a raster whose cells are as large as the page's boxes are on
    average, in whatever unit, so that pages of many boxes are not compared pair by pair."""
    corners = ["x0", "y0", "x1", "y1"]
    size = (
        a.select(*by, *corners).unionByName(b.select(*by, *corners)).groupBy(*by)
        .agg(F.min("x0").alias("_left"), F.min("y0").alias("_top"), *[F.greatest(F.avg(F.col(f"{c}1") - F.col(f"{c}0")), (F.max(f"{c}1") - F.min(f"{c}0")) / RASTER, F.lit(1e-9)).alias(f"_w{c}") for c in "xy"])
    )
    cell = lambda v, c, side="": F.floor((v - F.col(side + ("_left" if c == "x" else "_top"))) / F.col(f"{side}_w{c}")).cast("int")

    def rastered(df: DataFrame) -> DataFrame:
        rows = df.join(size, list(by)).where("x0 <= x1 and y0 <= y1")
        for c in "xy":
            rows = rows.withColumn(f"_c{c}", F.explode(F.sequence(cell(F.col(f"{c}0"), c), cell(F.col(f"{c}1"), c))))
        return rows

    x, y = rastered(a).alias("a"), rastered(b).alias("b")
    cond = (F.col("a.x0") <= F.col("b.x1")) & (F.col("b.x0") <= F.col("a.x1")) & (F.col("a.y0") <= F.col("b.y1")) & (F.col("b.y0") <= F.col("a.y1"))
    # a pair is counted in the cell that holds the corner of its intersection
    for c in "xy":
        cond = cond & (F.col(f"a._c{c}") == cell(F.greatest(f"a.{c}0", f"b.{c}0"), c, "a."))
    for c in (*by, "_cx", "_cy"):
        cond = cond & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return x.join(y, cond)


def spatial_pairs(a: DataFrame, b: DataFrame, by: Sequence[str], least: float) -> DataFrame:
    """Pairs of boxes of one page with an overlap ratio above ``least``, as ``a.*`` and ``b.*``."""
    return touching_pairs(a, b, by).where(overlap_ratio(box("a."), box("b.")) > least)


def filled_blocks(blocks: DataFrame, spans: DataFrame, by: Sequence[str], key: str, least: float = 0.3) -> DataFrame:
    """Every block with the texts that overlap it, best overlap first, then from the top:
    ``*by, key, filled`` (null for a block without texts). A text may fill several blocks.
    blocks: ``*by, key`` and box; spans: ``*by, text`` and box."""
    pairs = spatial_pairs(blocks, spans, by, least)
    order = F.struct((-overlap_ratio(box("a."), box("b."))).alias("o"), F.col("b.y0").alias("y"), F.col("b.x0").alias("x"), F.col("b.text").alias("t"))
    told = pairs.select(*[F.col(f"a.{c}") for c in (*by, key)], order.alias("s")).groupBy(*by, key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), " ").alias("filled"))
    return blocks.select(*by, key).join(told, [*by, key], "left")


def texts_in_blocks(blocks: DataFrame, texts: DataFrame, by: Sequence[str], key: str, padding: float = 0.1) -> DataFrame:
    """How many texts have their centre in each block, or where none has, in the block with
    ``padding`` of its size around it: ``key, texts``."""
    px, py = padding * (F.col("x1") - F.col("x0")), padding * (F.col("y1") - F.col("y0"))
    wide = blocks.select(*by, key, *[F.col(c).alias(f"o{c}") for c in ("x0", "y0", "x1", "y1")], (F.col("x0") - px).alias("x0"), (F.col("y0") - py).alias("y0"), (F.col("x1") + px).alias("x1"), (F.col("y1") + py).alias("y1"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    points = texts.select(*by, x.alias("x0"), y.alias("y0"), x.alias("x1"), y.alias("y1"))
    inside = (F.col("b.x0") >= F.col("a.ox0")) & (F.col("b.x0") <= F.col("a.ox1")) & (F.col("b.y0") >= F.col("a.oy0")) & (F.col("b.y0") <= F.col("a.oy1"))
    near = touching_pairs(wide, points, by).groupBy(F.col(f"a.{key}").alias(key)).agg(F.count(F.when(inside, 1)).alias("inside"), F.count("*").alias("near"))
    return blocks.select(key).join(near, key, "left").select(key, F.coalesce(F.when(F.col("inside") > 0, F.col("inside")).otherwise(F.col("near")), F.lit(0)).cast("long").alias("texts"))


def typed_blocks(detections: DataFrame, kinds: dict[int, str], label: str, score: str, least: float = 0.2) -> DataFrame:
    """Detections with ``kind``; low scores fall away, an unknown label is text."""
    known = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return detections.where(F.col(score) >= least).withColumn("kind", F.coalesce(F.try_element_at(known, F.col(label)), F.lit("text")))


def important_image(width: Column, height: Column, least: float = 100, icon: float = 200) -> Column:
    """Whether an image is worth a description: no side short, and no small square."""
    ratio = width / height
    return F.when((width < least) | (height < least), False).when((ratio > 0.8) & (ratio < 1.2) & (width < icon), False).otherwise(True)


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: sanitize_cell(F.coalesce(c, F.lit("")))), " | "), F.lit(" |"))


def markdown_table(header: Column, rows: Column) -> Column:
    """A Markdown table; every row is padded or cut to the header's width."""
    width = F.size(header)
    fit = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), 1, width)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(markdown_row(header), rule), F.transform(rows, lambda r: markdown_row(fit(r)))), "\n")


def table_cells(line: Column) -> Column:
    """Cells of a pipe row without its outer pipes."""
    inner = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    return F.transform(F.split(inner, r"\|", -1), lambda c: F.trim(c))


def clean_tables(lines: DataFrame, by: Sequence[str], name: str = "table") -> DataFrame:
    """The Markdown table of each text's pipe rows, all of equal width, with one rule below
    the first row. lines: ``*by, line_no, line``; texts without pipe rows give no row."""
    rows = lines.where(F.trim("line").startswith("|")).withColumn("_cells", table_cells(F.col("line")))
    rows = rows.where(~F.forall("_cells", lambda c: c.rlike("^:?-{2,}:?$")))
    rows = rows.withColumn("_width", F.max(F.size("_cells")).over(Window.partitionBy(*by)))
    padded = F.slice(F.concat("_cells", F.array_repeat(F.lit(""), F.col("_width"))), F.lit(1), F.col("_width"))
    each = rows.select(*by, "line_no", "_width", markdown_row(padded).alias("_row"))
    told = each.groupBy(*by).agg(F.max("_width").alias("_width"), F.array_sort(F.collect_list(F.struct("line_no", "_row"))).alias("_rows"))
    told = told.withColumn("_rows", F.transform("_rows", lambda x: x["_row"]))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("_width")), " | "), F.lit(" |"))
    return told.select(*by, F.array_join(F.concat(F.slice("_rows", 1, 1), F.array(rule), F.slice("_rows", F.lit(2), F.size("_rows"))), "\n").alias(name))


def mergeable_tables(header_a: Column, header_b: Column, title_b: Column) -> Column:
    """Whether the second table continues the first: it says so, or their headers agree."""
    says = F.lower(title_b).rlike(CONTINUED)
    return F.coalesce(says, F.lit(False)) | F.coalesce(header_a == header_b, F.lit(False))


def merge_tables(tables: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Greedy merging of successive tables that continue each other; the second header
    falls away. tables: ``header array<string>, title, n_rows``."""
    w = Window.partitionBy(*by).orderBy(order)
    ok = mergeable_tables(F.col("header"), F.lead("header").over(w), F.lead("title").over(w))
    rows = greedy_pairs(tables, by, [order], ok)
    return rows.groupBy(*by, "merge_group").agg(F.min_by("header", order).alias("header"), F.sum("n_rows").alias("n_rows"), F.count("*").alias("parts"))


def _covered(pdf: pd.DataFrame) -> tuple[int, int]:
    """Pixels in the boxes of both sides, and in those of either."""
    xs, ys = (np.unique(pdf[[f"{c}0", f"{c}1"]].to_numpy()) for c in "xy")
    masks = np.zeros((2, max(1, len(xs) - 1), max(1, len(ys) - 1)), dtype=bool)
    for side, x0, x1, y0, y1 in zip(pdf["side"], *(np.searchsorted(v, pdf[c]) for v, c in ((xs, "x0"), (xs, "x1"), (ys, "y0"), (ys, "y1"))), strict=True):
        masks[side, x0:x1, y0:y1] = True
    area = np.outer(np.diff(xs), np.diff(ys)) if len(xs) > 1 and len(ys) > 1 else np.zeros(masks.shape[1:])
    return int(area[masks.all(axis=0)].sum()), int(area[masks.any(axis=0)].sum())


def page_strategies(native: DataFrame, seen: DataFrame, by: Sequence[str], pixels: int = 1000, limit: float = 0.6) -> DataFrame:
    """``*by, common, covered, strategy``: HI_RES where the places that native text and seen
    text both cover are less than ``limit`` of those that either covers, on a raster of
    ``pixels`` for a unit. Pages on which nothing was seen are FAST."""
    pixel = [F.floor(F.col(c) * pixels).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")]
    both = native.select(*by, *pixel, F.lit(0).alias("side")).unionByName(seen.select(*by, *pixel, F.lit(1).alias("side")))
    types = ", ".join(f"{n} {t}" for n, t in both.select(*by).dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        common, covered = _covered(pdf)
        hi = (pdf["side"] == 1).any() and common < limit * covered
        return pdf[list(by)].head(1).assign(common=common, covered=covered, strategy="HI_RES" if hi or (covered == 0 and (pdf["side"] == 1).any()) else "FAST")

    return both.groupBy(*by).applyInPandas(run, f"{types}, common long, covered long, strategy string")


def document_strategy(strategy: Column, limit: float = 0.2) -> Column:
    """Aggregate: HI_RES where more than ``limit`` of the pages are."""
    return F.when(F.avg((strategy == "HI_RES").cast("double")) > limit, "HI_RES").otherwise("FAST")


def merge_table_cells(tables: DataFrame, by: Sequence[str], order: str, most: int = 5) -> DataFrame:
    """Greedy merging of successive tables ``cells, title`` that say they go on or share
    their first rows: ``*by, merge_group, cells, parts``; the rows that the second repeats
    from the first fall away."""
    w = Window.partitionBy(*by).orderBy(order)
    head = B.common_head(F.col("cells"), F.lead("cells").over(w), most)
    says = F.coalesce(F.lower(F.lead("title").over(w)).rlike(CONTINUED), F.lit(False))
    rows = tables.withColumn("_skip", F.coalesce(B.common_head(F.lag("cells").over(w), F.col("cells"), most), F.lit(0)))
    rows = greedy_pairs(rows, by, [order], says | (F.coalesce(head, F.lit(0)) > 0))
    first = F.row_number().over(Window.partitionBy(*by, "merge_group").orderBy(order)) == 1
    rest = F.when(first, F.col("cells")).otherwise(F.slice("cells", F.col("_skip") + 1, F.greatest(F.lit(0), F.size("cells") - F.col("_skip"))))
    rows = rows.withColumn("_rest", rest)
    every = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "_rest"))), lambda x: x["_rest"]))
    return rows.groupBy(*by, "merge_group").agg(every.alias("cells"), F.count("*").alias("parts"))


def merge_paragraphs(blocks: DataFrame, by: Sequence[str], order: str, kind: str, text: str) -> DataFrame:
    """Greedy merging of successive text blocks in pairs, neither of which is a list or an
    index: ``*by, merge_group, text, parts``."""
    w = Window.partitionBy(*by).orderBy(order)
    plain = (F.col(kind) == "text") & ~T.is_list_block(F.col(text)) & ~T.is_index_block(F.col(text))
    rows = blocks.withColumn("_plain", F.coalesce(plain, F.lit(False)))
    rows = greedy_pairs(rows, by, [order], F.col("_plain") & F.lead("_plain").over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce(text, F.lit("")).alias("t")))), lambda x: x["t"]), " ")
    return rows.groupBy(*by, "merge_group").agg(joined.alias("text"), F.count("*").alias("parts"))


def text_lines(spans: DataFrame, by: Sequence[str], key: str, gap: float = 0.02) -> DataFrame:
    """Native text objects as lines: from the top, one that begins ``gap`` or more below the
    one before it opens the next line: ``*by, line, text, x0, y0, x1, y1``, the texts joined
    in the order of y0. spans: ``*by, key, text, x0, y0, x1, y1``."""
    w = Window.partitionBy(*by).orderBy("y0", "x0", key)
    rows = runs(spans, by, ["y0", "x0", key], F.lag("y0").over(w).isNull() | (F.abs(F.col("y0") - F.lag("y0").over(w)) >= gap), "line")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", key, F.col("text").alias("t")))), lambda s: s["t"]), " ")
    return rows.groupBy(*by, "line").agg(joined.alias("text"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])


def table_texts(tables: DataFrame, spans: DataFrame, by: Sequence[str], key: str, least: float = 0.3, whole: float = 0.7) -> DataFrame:
    """Cells from the texts over a table: texts that overlap it by more than ``least`` of
    their own area; one that lies in it by more than ``whole`` is split at wide gaps into
    cells of equal width, another is one cell: ``*by, table_id, key, nth, cell, x0, x1``.
    tables: ``*by, table_id`` and box; spans: ``*by, key, text`` and box."""
    by, box, proper = list(by), ["x0", "y0", "x1", "y1"], "x0 < x1 and y0 < y1"
    # cells are made once a text, not once a pair: those of a text well inside a table and those of another, once where both are the same; each with the shares above which and up to which it holds (NaN is above all numbers)
    inside, outside = B.split_cells(F.col("text")), F.array(F.trim("text"))
    form = lambda cells, above, up_to: F.struct(cells.alias("cells"), F.lit(above).alias("above"), F.lit(up_to).alias("up_to"))
    forms = F.when(inside == outside, F.array(form(inside, least, math.nan))).otherwise(F.array(form(inside, max(least, whole), math.nan), form(outside, least, whole)))
    made = spans.where(proper).select(*by, key, *box, F.explode(forms).alias("_f")).select(*by, key, *box, F.col("_f.above").alias("_above"), F.col("_f.up_to").alias("_up_to"), F.size("_f.cells").alias("_n"), F.posexplode("_f.cells").alias("nth", "cell"))
    width = (F.col("x1") - F.col("x0")) / F.col("_n")
    made = made.withColumns({"_from": F.col("x0") + F.col("nth") * width, "_to": F.col("x0") + (F.col("nth") + 1) * width, "_area": (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))})
    # a page's texts are dealt to PARTS groups, and its tables go to each of them; tables are on the right, which is held while each text passes, so that rows of a text follow each other
    tasks = TASKS * int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = made.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")).repartition(tasks, *by, "_part").alias("s")
    t = tables.where(proper).select(*by, "table_id", *box, F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part")).repartition(tasks, *by, "_part").alias("t")
    # boxes are proper, so those that overlap share an area above 0
    w = F.least("t.x1", "s.x1") - F.greatest("t.x0", "s.x0")
    h = F.least("t.y1", "s.y1") - F.greatest("t.y0", "s.y0")
    share = w * h / F.col("s._area")
    cond = [F.col(f"t.{c}") == F.col(f"s.{c}") for c in (*by, "_part")]
    cond += [F.col("s.x0") < F.col("t.x1"), F.col("s.x1") > F.col("t.x0"), F.col("s.y0") < F.col("t.y1"), F.col("s.y1") > F.col("t.y0")]
    cond += [share > F.col("s._above"), share <= F.col("s._up_to")]
    both = s.join(t, reduce(lambda a, b: a & b, cond))
    return both.select(*[F.col(f"t.{c}") for c in by], "t.table_id", F.col(f"s.{key}"), "s.nth", "s.cell", F.col("s._from").alias("x0"), F.col("s._to").alias("x1"))


def with_default_strategy(pages: DataFrame, strategies: DataFrame, by: Sequence[str], default: str = "FAST") -> DataFrame:
    """Every page with its strategy, the default where none was told."""
    return pages.join(strategies.select(*by, "strategy"), list(by), "left").withColumn("strategy", F.coalesce("strategy", F.lit(default)))


def described(images: DataFrame, descriptions: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Images and their descriptions joined by their places; images beyond the descriptions
    keep a null one."""
    nth = lambda df: df.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    return nth(images).join(nth(descriptions).select(*by, "_nth", "description"), [*by, "_nth"], "left").drop("_nth")
