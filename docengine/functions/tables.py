"""Tables as HTML, Markdown, cells and text, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docengine.functions.text import sanitize_cell

#: The entities that are read and written.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def _plain(html: Column) -> Column:
    """Text of a piece of HTML: tags away, entities read, blanks trimmed."""
    out = F.regexp_replace(html, "<[^>]*>", "")
    for name, sign in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_cells(html: Column) -> Column:
    """Rows of cells of an HTML table: ``array<array<string>>``; rows without cells are left out."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh](?:\s[^>]*)?>(.*?)</t[dh]>"), F.lit(1)), _plain))
    return F.filter(cells, lambda r: F.size(r) > 0)


def cells_html(cells: Column, header: bool = True) -> Column:
    """An HTML table, the first row as head."""
    row = lambda tag: lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit(f"<{tag}>"), _escaped(F.coalesce(c, F.lit(""))), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    first = F.transform(F.slice(cells, 1, 1), row("th" if header else "td"))
    rest = F.transform(F.slice(cells, F.lit(2), F.greatest(F.lit(0), F.size(cells) - 1)), row("td"))
    return F.concat(F.lit("<table>"), F.array_join(F.concat(first, rest), ""), F.lit("</table>"))


def cells_text(cells: Column) -> Column:
    """Rows of tab-separated cells."""
    return F.array_join(F.transform(cells, lambda r: F.array_join(r, "\t", "")), "\n")


def table_lines(text: Column) -> Column:
    """The table lines of a model's answer: fences away, only lines that begin with a pipe."""
    bare = F.regexp_replace(text, r"```[a-zA-Z]*", "")
    return F.filter(F.transform(F.split(bare, "\n", -1), lambda x: F.trim(x)), lambda x: x.startswith("|"))


def markdown_cells(text: Column) -> Column:
    """Rows of cells of the pipe lines of a Markdown text, rules left out."""
    rows = F.filter(table_lines(text), lambda x: ~x.rlike(r"^[\s|:-]+$"))
    return F.transform(rows, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|", -1), lambda c: F.trim(c)))


def cells_markdown(cells: Column) -> Column:
    """A Markdown table, the first row as head; rows are padded or cut to its width. Null
    without rows."""
    width = F.size(cells[0])
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width), lambda c: sanitize_cell(F.coalesce(c, F.lit("")))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    rows = F.transform(cells, line)
    return F.when(F.size(cells) > 0, F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, F.lit(2), F.size(rows))), "\n"))


def table_shape(cells: Column) -> Column:
    """``struct<num_rows, num_cols>``, the widest row counting."""
    return F.struct(F.size(cells).alias("num_rows"), F.coalesce(F.array_max(F.transform(cells, lambda r: F.size(r))), F.lit(0)).alias("num_cols"))


def table_signature(cells: Column) -> Column:
    """``table_{columns}x{rows}`` with the head counted as a row."""
    shape = table_shape(cells)
    return F.concat(F.lit("table_"), shape["num_cols"].cast("string"), F.lit("x"), shape["num_rows"].cast("string"))


def split_cells(text: Column) -> Column:
    """Cells of a line of a scanned table: two or more blanks or tabs part them."""
    return F.filter(F.transform(F.split(F.trim(text), r"\s{2,}|\t+", -1), lambda c: F.trim(c)), lambda c: c != "")


def common_head(a: Column, b: Column, most: int = 5) -> Column:
    """How many first rows two tables share, at most ``most``."""
    same = F.transform(F.zip_with(F.slice(a, 1, most), F.slice(b, 1, most), lambda x, y: x.isNotNull() & y.isNotNull() & F.coalesce(x == y, F.lit(False))), lambda x: x)
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def sliced_table(cells: Column, start: Column, stop: Column) -> Column:
    """Markdown of the body rows [start, stop), with the head and its rule above them."""
    body = F.slice(cells, F.lit(2), F.greatest(F.lit(0), F.size(cells) - 1))
    return cells_markdown(F.concat(F.slice(cells, 1, 1), F.slice(body, start + 1, F.greatest(F.lit(0), stop - start))))
