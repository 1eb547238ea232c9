"""Text functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4


def tokens(text: Column) -> Column:
    """Token estimate: code points divided by four, rounded up."""
    return F.ceil(F.length(text) / CHARS_PER_TOKEN).cast("int")


def normalize_page_markers(text: Column) -> Column:
    """Loosely written page markers as ``--- Page N ---``."""
    return F.regexp_replace(text, r"-{2,4}[ \t]*[Pp]age[ \t]+([0-9]+)[ \t]*-{2,4}", "--- Page $1 ---")


def marker_page(line: Column) -> Column:
    """Page number of a marker line; null for other lines."""
    return F.when(F.trim(line).rlike(r"(?i)^---[ \t]*page[ \t]+[0-9]+[ \t]*---"), F.regexp_extract(F.trim(line), r"(?i)^---[ \t]*page[ \t]+([0-9]+)", 1).cast("int"))


def heading_level(line: Column) -> Column:
    """Level of a Markdown heading line, 1 to 6; null for other lines."""
    return F.when(line.rlike(r"^#{1,6} +[^ ]"), F.length(F.regexp_extract(line, r"^(#+)", 1)))


def heading_text(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"^#{1,6} +", ""))


def line_kind(line: Column) -> Column:
    """blank, marker, heading, table, list, image or text."""
    s = F.trim(line)
    return (
        F.when(s == "", "blank")
        .when(marker_page(line).isNotNull(), "marker")
        .when(heading_level(s).isNotNull(), "heading")
        .when(s.startswith("|"), "table")
        .when(s.rlike(r"^([-*+]|[0-9]+[.)]) "), "list")
        .when(s.startswith("[IMAGE"), "image")
        .otherwise("text")
    )


def page_label(first: Column, last: Column, one: str, many: str) -> Column:
    return F.when(first == last, F.concat(F.lit(one), first.cast("string"))).otherwise(F.concat(F.lit(many), first.cast("string"), F.lit("-"), last.cast("string")))


def embedding_prefix(doc: Column, first: Column, last: Column, path: Column, label: Column) -> Column:
    """``Document: d | Page: p | Section: s``, the section being the path or else the label."""
    section = F.coalesce(F.nullif(path, F.lit("")), F.nullif(label, F.lit("")))
    return F.concat_ws(" | ", F.concat(F.lit("Document: "), doc), page_label(first, last, "Page: ", "Pages: "), F.concat(F.lit("Section: "), section))


def citation(doc: Column, first: Column, last: Column, path: Column, label: Column) -> Column:
    """``Doc: d | Page: p | Section: s``."""
    section = F.coalesce(F.nullif(path, F.lit("")), F.nullif(label, F.lit("")))
    return F.concat_ws(" | ", F.concat(F.lit("Doc: "), F.coalesce(doc, F.lit("unknown"))), page_label(first, last, "Page: ", "Pages: "), F.concat(F.lit("Section: "), section))


def content_id(content: Column, meta: Column) -> Column:
    """First 16 hex digits of sha256 of ``content:meta``."""
    return F.substring(F.sha2(F.concat(content, F.lit(":"), meta), 256), 1, 16)


def json_text(text: Column) -> Column:
    """A JSON string of printable ASCII text."""
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), '"', '\\\\"'), F.lit('"'))


def base_meta(doc: Column, kind: Column, first: Column, last: Column, label: Column) -> Column:
    """Canonical metadata of a chunk id: sorted keys, blank after separators."""
    return F.concat(
        F.lit('{"doc_id": '), json_text(doc), F.lit(', "element_type": '), json_text(kind), F.lit(', "page_span": ['), first.cast("string"), F.lit(", "), last.cast("string"),
        F.lit('], "section_label": '), json_text(label), F.lit("}"),
    )


def sanitize_cell(text: Column) -> Column:
    """A table cell on one line without pipes."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\|", " "), r"[ \t\r\n]+", " "))


def escape_markdown(text: Column) -> Column:
    """Backslashes before Markdown's own characters, backslashes first."""
    return F.regexp_replace(text, r"([\\`*_{}\[\]()#+\-.!|])", r"\\$1")


def first_sentence(text: Column) -> Column:
    return F.regexp_extract(text, r"^([^.!?]*[.!?])([ \t\r\n]|$)", 1)


def section_label(heading: Column, path: Column, text: Column, kind: Column, page: Column) -> Column:
    """Label of a section: its heading, path, first sentence of more than 10 characters or
    first 50 characters; without ``*`` and backticks, at most 60 characters."""
    sentence = first_sentence(text)
    prose = F.when(F.length(sentence) > 10, sentence).otherwise(F.substring(text, 1, 50))
    raw = F.coalesce(F.nullif(heading, F.lit("")), F.nullif(path, F.lit("")), F.nullif(prose, F.lit("")))
    clean = F.trim(F.regexp_replace(raw, r"[*`]", ""))
    cut = F.when(F.length(clean) > 60, F.concat(F.substring(clean, 1, 57), F.lit("..."))).otherwise(clean)
    return F.coalesce(F.nullif(cut, F.lit("")), F.concat(F.initcap(kind), F.lit(" (page "), page.cast("string"), F.lit(")")))


def sentences(text: Column) -> Column:
    """Sentences without loss of the tail."""
    return F.filter(F.split(text, r"(?<=[.!?])[ \t\r\n]+"), lambda x: x != "")


def slug(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def field_type(label: Column) -> Column:
    """Type of a field from its label: currency, date, number or text."""
    low = F.lower(label)
    return (
        F.when(low.rlike("amount|price|cost|fee|loan"), "currency").when(low.rlike("date"), "date").when(low.rlike("number|count|quantity"), "number").otherwise("text")
    )


def worst_status(status: Column) -> Column:
    """The worst of statuses joined by ``|``; unknown ones count as a warning."""
    s = F.lower(F.trim(status))
    return F.when(s.contains("error"), "error").when(s.contains("warning"), "warning").when(s == "pass", "pass").otherwise("warning")


def is_list_block(text: Column) -> Column:
    """Two lines or more, over half of them numbered or with bullets."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    marked = F.filter(lines, lambda x: F.trim(x).rlike(r"^([-*+•]|[0-9]+[.)])"))
    return (F.size(lines) >= 2) & (F.size(marked) * 2 > F.size(lines))


def is_index_block(text: Column) -> Column:
    """Over 60 % of the lines are numbered entries that end in a page number."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    entries = F.filter(lines, lambda x: x.rlike(r"^[ \t]*[0-9]+[.)][ \t]+.*[ \t]+[0-9]+$"))
    return (F.size(lines) > 0) & (F.size(entries) * 10 > F.size(lines) * 6)


def fenced_json(text: Column) -> Column:
    """The JSON part of a model's answer: the inside of a fence, from the first bracket to
    the last one."""
    inside = F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")), text)
    return F.regexp_extract(inside, r"(?s)([\[{].*[\]}])", 1)


def serialized(kind: Column, prefix: Column, text: Column, items: Column, header: Column, rows: Column, signature: Column, row_range: Column) -> Column:
    """A chunk's text for embedding by its kind: prose as it is, lists below ``List Items:``,
    tables as a header and rows with their signature and range, images within their marks."""
    gap = F.lit("\n\n")
    span = F.concat(row_range[0].cast("string"), F.lit("-"), row_range[1].cast("string"))
    table_prefix = F.concat_ws(" | ", prefix, F.concat(F.lit("Table: "), signature), F.concat(F.lit("Rows: "), span))
    body = F.concat(F.when(F.coalesce(header, F.lit("")) != "", F.array(F.concat(F.lit("Header: "), header))).otherwise(F.array().cast("array<string>")), F.transform(rows, lambda r: F.concat(F.lit("Row: "), r)))
    return (
        F.when(kind == "list", F.concat(prefix, gap, F.lit("List Items:\n"), F.array_join(items, "\n")))
        .when(kind == "table", F.concat(table_prefix, gap, F.array_join(body, "\n")))
        .when(kind == "image", F.concat(prefix, gap, F.lit("[IMAGE]\n"), text, F.lit("\n[/IMAGE]")))
        .otherwise(F.concat(prefix, gap, text))
    )


def citation_with_ranges(doc: Column, first: Column, last: Column, path: Column, label: Column, rows: Column, items: Column) -> Column:
    """``Doc: d | Page: p | Section: s | Rows: a-b | Items: a-b``; what is null is left out."""
    span = lambda name, x: F.when(x.isNotNull(), F.concat(F.lit(f"{name}: "), x[0].cast("string"), F.lit("-"), x[1].cast("string")))
    return F.concat_ws(" | ", citation(doc, first, last, path, label), span("Rows", rows), span("Items", items))


def evidence(doc: Column, first: Column, last: Column) -> Column:
    """The short form of a citation, ``Doc: d | Pa-b``; ``Unknown source`` without a file."""
    return F.when(doc.isNull(), "Unknown source").otherwise(F.concat(F.lit("Doc: "), doc, F.lit(" | P"), first.cast("string"), F.lit("-"), last.cast("string")))


def kind_label(kind: Column, heading: Column, path: Column, text: Column, items: Column, header: Column, page: Column) -> Column:
    """Section label of an element of any kind: a heading's text or the path as they are;
    else the first sentence of more than 10 characters or the first 50 (prose), the first
    three items (lists), the header (tables) or the first 50 characters (images), without
    emphasis and at most 60 characters."""
    first = F.split(text, r"\.", 2)[0]
    prose = F.when(F.length(first) > 10, F.trim(first)).otherwise(F.trim(F.substring(text, 1, 50)))
    own = (
        F.when(kind == "list", F.coalesce(F.nullif(F.array_join(F.slice(items, 1, 3), " | "), F.lit("")), F.lit("List")))
        .when(kind == "table", F.coalesce(F.nullif(header, F.lit("")), F.lit("Table")))
        .when(kind == "image", F.coalesce(F.nullif(F.substring(text, 1, 50), F.lit("")), F.lit("Image")))
        .otherwise(prose)
    )
    for pattern in (r"\*\*([^*]+)\*\*", r"\*([^*]+)\*", r"`([^`]+)`"):
        own = F.regexp_replace(own, pattern, "$1")
    own = F.trim(own)
    cut = F.when(F.length(own) > 60, F.concat(F.substring(own, 1, 57), F.lit("..."))).otherwise(own)
    fallback = F.concat(F.initcap(kind), F.lit(" (page "), page.cast("string"), F.lit(")"))
    return F.coalesce(F.nullif(F.trim(heading), F.lit("")), F.nullif(path, F.lit("")), F.nullif(cut, F.lit("")), fallback)


def image_tag(description: Column, alt: Column, caption: Column) -> Column:
    """``[IMAGE_DESCRIPTION: d]``, the description being the given one, else alt text, else caption."""
    known = [F.nullif(c, F.lit("")) for c in (description, alt, caption)]
    return F.concat(F.lit("[IMAGE_DESCRIPTION: "), F.coalesce(*known, F.lit("Image")), F.lit("]"))


def merged_maps(a: Column, b: Column) -> Column:
    """Two maps as one; where both have a key, the second's value stands."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def same_value(a: Column, b: Column) -> Column:
    """Whether two values, as text, say the same: as numbers where both are numbers
    (thousands may be parted by commas), else as trimmed text. Null with a null."""
    number = lambda x: F.replace(F.trim(x), F.lit(","), F.lit("")).try_cast("double")
    x, y = number(a), number(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(x.isNotNull() & y.isNotNull(), F.abs(x - y) < 1e-9).otherwise(F.trim(a) == F.trim(b))
