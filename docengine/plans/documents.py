"""Queries on tables, elements, templates, pools and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine.functions import tables as B
from docengine.functions import text as T
from docengine.operators import chunking as C
from docengine.operators import context as X
from docengine.operators import layout as L
from docengine.operators import retrieval as R
from docengine.operators import template as E
from docengine.plans.chunking import _KIND, _SIZES, chunk_sizes
from docengine.plans.layout import _B, boxes
from docengine.plans.retrieval import CURRENT
from docengine.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


_ROWS = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: starts_with(x, '|') and not regexp_matches(x, '^[\s|:-]+$'))"
#: Cells of the tables of each chunk, and the same without chunks that have none.
_CELLS = rf"""{_SIZES}, tc as (select *, list_transform({_ROWS}, lambda x: list_transform(string_split(regexp_replace(x, '^\||\|$', '', 'g'), '|'), lambda c: trim(c))) cells from sz),
tt as (select * from tc where len(cells) > 0)"""
_MD = r"""'| ' || array_to_string(list_transform(list_resize({0}, len(cells[1]), ''), lambda c: trim(regexp_replace(c, '[ \t\r\n]+', ' ', 'g'))), ' | ') || ' |'"""
_RULE = "'| ' || array_to_string(list_transform(range(len(cells[1])), lambda i: '---'), ' | ') || ' |'"


def chunk_tables(spark: SparkSession, d: str) -> DataFrame:
    return chunk_sizes(spark, d).withColumn("cells", B.markdown_cells(F.col("text"))).where(F.size("cells") > 0)


@query(rf"""with {CURRENT}, {_CELLS}, h as (select chunk_id, cells, '<table>' || array_to_string(list_transform(range(1, len(cells) + 1), lambda i: '<tr>' || array_to_string(list_transform(cells[i],
 lambda c: case when i = 1 then '<th>' else '<td>' end || replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || case when i = 1 then '</th>' else '</td>' end), '') || '</tr>'), '') || '</table>' html from tt)
select chunk_id, md5(html) html_md5, len(cells) n_rows, md5(array_to_string(list_transform(cells, lambda r: array_to_string(list_transform(r, lambda c: trim(regexp_replace(c, '\s+', ' ', 'g'))), chr(9))), chr(10))) text_md5 from h""")
def table_html(spark: SparkSession, d: str) -> DataFrame:
    """Tables of the chunks as HTML, and read back from it."""
    rows = chunk_tables(spark, d).withColumn("html", B.cells_html(F.col("cells"))).withColumn("again", B.html_cells(F.col("html")))
    return rows.select("chunk_id", F.md5(F.col("html").cast("binary")).alias("html_md5"), F.size("again").cast("long").alias("n_rows"), F.md5(B.cells_text(F.col("again")).cast("binary")).alias("text_md5"))


@query(f"with {CURRENT}, {_CELLS} select chunk_id, len(cells) num_rows, list_max(list_transform(cells, lambda r: len(r))) num_cols, 'table_' || list_max(list_transform(cells, lambda r: len(r))) || 'x' || len(cells) signature from tt")
def table_shapes(spark: SparkSession, d: str) -> DataFrame:
    rows = chunk_tables(spark, d).withColumn("s", B.table_shape(F.col("cells")))
    return rows.select("chunk_id", F.col("s.num_rows").cast("long").alias("num_rows"), F.col("s.num_cols").cast("long").alias("num_cols"), B.table_signature(F.col("cells")).alias("signature"))


@query(f"""with {CURRENT}, {_CELLS}, s as (select chunk_id, cells, n, cast(start as integer) start, cast(least(start + 20, n) as integer) stop from (select chunk_id, cells, len(cells) - 1 n, unnest(range(0, len(cells) - 1, 18)) start from tt))
select chunk_id, start, stop, md5(array_to_string(list_concat([{_MD.format('cells[1]')}, {_RULE}], list_transform(cells[start + 2 : stop + 1], lambda r: {_MD.format('r')})), chr(10))) table_md5 from s""")
def table_slices_text(spark: SparkSession, d: str) -> DataFrame:
    """Tables in slices of 20 body rows that share two, with the head repeated."""
    rows = chunk_tables(spark, d)
    cut = C.windows(rows.withColumn("n", F.size("cells") - 1), ["chunk_id", "cells"], F.col("n"), 20, 2)
    return cut.select("chunk_id", "start", "stop", F.md5(B.sliced_table(F.col("cells"), F.col("start"), F.col("stop")).cast("binary")).alias("table_md5"))


_HEAD = "coalesce(list_position(list_transform(range(1, least(5, len({0}), len({1})) + 1), lambda i: {0}[i] = {1}[i]), false) - 1, least(5, len({0}), len({1})))"


@query(f"""with recursive {CURRENT}, {_CELLS}, o as (select doc_id, cells, row_number() over w rn, lead(cells) over w nx from tt window w as (partition by doc_id order by ord, chunk_id)),
cm as (select doc_id, cells, rn, coalesce({_HEAD.format('cells', 'nx')}, 0) > 0 ok from o),
gr as (select doc_id, cells, rn, ok, 1 grp, false swallowed, cells prior from cm where rn = 1
 union all select c.doc_id, c.cells, c.rn, c.ok, g.grp + case when g.ok and not g.swallowed then 0 else 1 end, g.ok and not g.swallowed, g.cells from gr g join cm c on c.doc_id = g.doc_id and c.rn = g.rn + 1),
p as (select doc_id, grp, rn, case when swallowed then cells[{_HEAD.format('prior', 'cells')} + 1 :] else cells end part from gr)
select doc_id, cast(grp as bigint) merge_group, count(*) parts, md5(coalesce(string_agg(array_to_string(list_transform(part, lambda r: array_to_string(r, chr(9))), chr(10)), chr(10) order by rn) filter (len(part) > 0), '')) text_md5 from p group by 1, 2""")
def table_cells_merge(spark: SparkSession, d: str) -> DataFrame:
    """Successive tables of a file that share their head, merged with their rows."""
    w = Window.partitionBy("doc_id").orderBy("ord", "chunk_id")
    rows = chunk_tables(spark, d).select("doc_id", "cells", F.row_number().over(w).alias("nth"), F.lit(None).cast("string").alias("title"))
    return L.merge_table_cells(rows, ["doc_id"], "nth").select("doc_id", "merge_group", "parts", F.md5(B.cells_text(F.col("cells")).cast("binary")).alias("text_md5"))


_NOLIST = r"""not (len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) >= 2 and 2 * len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' and regexp_matches(trim(x), '^([-*+•]|[0-9]+[.)])'))) > len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')))
 and not (10 * len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' and regexp_matches(x, '^[ \t]*[0-9]+[.)][ \t]+.*[ \t]+[0-9]+$'))) > 6 * len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')))"""


@query(f"""with recursive {CURRENT}, {_SIZES}, o as (select doc_id, text, row_number() over (partition by doc_id order by ord, chunk_id) rn, element_type = 'paragraph' and {_NOLIST} pl from sz),
cm as (select doc_id, text, rn, coalesce(pl and lead(pl) over (partition by doc_id order by rn), false) ok from o),
gr as (select doc_id, text, rn, ok, 1 grp, false swallowed from cm where rn = 1 union all select c.doc_id, c.text, c.rn, c.ok, g.grp + case when g.ok and not g.swallowed then 0 else 1 end, g.ok and not g.swallowed from gr g join cm c on c.doc_id = g.doc_id and c.rn = g.rn + 1)
select doc_id, cast(grp as bigint) merge_group, count(*) parts, md5(string_agg(text, ' ' order by rn)) text_md5 from gr group by 1, 2""")
def paragraph_merge(spark: SparkSession, d: str) -> DataFrame:
    """Successive plain paragraphs of a file merged in pairs."""
    w = Window.partitionBy("doc_id").orderBy("ord", "chunk_id")
    rows = chunk_sizes(spark, d).select("doc_id", F.row_number().over(w).alias("nth"), F.when(F.col("element_type") == "paragraph", "text").otherwise("other").alias("kind"), "text")
    return L.merge_paragraphs(rows, ["doc_id"], "nth", "kind", "text").select("doc_id", "merge_group", "parts", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"""with {_B}, s as (select *, case when lag(y0) over w is null or abs(y0 - lag(y0) over w) >= 0.02 then 1 else 0 end st from b window w as (partition by page order by y0, x0, id)),
l as (select *, sum(st) over (partition by page order by y0, x0, id) line from s)
select page, cast(line as bigint) line, string_agg('t' || id, ' ' order by y0, x0, id) text, min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1 from l group by 1, 2""")
def native_lines(spark: SparkSession, d: str) -> DataFrame:
    """Text objects of a page as lines."""
    return L.text_lines(boxes(spark, d).withColumn("text", F.concat(F.lit("t"), F.col("id").cast("string"))), ["page"], "id")


@query(f"""with {_B}, s as (select id, page, x0, y0, x1, y1, 'a ' || id || case when id % 3 = 0 then '   b' || chr(9) || 'c' else '' end text from b where id % 10 <> 0), t as (select id, page, x0 - 0.2 x0, y0 - 0.2 y0, x1 + 0.2 x1, y1 + 0.2 y1 from b where id % 10 = 0),
j as (select t.id table_id, s.*, (least(t.x1, s.x1) - greatest(t.x0, s.x0)) * (least(t.y1, s.y1) - greatest(t.y0, s.y0)) / ((s.x1 - s.x0) * (s.y1 - s.y0)) share from t join s on s.page = t.page and s.x0 < t.x1 and s.x1 > t.x0 and s.y0 < t.y1 and s.y1 > t.y0),
c as (select *, case when share > 0.7 then list_filter(list_transform(regexp_split_to_array(trim(text), '\\s{{2,}}|\\t+'), lambda x: trim(x)), lambda x: x <> '') else [trim(text)] end cells from j where share > 0.3),
u as (select page, table_id, id, x0, x1, len(cells) n, unnest(range(0, len(cells))) nth, unnest(cells) cell from c)
select page, table_id, id, cast(nth as integer) nth, cell, x0 + nth * ((x1 - x0) / n) x0, x0 + (nth + 1) * ((x1 - x0) / n) x1 from u""")
def table_text_cells(spark: SparkSession, d: str) -> DataFrame:
    """Texts over tables as cells, those well inside split at wide gaps."""
    b = boxes(spark, d)
    text = F.concat(F.lit("a "), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, "   b\tc").otherwise(""))
    tables = b.where("id % 10 = 0").select("page", F.col("id").alias("table_id"), *[(F.col(c) + m).alias(c) for c, m in (("x0", -0.2), ("y0", -0.2), ("x1", 0.2), ("y1", 0.2))])
    return L.table_texts(tables, b.where("id % 10 <> 0").withColumn("text", text), ["page"], "id")


@query(f"""with {_B}, pg as (select distinct page from b), st as (select page, case when page % 2 = 0 then 'HI_RES' else 'FAST' end strategy from pg where page % 3 = 0) select pg.page, coalesce(strategy, 'FAST') strategy from pg left join st using (page)""")
def page_strategy_default(spark: SparkSession, d: str) -> DataFrame:
    pages = boxes(spark, d).select("page").distinct()
    told = pages.where("page % 3 = 0").withColumn("strategy", F.when(F.col("page") % 2 == 0, "HI_RES").otherwise("FAST"))
    return L.with_default_strategy(pages, told, ["page"])


@query(f"""with {_B}, i as (select page, id, row_number() over (partition by page order by id) n from b where id % 10 = 1), t as (select page, 'seen ' || id description, row_number() over (partition by page order by id) n from b where id % 10 = 2) select i.page, i.id, t.description from i left join t on t.page = i.page and t.n = i.n""")
def image_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """Images and descriptions of a page joined by their places."""
    b = boxes(spark, d).select("page", "id")
    return L.described(b.where("id % 10 = 1"), b.where("id % 10 = 2").withColumn("description", F.concat(F.lit("seen "), F.col("id").cast("string"))), ["page"], "id")


_KINDS = r"""el as (select *, list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '^([-*+]|[0-9]+[.)]) ')), lambda x: regexp_replace(x, '^([-*+]|[0-9]+[.)]) +', '')) items,
 list_transform(cells, lambda r: array_to_string(r, ' | ')) rws from tc),
ek as (select *, case when len(rws) > 1 then 'table' when len(items) > 0 then 'list' when contains(text, '[IMAGE') then 'image' else 'paragraph' end kind from el)"""
_PREFIX = "'Document: ' || doc_id || ' | ' || case when first_page = last_page then 'Page: ' || first_page else 'Pages: ' || first_page || '-' || last_page end || coalesce(' | Section: ' || coalesce(nullif(header_path, ''), nullif(section_label, '')), '')"


def elements(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with a kind, list items and table rows."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.trim(x))
    items = F.transform(F.filter(lines, lambda x: x.rlike(r"^([-*+]|[0-9]+[.)]) ")), lambda x: F.regexp_replace(x, r"^([-*+]|[0-9]+[.)]) +", ""))
    rows = chunk_sizes(spark, d).withColumn("items", items).withColumn("rws", F.transform(B.markdown_cells(F.col("text")), lambda r: F.array_join(r, " | ")))
    kind = F.when(F.size("rws") > 1, "table").when(F.size("items") > 0, "list").when(F.col("text").contains("[IMAGE"), "image").otherwise("paragraph")
    return rows.withColumn("kind", kind).withColumn("prefix", T.embedding_prefix(F.col("doc_id"), F.col("first_page"), F.col("last_page"), F.col("header_path"), F.col("section_label")))


@query(rf"""with {CURRENT}, {_CELLS}, {_KINDS} select chunk_id, kind, md5({_PREFIX} || case kind when 'list' then chr(10) || chr(10) || 'List Items:' || chr(10) || array_to_string(items, chr(10))
 when 'table' then ' | Table: table_' || list_max(list_transform(cells, lambda r: len(r))) || 'x' || len(cells) || ' | Rows: 0-' || (len(rws) - 1) || chr(10) || chr(10) || array_to_string(list_concat(['Header: ' || rws[1]], list_transform(rws[2:], lambda r: 'Row: ' || r)), chr(10))
 when 'image' then chr(10) || chr(10) || '[IMAGE]' || chr(10) || text || chr(10) || '[/IMAGE]' else chr(10) || chr(10) || text end) text_md5 from ek""")
def serialize_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """Texts for embedding of prose, lists, tables and images."""
    rows = elements(spark, d)
    body = F.slice("rws", F.lit(2), F.greatest(F.lit(0), F.size("rws") - 1))
    text = T.serialized(F.col("kind"), F.col("prefix"), F.col("text"), F.col("items"), F.get("rws", F.lit(0)), body, B.table_signature(B.markdown_cells(F.col("text"))), F.array(F.lit(0), F.size("rws") - 1))
    return rows.select("chunk_id", "kind", F.md5(text.cast("binary")).alias("text_md5"))


_STRIP = r"trim(regexp_replace(regexp_replace(regexp_replace({}, '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '`([^`]+)`', '\1', 'g'))"


@query(rf"""with {CURRENT}, {_CELLS}, {_KINDS}, r as (select chunk_id, kind, header_path, first_page, case kind when 'list' then coalesce(nullif(array_to_string(items[1:3], ' | '), ''), 'List') when 'table' then coalesce(nullif(rws[1], ''), 'Table')
 when 'image' then coalesce(nullif(substring(text, 1, 50), ''), 'Image') else case when length(string_split(text, '.')[1]) > 10 then trim(string_split(text, '.')[1]) else trim(substring(text, 1, 50)) end end own from ek),
s as (select *, {_STRIP.format('own')} cl from r)
select chunk_id, kind, coalesce(case when ascii(substring(chunk_id, 1, 1)) % 2 = 0 then nullif(header_path, '') end, nullif(case when length(cl) > 60 then substring(cl, 1, 57) || '...' else cl end, ''), upper(substring(kind, 1, 1)) || substring(kind, 2) || ' (page ' || first_page || ')') label from s""")
def section_label_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """Labels of elements of all kinds; half of them without their path."""
    path = F.when(F.ascii(F.substring("chunk_id", 1, 1)) % 2 == 0, F.col("header_path"))
    label = T.kind_label(F.col("kind"), F.lit(None).cast("string"), path, F.col("text"), F.col("items"), F.get("rws", F.lit(0)), F.col("first_page"))
    return elements(spark, d).select("chunk_id", "kind", label.alias("label"))


@query(rf"""with {CURRENT}, {_CELLS}, {_KINDS} select chunk_id, 'Doc: ' || doc_id || ' | ' || case when first_page = last_page then 'Page: ' || first_page else 'Pages: ' || first_page || '-' || last_page end || coalesce(' | Section: ' || coalesce(nullif(header_path, ''), nullif(section_label, '')), '')
 || case when len(rws) > 1 then ' | Rows: 0-' || (len(rws) - 1) else '' end || case when len(items) > 0 then ' | Items: 0-' || len(items) else '' end citation, 'Doc: ' || doc_id || ' | P' || first_page || '-' || last_page evidence from ek""")
def citation_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Citations with the ranges of table rows and list items."""
    span = lambda n: F.array(F.lit(0), n)
    rows, items = F.when(F.size("rws") > 1, span(F.size("rws") - 1)), F.when(F.size("items") > 0, span(F.size("items")))
    one = T.citation_with_ranges(F.col("doc_id"), F.col("first_page"), F.col("last_page"), F.col("header_path"), F.col("section_label"), rows, items)
    return elements(spark, d).select("chunk_id", one.alias("citation"), T.evidence(F.col("doc_id"), F.col("first_page"), F.col("last_page")).alias("evidence"))


@query("select doc_id, '[IMAGE_DESCRIPTION: ' || coalesce(nullif(lang, ''), nullif(source, ''), nullif(doc_type, ''), 'Image') || ']' tag from documents")
def image_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.image_tag(F.col("lang"), F.col("source"), F.col("doc_type")).alias("tag"))


@query("""with b as (select distinct doc_id, page_no, start_line, end_line from page_blocks), r as (select distinct doc_id, x.repair_type repair_type, start_line + x.location[1] first_line from (select doc_id, start_line, unnest(repair_applied) x from page_blocks))
select distinct b.doc_id, b.page_no, r.repair_type, r.first_line from b join r on r.doc_id = b.doc_id and r.first_line between b.start_line and b.end_line""")
def repairs_in_pages(spark: SparkSession, d: str) -> DataFrame:
    """Repairs by the page block whose lines hold them."""
    blocks = table(spark, d, "page_blocks")
    repairs = blocks.select("doc_id", "page_no", F.col("start_line").alias("_at"), F.explode("repair_applied").alias("r")).select("doc_id", "page_no", "r.repair_type", (F.col("_at") + F.col("r.location")[0]).alias("first_line"))
    return C.located(blocks.select("doc_id", "page_no", "start_line", "end_line"), repairs.select("doc_id", "repair_type", "first_line").distinct(), ["doc_id"], "first_line").select("doc_id", "page_no", "repair_type", "first_line").distinct()


@query("select distinct doc_id, page_no, cast(start_line + i as integer) line_no, raw_lines[i + 1] line from (select doc_id, page_no, start_line, raw_lines, unnest(range(0, len(raw_lines))) i from page_blocks)")
def absolute_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of pages numbered through their file."""
    rows = table(spark, d, "page_blocks").select("doc_id", "page_no", "start_line", F.posexplode("raw_lines").alias("i", "line"))
    return rows.select("doc_id", "page_no", (F.col("start_line") + F.col("i")).alias("line_no"), "line").distinct()


@query("""with p as (select 'child' kind, doc_id, chunk_id from chunks union all select 'parent', doc_id, chunk_id from parent_chunks) select kind, count(*) n_rows, count(distinct chunk_id) chunks, count(distinct nullif(nullif(doc_id, ''), 'unknown')) files from p group by 1""")
def chunk_pool(spark: SparkSession, d: str) -> DataFrame:
    """Children and parents in one pool."""
    pool = R.chunk_pool(table(spark, d, "chunks"), table(spark, d, "parent_chunks"))
    return pool.groupBy("kind").agg(F.count("*").alias("n_rows"), F.count_distinct("chunk_id").alias("chunks"), F.count_distinct(R.known_doc(F.col("doc_id"))).alias("files"))


@query("select distinct doc_id from (select doc_id from chunks union all select doc_id from parent_chunks union all select doc_id from citations union all select doc_id from source_docs) where doc_id is not null and doc_id not in ('', 'unknown')")
def all_doc_ids(spark: SparkSession, d: str) -> DataFrame:
    """Every known file named in any table."""
    return R.all_doc_ids(*(table(spark, d, t) for t in ("chunks", "parent_chunks", "citations", "source_docs")))


@query("""with a as (select run_id, list_sort(list(distinct lower(trim(chunk_id)))) x from citations where trim(coalesce(chunk_id, '')) <> '' group by 1), b as (select run_id, list_sort(list(distinct lower(trim(chunk_id)))) x from candidates where trim(coalesce(chunk_id, '')) <> '' group by 1)
select coalesce(a.run_id, b.run_id) run_id, len(list_distinct(list_concat(coalesce(a.x, []), coalesce(b.x, [])))) ids, len(list_filter(coalesce(a.x, []), lambda i: not list_contains(coalesce(b.x, []), i))) only_cited, a.x is not distinct from b.x same from a full join b on a.run_id = b.run_id""")
def id_sets(spark: SparkSession, d: str) -> DataFrame:
    """Ids cited and ids retrieved in each run: union, difference, equality."""
    return R.compare_id_sets(table(spark, d, "citations"), table(spark, d, "candidates"), "run_id", "chunk_id").select("run_id", F.col("ids").cast("long").alias("ids"), F.col("only_a").cast("long").alias("only_cited"), "same")


@query(f"with {CURRENT} select (select count(*) from cur) children, (select count(distinct chunk_id) from parent_chunks) parents, coalesce((select round(avg(token_count), 4) from cur), 0.0) avg_tokens")
def ingest_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.ingest_stats(R.current_chunks(table(spark, d, "chunks")), R.current_chunks(table(spark, d, "parent_chunks")))


@query(f"with {CURRENT} select element_type, count(*) chunks, min(token_count) least, max(token_count) most, round(avg(token_count), 4) average from cur group by 1")
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.current_chunks(table(spark, d, "chunks")).groupBy("element_type").agg(F.count("*").alias("chunks"), F.min("token_count").alias("least"), F.max("token_count").alias("most"), F.round(F.avg("token_count"), 4).alias("average"))


@query(f"""with {CURRENT}, {_CELLS} select doc_id, count(*) chunks, cast(count(*) filter (len(cells) > 0) as bigint) tables, cast(sum(len(cells)) as bigint) table_rows, cast(coalesce(sum(list_sum(list_transform(cells, lambda r: len(r)))), 0) as bigint) table_cells, cast(max(last_page) as integer) pages from tc group by 1""")
def stage_stats(spark: SparkSession, d: str) -> DataFrame:
    """Tables, rows and cells of each file."""
    rows = chunk_sizes(spark, d).withColumn("cells", B.markdown_cells(F.col("text")))
    held = F.aggregate("cells", F.lit(0).cast("long"), lambda a, r: a + F.size(r))
    return rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count(F.when(F.size("cells") > 0, 1)).alias("tables"), F.sum(F.size("cells")).alias("table_rows"), F.sum(held).alias("table_cells"), F.max("last_page").alias("pages"))


@query("""select doc_id, coalesce(doc_type, lang) a, source b, doc_type c from documents""")
def metadata_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two metadata maps as one, the second's values first."""
    some = lambda **x: F.map_filter(F.create_map(*[y for k, v in x.items() for y in (F.lit(k), F.col(v))]), lambda _, v: v.isNotNull())
    both = T.merged_maps(some(a="lang", b="source"), some(a="doc_type", c="doc_type"))
    return table(spark, d, "documents").withColumn("m", both).select("doc_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in "abc"])


@query("""select event_id, coalesce(abs(cast(p as double) - cast(v as double)) < 1e-9, false) same from (select event_id, round(value, 0) v, lag(round(value, 0)) over (partition by user_id order by ts, event_id) p from events)""")
def value_compare(spark: SparkSession, d: str) -> DataFrame:
    """Whether a user's value is the one before, numbers compared as numbers."""
    v = F.round("value", 0)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select("event_id", v.cast("string").alias("v"), F.lag(v).over(w).cast("int").cast("string").alias("p"))
    return rows.select("event_id", F.coalesce(T.same_value(F.col("v"), F.col("p")), F.lit(False)).alias("same"))


@query("""select doc_id, cast(i - 1 as integer) nth, md5('[IMAGE]' || chr(10) || p[i] || chr(10) || '[/IMAGE]') piece_md5 from (select doc_id, p, unnest(range(1, len(p) + 1)) i from (select doc_id, case when ceil(length(text) / 4.0) >= 256 then string_split(text, chr(10) || chr(10)) else [text] end p from documents where text is not null))""")
def image_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Texts of images, long ones a paragraph at a time."""
    rows = C.image_pieces(table(spark, d, "documents"), ["doc_id"], "text", 256)
    return rows.select("doc_id", "nth", F.md5(F.col("piece").cast("binary")).alias("piece_md5"))


_TEMPLATE = f"""{_CELLS}, c0 as (select chunk_id, i - 1 r, unnest(range(0, len(cells[i]))) k, unnest(cells[i]) cell from (select chunk_id, cells, unnest(range(1, len(cells) + 1)) i from tt)),
c as (select chunk_id, r, k, case when r > 0 and k > 0 and (r + k) % 3 = 0 then '' when r > 0 and (r + k) % 5 = 0 then '____' else cell end cell from c0)"""


def template_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the chunks' tables, some emptied, some with a line to write on."""
    rows = chunk_tables(spark, d).select("chunk_id", F.posexplode("cells").alias("row", "cells")).select("chunk_id", "row", F.posexplode("cells").alias("col", "cell"))
    place = F.col("row") + F.col("col")
    cell = F.when((F.col("row") > 0) & (F.col("col") > 0) & (place % 3 == 0), "").when((F.col("row") > 0) & (place % 5 == 0), "____").otherwise(F.col("cell"))
    return rows.withColumn("cell", cell)


_FIELDS = f"""{_TEMPLATE}, w as (select *, trim(cell) t, first_value(trim(cell)) over (partition by chunk_id, r order by k) rh, first_value(trim(cell)) over (partition by chunk_id, k order by r) ch, coalesce(lag(trim(cell)) over (partition by chunk_id, r order by k), '') pv from c),
fl as (select chunk_id, cast(r as integer) as "row", cast(k as integer) col, concat_ws(' | ', case when rh <> t and rh <> '' then 'Row header: ' || rh end, case when ch <> '' then 'Column header: ' || ch end, case when pv <> '' then 'Previous: ' || pv end) context,
 coalesce(case when rh <> t then nullif(rh, '') end, nullif(ch, ''), nullif(regexp_replace(pv, '^(Name|Address|Amount|Date|Type|Status):?\\s*', '', 'i'), ''), 'Field') as name, case when t = '' then 'empty_cell' else 'underscore_line' end field_type from w where r > 0 and (t = '' or contains(t, '_')))"""


@query(f"with {CURRENT}, {_FIELDS} select * from fl")
def template_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of table templates with their names."""
    return E.cell_fields(template_cells(spark, d), ["chunk_id"])


@query(f"""with {CURRENT}, {_FIELDS} select c.chunk_id, cast(c.r as integer) as "row", cast(c.k as integer) col, case when f.name is not null and f.col % 2 = 1 then upper(f.name) || ' [P' || f.row || ']' else c.cell end cell from c left join fl f on f.chunk_id = c.chunk_id and f.row = c.r and f.col = c.k""")
def template_cells_filled(spark: SparkSession, d: str) -> DataFrame:
    """Templates with values in the fields that have one."""
    cells = template_cells(spark, d)
    fields = E.cell_fields(cells, ["chunk_id"]).withColumn("field_id", F.concat_ws("/", "chunk_id", "row", "col"))
    values = fields.where("col % 2 = 1").select("field_id", F.upper("name").alias("value"), F.concat(F.lit("P"), F.col("row").cast("string")).alias("citation"))
    return E.filled(cells, fields, values, ["chunk_id"])


@query("""select p_partkey, cast(0 as integer) nth, trim(regexp_replace(p_type, '[^A-Za-z ]', '', 'g')) || ' amount' as name, 'underscore_line' field_type, 'currency' as type from part where regexp_matches(p_type, '[A-Za-z]')
 union all select p_partkey, cast(i as integer), case i when 0 then 'Yes' else 'No' end, 'checkbox', 'checkbox' from part, range(0, 2) r(i) where regexp_matches(p_type, '[A-Za-z]')""")
def text_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields in running text: labels with lines, boxes."""
    label = F.trim(F.regexp_replace("p_type", "[^A-Za-z ]", ""))
    text = F.concat(F.lit("1. "), label, F.lit(" amount: ____ 2. ☐ Yes; ☐ No."))
    return E.text_fields(table(spark, d, "part").where(F.col("p_type").rlike("[A-Za-z]")).withColumn("text", text), ["p_partkey"], "text")


@query(f"with {CURRENT} select doc_id, chunk_id, section_label, token_count from cur where chunk_id = (select min(chunk_id) from cur)")
def chunk_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One chunk by its file and id."""
    chunks = R.current_chunks(table(spark, d, "chunks"))
    key = chunks.agg(F.min_by(F.struct("doc_id", "chunk_id"), "chunk_id").alias("k")).first()["k"]
    return R.lookup_one(chunks, key["doc_id"], key["chunk_id"]).select("doc_id", "chunk_id", "section_label", "token_count")


@query("select doc_id, cast(floor((page_no - 1) / 3) as bigint) batch, string_agg(page_no, ',' order by page_no) pages from (select distinct doc_id, page_no from page_blocks) group by 1, 2")
def page_batches(spark: SparkSession, d: str) -> DataFrame:
    """Pages in batches of three, as a vision model takes them."""
    rows = C.page_batches(table(spark, d, "page_blocks").select("doc_id", "page_no").distinct(), ["doc_id"], "page_no", 3)
    return rows.select("doc_id", "batch", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


@query(f"with {CURRENT} select chunk_id, doc_id, page_span[1] first_page, page_span[2] last_page, header_path, element_type, token_count from cur")
def chunk_dicts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as JSON objects and back."""
    rows = R.from_dicts(R.to_dicts(R.current_chunks(table(spark, d, "chunks"))), table(spark, d, "chunks").schema)
    return rows.select("chunk_id", "doc_id", F.col("page_span")[0].alias("first_page"), F.col("page_span")[1].alias("last_page"), "header_path", "element_type", "token_count")


_HITS = """ht as (select distinct c.candidate_id, c.run_id, c.field_id, k.chunk_id, c.score, k.raw_md_fragment t from candidates c join cur k on lower(trim(c.chunk_id)) = k.chunk_id where k.raw_md_fragment is not null),
hd as (select run_id, field_id, chunk_id, max(score) score, min(t) t from ht group by 1, 2, 3),
hp as (select *, row_number() over (partition by run_id, field_id order by score desc nulls last, chunk_id) place from hd qualify place <= 50)"""


def _sent(spark: SparkSession, d: str) -> DataFrame:
    chunks = R.current_chunks(table(spark, d, "chunks")).where("raw_md_fragment is not null").select("chunk_id", F.col("raw_md_fragment").alias("text"))
    hits = table(spark, d, "candidates").select("run_id", "field_id", R.clean_id("chunk_id").alias("chunk_id"), "score").join(chunks, "chunk_id")
    return X.rerank_input(hits.groupBy("run_id", "field_id", "chunk_id").agg(F.max("score").alias("score"), F.min("text").alias("text")), ["run_id", "field_id"], "score", "text")


@query(f"with {CURRENT}, {_HITS} select run_id, field_id, chunk_id, cast(place as integer) place, md5(substring(t, 1, 1200)) snippet_md5 from hp")
def rerank_input(spark: SparkSession, d: str) -> DataFrame:
    """What is sent to the reranker."""
    return _sent(spark, d).select("run_id", "field_id", "chunk_id", "place", F.md5(F.col("snippet").cast("binary")).alias("snippet_md5"))


@query(f"""with {CURRENT}, {_HITS}, an as (select run_id, field_id, chunk_id, cast(ascii(substring(chunk_id, 1, 1)) as integer) + 5 s, case when ascii(substring(chunk_id, 2, 1)) % 7 = 0 then 'perhaps' else 'yes' end a from hp)
select run_id, field_id, chunk_id, s relevance_score, cast(row_number() over (partition by run_id, field_id order by s desc, place, chunk_id) as integer) as rank from an join hp using (run_id, field_id, chunk_id) where s between 0 and 100 and a in ('yes', 'no') qualify rank <= 15""")
def rerank_join(spark: SparkSession, d: str) -> DataFrame:
    """A reranker's answers, some of them unknown or invalid, joined to what was sent."""
    sent = _sent(spark, d)
    answers = sent.select("run_id", "field_id", "chunk_id", (F.ascii(F.substring("chunk_id", 1, 1)) + 5).alias("relevance_score"), F.when(F.ascii(F.substring("chunk_id", 2, 1)) % 7 == 0, "perhaps").otherwise("yes").alias("answerability"))
    unknown = answers.withColumn("chunk_id", F.concat("chunk_id", F.lit("?")))
    return X.reranked(answers.unionByName(unknown), sent, ["run_id", "field_id"]).select("run_id", "field_id", "chunk_id", "relevance_score", "rank")
