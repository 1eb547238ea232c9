"""Queries on lines, pages, sections, chunks and parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine.functions import text as T
from docengine.operators import chunking as C
from docengine.operators import retrieval as R
from docengine.operators.shapes import header_path as header_path_of
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


@query("select doc_id, cast(s.i - 1 as integer) line_no, s.line from (select doc_id, unnest(list_zip(range(1, len(l) + 1), l)) z from (select doc_id, string_split(text, chr(10)) l from documents where text is not null)) t, lateral (select z[1] i, z[2] line) s")
def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return C.lines(table(spark, d, "documents"), ["doc_id"], "text")


@query("""select lang, count(*) lines, cast(count(*) filter (trim(line) = '') as bigint) blank, cast(max(length(line)) as integer) longest
from (select lang, unnest(string_split(text, chr(10))) line from documents where text is not null) group by 1""")
def line_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = C.lines(table(spark, d, "documents"), ["lang"], "text")
    return rows.groupBy("lang").agg(F.count("*").alias("lines"), F.count(F.when(F.trim("line") == "", 1)).alias("blank"), F.max(F.length("line")).alias("longest"))


_PAGES = "pg as (select doc_id, page_no, max(raw_lines) raw_lines, max(structure_confidence) structure_confidence from page_blocks group by 1, 2)"


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Page blocks, one row per page."""
    return table(spark, d, "page_blocks").groupBy("doc_id", "page_no").agg(F.max("raw_lines").alias("raw_lines"), F.max("structure_confidence").alias("structure_confidence"))


_MARKED = r"regexp_replace('x -- page ' || page_no || ' -- y', '-{2,4}[ \t]*[Pp]age[ \t]+([0-9]+)[ \t]*-{2,4}', '--- Page \1 ---', 'g')"


@query(f"with {_PAGES} select doc_id, page_no, {_MARKED} marked from pg")
def page_marker_normalize(spark: SparkSession, d: str) -> DataFrame:
    loose = F.concat(F.lit("x -- page "), F.col("page_no").cast("string"), F.lit(" -- y"))
    return pages(spark, d).select("doc_id", "page_no", T.normalize_page_markers(loose).alias("marked"))


@query(f"with {_PAGES} select doc_id, page_no, len(raw_lines) n_lines, md5(array_to_string(raw_lines, chr(10))) content_md5 from pg where not list_bool_or(list_transform(raw_lines, lambda l: regexp_matches(trim(l), '(?i)^---[ \\t]*page[ \\t]+[0-9]+[ \\t]*---')))")
def page_split(spark: SparkSession, d: str) -> DataFrame:
    """Page blocks written as one marked text per file, and split again."""
    p = pages(spark, d)
    marker = F.concat(F.lit("--- Page "), F.col("page_no").cast("string"), F.lit(" ---"))
    rows = p.select("doc_id", "page_no", F.posexplode(F.concat(F.array(marker), "raw_lines")).alias("k", "line"))
    w = Window.partitionBy("doc_id").orderBy("page_no", "k")
    found = C.page_blocks(rows.withColumn("line_no", F.row_number().over(w)), "doc_id")
    return found.select("doc_id", "page_no", F.size("lines").alias("n_lines"), F.md5(F.array_join("lines", "\n").cast("binary")).alias("content_md5"))


_KIND = r"""case when trim(line) = '' then 'blank' when regexp_matches(trim(line), '(?i)^---[ \t]*page[ \t]+[0-9]+[ \t]*---') then 'marker'
 when regexp_matches(trim(line), '^#{1,6} +[^ ]') then 'heading' when starts_with(trim(line), '|') then 'table'
 when regexp_matches(trim(line), '^([-*+]|[0-9]+[.)]) ') then 'list' when starts_with(trim(line), '[IMAGE') then 'image' else 'text' end"""


@query(f"with {CURRENT} select kind, count(*) n from (select {_KIND} kind from (select unnest(string_split(raw_md_fragment, chr(10))) line from cur where raw_md_fragment is not null)) group by 1")
def element_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = C.lines(R.current_chunks(table(spark, d, "chunks")), ["chunk_id"], "raw_md_fragment")
    return rows.groupBy(T.line_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


def chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of all chunks of a file in order."""
    rows = R.current_chunks(table(spark, d, "chunks")).withColumn("ord", F.coalesce("line_start", "line_end", F.lit(0)))
    return C.lines(rows, ["doc_id", "ord", "chunk_id"], "raw_md_fragment")


_LINES = """cl as (select doc_id, coalesce(line_start, line_end, 0) ord, chunk_id, unnest(list_zip(range(0, len(string_split(raw_md_fragment, chr(10)))), string_split(raw_md_fragment, chr(10)))) z from cur where raw_md_fragment is not null),
ln as (select doc_id, ord, chunk_id, cast(z[1] as integer) line_no, z[2] line from cl)"""


@query(rf"""with {CURRENT}, {_LINES},
h as (select *, row_number() over w pos, case when regexp_matches(line, '^#{{1,6}} +[^ ]') then length(regexp_extract(line, '^(#+)', 1)) end lv, trim(regexp_replace(line, '^#{{1,6}} +', '')) t from ln window w as (partition by doc_id order by ord, chunk_id, line_no)),
p as (select *, {', '.join(f"coalesce(max(case when lv = {k} then pos end) over w, 0) p{k}, last_value(case when lv = {k} then t end ignore nulls) over w t{k}" for k in range(1, 7))} from h window w as (partition by doc_id order by pos rows between unbounded preceding and current row))
select doc_id, chunk_id, line_no, lv as level, concat_ws(' > ', {', '.join(f"case when p{k} > greatest(0{''.join(f', p{j}' for j in range(1, k))}) then t{k} end" for k in range(1, 7))}) header_path from p where lv is not null""")
def md_headings(spark: SparkSession, d: str) -> DataFrame:
    """Heading lines with the path of open headings."""
    rows = chunk_lines(spark, d).withColumn("level", T.heading_level(F.col("line"))).withColumn("title", F.when(F.col("level").isNotNull(), T.heading_text(F.col("line"))))
    return header_path_of(rows, ["doc_id"], ["ord", "chunk_id", "line_no"], "level", "title").where("level is not null").select("doc_id", "chunk_id", "line_no", "level", "header_path")


_GROUPS = rf"""k as (select *, {_KIND} kind from ln),
g as (select *, greatest(1, sum(cast(kind = 'heading' as int)) over (partition by doc_id order by ord, chunk_id, line_no rows between unbounded preceding and current row)) grp from k)"""


@query(f"""with {CURRENT}, {_LINES}, {_GROUPS} select doc_id, cast(grp as bigint) "group", count(*) lines, case when count(distinct kind) = 1 then min(kind) else 'mixed' end kind from g where kind <> 'blank' group by 1, 2""")
def structure_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = chunk_lines(spark, d).withColumn("kind", T.line_kind(F.col("line")))
    grouped = C.structure_groups(rows, ["doc_id"], ["ord", "chunk_id", "line_no"], F.col("kind") == "heading").where("kind <> 'blank'")
    return grouped.groupBy("doc_id", F.col("group").cast("long").alias("group")).agg(F.count("*").alias("lines"), C.homogeneous(F.col("kind")).alias("kind"))


def chunk_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = R.current_chunks(table(spark, d, "chunks")).where("raw_md_fragment is not null")
    return rows.select(
        "chunk_id", "doc_id", "element_type", "section_label", "header_path", "line_start", "line_end", F.col("page_span")[0].alias("first_page"), F.col("page_span")[1].alias("last_page"),
        F.coalesce("line_start", "line_end", F.lit(0)).alias("ord"), F.col("raw_md_fragment").alias("text"), T.tokens(F.col("raw_md_fragment")).alias("tokens"),
    )


_SIZES = """sz as (select chunk_id, doc_id, element_type, section_label, header_path, line_start, line_end, page_span[1] first_page, page_span[2] last_page, coalesce(line_start, line_end, 0) ord,
 raw_md_fragment text, cast(ceil(length(raw_md_fragment) / 4.0) as integer) tokens from cur where raw_md_fragment is not null)"""
_CAN = """nx as (select *, lead(tokens) over w nt, lead(first_page) over w np, lower(element_type) k, lower(lead(element_type) over w) nk, row_number() over w rn from sz window w as (partition by doc_id order by ord, chunk_id)),
cm as (select *, tokens < 100 and abs(np - first_page) <= case when tokens < 100 or nt < 100 then 2 else 1 end and tokens + nt <= 2048
  and (k = 'mixed' or nk = 'mixed' or k = nk or (k in ('paragraph', 'heading', 'customheader') and nk in ('paragraph', 'heading', 'customheader'))
  or ((tokens < 100 or nt < 100) and (k in ('paragraph', 'heading', 'customheader') or nk in ('paragraph', 'heading', 'customheader')))) ok from nx)"""
# the greedy pass itself, row by row
_GREEDY = """gr as (select doc_id, chunk_id, ord, tokens, element_type, rn, ok, 1 grp, false swallowed from cm where rn = 1
  union all select c.doc_id, c.chunk_id, c.ord, c.tokens, c.element_type, c.rn, c.ok, g.grp + case when coalesce(g.ok, false) and not g.swallowed then 0 else 1 end, coalesce(g.ok, false) and not g.swallowed
  from gr g join cm c on c.doc_id = g.doc_id and c.rn = g.rn + 1)"""


@query(f"with {CURRENT}, {_SIZES}, {_CAN} select chunk_id, coalesce(ok, false) can_merge from cm")
def can_merge_flags(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("ord", "chunk_id")
    return chunk_sizes(spark, d).select("chunk_id", F.coalesce(C.can_merge(w), F.lit(False)).alias("can_merge"))


@query(f"""with recursive {CURRENT}, {_SIZES}, {_CAN}, {_GREEDY} select doc_id, cast(grp as bigint) merge_group, cast(sum(tokens) as bigint) tokens, string_agg(chunk_id, ',' order by ord, chunk_id) merged_from,
case when count(distinct element_type) = 1 then min(element_type) else 'mixed' end element_type from gr group by 1, 2""")
def tiny_merge(spark: SparkSession, d: str) -> DataFrame:
    return C.merge_tiny(chunk_sizes(spark, d)).withColumn("merged_from", F.array_join("merged_from", ","))


_TEXT = "array_to_string({}, chr(10))"


@query(rf"""with recursive {_PAGES}, e as (select doc_id, page_no, structure_confidence, len(raw_lines) n, trim(raw_lines[-1]) b, trim(raw_lines[1]) a, {_TEXT.format("raw_lines")} t from pg),
k as (select *, lead(a) over w nx, lead(t) over w nt, row_number() over w rn from e window w as (partition by doc_id order by page_no)),
cm as (select *, trim(t, e' \t\n') <> '' and trim(nt, e' \t\n') <> '' and (
  (b <> '' and not regexp_matches(b, '[.!?]$') and nx <> '' and not regexp_matches(nx, '^[#*|\[-]'))
  or (regexp_matches(b, '^([-*+]|[0-9]+\.)\s+') and regexp_matches(nx, '^([-*+]|[0-9]+\.)\s+'))
  or (contains(b, '|') and contains(nx, '|') and not regexp_matches(nx, '^[\s|:-]+$') and abs(len(string_split(b, '|')) - len(string_split(nx, '|'))) <= 1)
  or len(string_split(t, '[IMAGE]')) > len(string_split(t, '[/IMAGE]'))) ok from k),
gr as (select doc_id, page_no, n, structure_confidence, rn, ok, 1 grp, false swallowed from cm where rn = 1
  union all select c.doc_id, c.page_no, c.n, c.structure_confidence, c.rn, c.ok, g.grp + case when coalesce(g.ok, false) and not g.swallowed then 0 else 1 end, coalesce(g.ok, false) and not g.swallowed
  from gr g join cm c on c.doc_id = g.doc_id and c.rn = g.rn + 1)
select doc_id, cast(grp as bigint) merge_group, array_to_string(range(min(page_no), max(page_no) + 1), ',') page_nos, round(avg(structure_confidence), 6) structure_confidence, cast(sum(n) as bigint) n_lines from gr group by 1, 2""")
def continuation_merge(spark: SparkSession, d: str) -> DataFrame:
    return C.merge_continued_pages(pages(spark, d)).withColumn("page_nos", F.array_join(F.col("page_nos").cast("array<string>"), ","))


_PARTS = "pt as (select doc_id, list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '') l from documents where text is not null), pz as (select doc_id, i, cast(ceil(length(l[i]) / 4.0) as integer) size from pt, lateral (select unnest(range(1, len(l) + 1)) i))"


@query(f"""with recursive {_PARTS}, w as (select doc_id, i, size, 0 pack, cast(size as bigint) used from pz where i = 1
 union all select p.doc_id, p.i, p.size, w.pack + case when w.used > 0 and w.used + p.size > 512 then 1 else 0 end, case when w.used > 0 and w.used + p.size > 512 then p.size else w.used + p.size end from w join pz p on p.doc_id = w.doc_id and p.i = w.i + 1)
select doc_id, pack, count(*) paragraphs, cast(sum(size) as bigint) tokens from w group by 1, 2""")
def paragraph_pack(spark: SparkSession, d: str) -> DataFrame:
    return C.pack_paragraphs(table(spark, d, "documents"), ["doc_id"], "text")


@query(r"""with recursive st as (select doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') l from documents where text is not null),
sz as (select doc_id, i, cast(ceil(length(l[i]) / 4.0) as integer) size from st, lateral (select unnest(range(1, len(l) + 1)) i)),
w as (select doc_id, i, size, 0 pack, cast(size as bigint) used from sz where i = 1
 union all select p.doc_id, p.i, p.size, w.pack + case when w.used > 0 and w.used + p.size > 512 then 1 else 0 end, case when w.used > 0 and w.used + p.size > 512 then p.size else w.used + p.size end from w join sz p on p.doc_id = w.doc_id and p.i = w.i + 1)
select doc_id, pack as "window", cast(greatest(0, min(i) - 1 - case when pack > 0 then 3 else 0 end) as integer) first, cast(max(i) - 1 as integer) last from w group by 1, 2""")
def sentence_windows(spark: SparkSession, d: str) -> DataFrame:
    return C.sentence_windows(table(spark, d, "documents"), ["doc_id"], "text")


@query("""select doc_id, start, cast(least(start + 2048, n) as integer) stop from (select doc_id, cast(length(text) as integer) n, cast(unnest(range(0, length(text), 1848)) as integer) start from documents where length(text) > 0)""")
def char_windows(spark: SparkSession, d: str) -> DataFrame:
    return C.windows(table(spark, d, "documents"), ["doc_id"], F.length("text"), 2048, 200)


@query("""select l_orderkey, cast(start as integer) start, cast(least(start + 3, n) as integer) stop from (select l_orderkey, n, unnest(range(0, n, 2)) start from (select l_orderkey, count(*) n from lineitem group by 1))""")
def table_slices(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each order in slices of three that share one."""
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"))
    return C.windows(n, ["l_orderkey"], F.col("n"), 3, 1)


@query(rf"""with {CURRENT}, li as (select chunk_id, len(list_filter(string_split(raw_md_fragment, chr(10)), lambda l: regexp_matches(trim(l), '^([-*+]|[0-9]+[.)]) '))) n from cur where raw_md_fragment is not null)
select chunk_id, cast(start as integer) start, cast(least(start + 10, n) as integer) stop from (select chunk_id, n, unnest(range(0, n, 8)) start from li where n > 0)""")
def list_slices(spark: SparkSession, d: str) -> DataFrame:
    """List items of each chunk in slices of ten that share two."""
    items = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x).rlike(r"^([-*+]|[0-9]+[.)]) "))
    return C.windows(chunk_sizes(spark, d), ["chunk_id"], F.size(items), 10, 2)


_META = """'{"doc_id": "' || doc_id || '", "element_type": "' || element_type || '", "page_span": [' || first_page || ', ' || last_page || '], "section_label": "' || replace(replace(section_label, '\\', '\\\\'), '"', '\\"') || '"}'"""


@query(f"with {CURRENT}, {_SIZES} select chunk_id, sha256(text || ':' || {_META})[1:16] content_id from sz")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    meta = T.base_meta(F.col("doc_id"), F.col("element_type"), F.col("first_page"), F.col("last_page"), F.col("section_label"))
    return chunk_sizes(spark, d).select("chunk_id", T.content_id(F.col("text"), meta).alias("content_id"))


_PAGE = "case when first_page = last_page then '{0}' || first_page else '{1}' || first_page || '-' || last_page end"
_SECTION = "'Section: ' || coalesce(nullif(header_path, ''), nullif(section_label, ''))"


@query(f"with {CURRENT}, {_SIZES} select chunk_id, concat_ws(' | ', 'Document: ' || doc_id, {_PAGE.format('Page: ', 'Pages: ')}, {_SECTION}) prefix from sz")
def embed_text_prefix(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return chunk_sizes(spark, d).select("chunk_id", T.embedding_prefix(c("doc_id"), c("first_page"), c("last_page"), c("header_path"), c("section_label")).alias("prefix"))


@query(f"with {CURRENT}, {_SIZES} select chunk_id, concat_ws(' | ', 'Doc: ' || doc_id, {_PAGE.format('Page: ', 'Pages: ')}, {_SECTION}) citation from sz")
def citation_string(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return chunk_sizes(spark, d).select("chunk_id", T.citation(c("doc_id"), c("first_page"), c("last_page"), c("header_path"), c("section_label")).alias("citation"))


@query("select doc_id, cast(ceil(length(text) / 4.0) as integer) tokens, ceil(length(text) / 4.0) > 512 over_target, ceil(length(text) / 4.0) < 100 tiny from documents where text is not null")
def token_budget_flags(spark: SparkSession, d: str) -> DataFrame:
    n = T.tokens(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", n.alias("tokens"), (n > 512).alias("over_target"), (n < 100).alias("tiny"))


@query(rf"""with s as (select doc_id, text, regexp_extract(text, '^([^.!?]*[.!?])([ \t\r\n]|$)', 1) f from documents where text is not null),
c as (select doc_id, trim(regexp_replace(case when length(f) > 10 then f else substr(text, 1, 50) end, '[*`]', '', 'g')) l from s)
select doc_id, coalesce(nullif(case when length(l) > 60 then substr(l, 1, 57) || '...' else l end, ''), 'Paragraph (page 1)') label from c""")
def section_label(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.section_label(none, none, F.col("text"), F.lit("paragraph"), F.lit(1)).alias("label"))


_ROLL = """select doc_id, cast(parent_run as bigint) parent_run, min(first_page) first_page, max(last_page) last_page, min(line_start) line_start, max(line_end) line_end, string_agg(chunk_id, ',' order by ord, chunk_id) children,
 list(header_path order by ord, chunk_id)[1] header_path, count(*) child_count, cast(ceil(length(string_agg(text, chr(10) || chr(10) order by ord, chunk_id)) / 4.0) as integer) tokens from pr group by 1, 2"""
_SOFT = """la as (select *, case when starts_with(section_label, 'Untitled') then 'Untitled ' || first_page else coalesce(section_label, '') end lab from sz),
lb as (select *, lag(lab) over (partition by doc_id order by ord, chunk_id) pl from la),
pr as (select *, sum(cast(pl is null or pl <> lab as int)) over (partition by doc_id order by ord, chunk_id rows between unbounded preceding and current row) parent_run from lb)"""
_HEAD = """pa as (select *, string_split(header_path, ' > ')[2] part from sz),
ph as (select *, last_value(part ignore nulls) over (partition by doc_id order by ord, chunk_id rows between unbounded preceding and current row) held from pa),
pl as (select *, lag(chunk_id) over w pc, lag(held) over w pp from ph window w as (partition by doc_id order by ord, chunk_id)),
pr as (select *, sum(cast(pc is null or (pp is not null and pp <> held) as int)) over (partition by doc_id order by ord, chunk_id rows between unbounded preceding and current row) parent_run from pl)"""


@query(f"with {CURRENT}, {_SIZES}, {_SOFT} select * from ({_ROLL})")
def parents_soft(spark: SparkSession, d: str) -> DataFrame:
    return C.parent_rollup(C.soft_parents(chunk_sizes(spark, d)))


@query(f"with {CURRENT}, {_SIZES}, {_HEAD} select * from ({_ROLL})")
def parents_heading(spark: SparkSession, d: str) -> DataFrame:
    return C.parent_rollup(C.heading_parents(chunk_sizes(spark, d)))


@query("""with p as (select distinct chunk_id parent_id, unnest(child_ids) child_id from parent_chunks)
select p.parent_id, p.child_id, c.chunk_id is not null stored from p left join (select distinct chunk_id from chunks) c on c.chunk_id = p.child_id""")
def child_parent_join(spark: SparkSession, d: str) -> DataFrame:
    """Children named by parents, and whether they are stored."""
    named = table(spark, d, "parent_chunks").select(F.col("chunk_id").alias("parent_id"), F.explode("child_ids").alias("child_id")).distinct()
    stored = table(spark, d, "chunks").select(F.col("chunk_id").alias("child_id")).distinct().withColumn("_s", F.lit(True))
    return named.join(stored, "child_id", "left").select("parent_id", "child_id", F.coalesce("_s", F.lit(False)).alias("stored"))


@query("""select doc_id, avg_conf, case when avg_conf >= 0.6 then 'heading_based' else 'soft_section' end parent_type from (select doc_id, round(avg(coalesce(metadata.structure_confidence, 1.0)), 6) avg_conf from chunks group by 1)""")
def parent_strategy(spark: SparkSession, d: str) -> DataFrame:
    conf = F.round(F.avg(F.coalesce("metadata.structure_confidence", F.lit(1.0))), 6)
    return table(spark, d, "chunks").groupBy("doc_id").agg(conf.alias("avg_conf")).withColumn("parent_type", F.when(F.col("avg_conf") >= 0.6, "heading_based").otherwise("soft_section"))


@query("""select element_type, count(*) n, round(avg(token_count), 4) avg_tokens, max(token_count) max_tokens, cast(count(metadata.merged_from) as bigint) merged from chunks group by grouping sets ((element_type), ())""")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("element_type", "token_count", F.col("metadata.merged_from").alias("m")).rollup("element_type").agg(
        F.count("*").alias("n"), F.round(F.avg("token_count"), 4).alias("avg_tokens"), F.max("token_count").alias("max_tokens"), F.count("m").alias("merged")
    )


@query("""select 'page' facet, cast(p as varchar) as value, count(*) n from (select unnest(page_nos) p from chunks) group by 2 union all select 'section', coalesce(section_label, 'Unknown'), count(*) from chunks group by 2
union all select 'element_type', element_type, count(*) from chunks group by 2""")
def facets(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    return R.facets(chunks)


_REP = """rp as (select doc_id, page_no, cast(len(coalesce(repair_applied, [])) as integer) n, cast(len(list_filter(coalesce(repair_applied, []), lambda r: r.repair_type = 'table_repair')) as integer) t,
 cast(len(list_filter(coalesce(repair_applied, []), lambda r: r.repair_type = 'list_repair')) as integer) l, cast(len(list_filter(coalesce(repair_applied, []), lambda r: r.repair_type = 'section_repair')) as integer) s,
 list_bool_or(list_transform(raw_lines, lambda x: starts_with(trim(x), '#'))) h from page_blocks)"""


@query(f"""with {_REP} select distinct doc_id, page_no, n repairs, case when n = 0 then 1.0::double else round(greatest(0.0::double, least(1.0::double, 1.0::double - least(0.3::double, 0.1::double * n) - 0.15::double * t - 0.1::double * l - 0.05::double * s + case when h then 0.1::double else 0.0::double end)), 6) end confidence from rp""")
def structure_confidence(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<struct<repair_type:string,location:array<int>,reason:string,original:string,repaired:string>>")
    rows = table(spark, d, "page_blocks").withColumn("r", F.coalesce("repair_applied", none))
    count = lambda kind: F.size(F.filter("r", lambda x: x["repair_type"] == kind))
    headings = F.exists("raw_lines", lambda x: F.trim(x).startswith("#"))
    score = C.structure_confidence(F.size("r"), count("table_repair"), count("list_repair"), count("section_repair"), F.coalesce(headings, F.lit(False)))
    return rows.select("doc_id", "page_no", F.size("r").alias("repairs"), score.alias("confidence")).distinct()


@query("""select r.repair_type, count(*) n from (select unnest(repair_applied) r from page_blocks) group by 1""")
def repairs_by_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_blocks").select(F.explode("repair_applied.repair_type").alias("repair_type")).groupBy("repair_type").agg(F.count("*").alias("n"))


@query("""select b.doc_id, b.page_no, cast(count(*) as bigint) inside from (select distinct doc_id, page_no, start_line, end_line from page_blocks) b
 join (select distinct doc_id, chunk_id, line_end from chunks where line_end is not null) c on c.doc_id = b.doc_id and c.line_end between b.start_line and b.end_line group by 1, 2""")
def lines_in_pages(spark: SparkSession, d: str) -> DataFrame:
    """Range join: chunks whose last line lies within a page block."""
    b = table(spark, d, "page_blocks").select("doc_id", "page_no", "start_line", "end_line").distinct()
    c = table(spark, d, "chunks").where("line_end is not null").select("doc_id", "chunk_id", "line_end").distinct()
    return b.join(c, (b.doc_id == c.doc_id) & c.line_end.between(b.start_line, b.end_line)).groupBy(b.doc_id, "page_no").agg(F.count("*").alias("inside"))


@query("""select doc_id, len(regexp_extract_all(html, '<(h[1-6]|p|div|li)[^>]*>([^<]*)')) blocks, regexp_extract(html, '<h1[^>]*>([^<]*)', 1) title
from (select doc_id, '<h1>' || doc_type || '</h1><p>' || replace(replace(replace(text, '<', ' '), '>', ' '), chr(10), '</p><p>') || '</p>' html from documents where text is not null)""")
def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    """HTML written from the documents and read into blocks."""
    from docengine.sources.readers import html_blocks as read

    plain = F.regexp_replace(F.regexp_replace("text", "<", " "), ">", " ")
    html = F.concat(F.lit("<h1>"), "doc_type", F.lit("</h1><p>"), F.regexp_replace(plain, "\n", "</p><p>"), F.lit("</p>"))
    blocks = read(table(spark, d, "documents").where("text is not null").select("doc_id", html.alias("html")), "doc_id", "html", keep_blank=True)
    return blocks.groupBy("doc_id").agg(F.count("*").cast("long").alias("blocks"), F.max(F.when(F.col("level") == 1, F.col("text"))).alias("title"))
