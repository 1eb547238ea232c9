"""Queries on Markdown, block classes, templates and the whole pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine import pipeline
from docengine.functions import providers
from docengine.functions import text as T
from docengine.operators import layout as L
from docengine.operators import markdown as M
from docengine.operators.shapes import top_k
from docengine.plans.chunking import _LINES, _SIZES, chunk_lines, chunk_sizes, pages
from docengine.plans.layout import _B, _PAIR, boxes
from docengine.plans.retrieval import CURRENT
from docengine.session import checkpoint, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


_PG = "pg as (select doc_id, page_no, array_to_string(max(raw_lines), chr(10)) t from page_blocks group by 1, 2)"


@query(f"with {_PG} select doc_id, count(*) pages, md5(string_agg('--- Page ' || page_no || ' ---' || chr(10) || chr(10) || t, chr(10) || chr(10) order by page_no)) markdown_md5 from pg where trim(t) <> '' group by 1")
def document_markdown(spark: SparkSession, d: str) -> DataFrame:
    rows = pages(spark, d).withColumn("t", F.array_join("raw_lines", "\n"))
    return M.document_markdown(rows, "doc_id", "page_no", "t").select("doc_id", "pages", F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"))


@query("""select vec_id, case label when 0 then '## Block ' || vec_id when 1 then '- Block ' || vec_id when 2 then '```' || chr(10) || 'Block ' || vec_id || chr(10) || '```' when 3 then '[IMAGE]' || chr(10) || 'Block ' || vec_id || chr(10) || '[/IMAGE]' else 'Block ' || vec_id end md from embeddings""")
def blocks_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("label") == 0, "title").when(F.col("label") == 1, "list").when(F.col("label") == 2, "code").when(F.col("label") == 3, "image").otherwise("text")
    text = F.concat(F.lit("Block "), F.col("vec_id").cast("string"))
    return table(spark, d, "embeddings").select("vec_id", M.render_block(kind, F.lit(2), text).alias("md"))


@query(r"""select doc_id, case when text = '' then 0 else len(regexp_extract_all(text, '[.!?][ \t\r\n]+')) + 1 - case when regexp_matches(text, '[.!?][ \t\r\n]+$') then 1 else 0 end end sentences from documents where text is not null""")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("sentences"))


@query(rf"""with {CURRENT}, {_SIZES}, l as (select chunk_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') n from sz)
select chunk_id, len(n) >= 2 and 2 * len(list_filter(n, lambda x: regexp_matches(trim(x), '^([-*+•]|[0-9]+[.)])'))) > len(n) is_list,
len(n) > 0 and 10 * len(list_filter(n, lambda x: regexp_matches(x, '^[ \t]*[0-9]+[.)][ \t]+.*[ \t]+[0-9]+$'))) > 6 * len(n) is_index,
contains(text, chr(9)) or (len(regexp_extract_all(text, '  ')) > 3 and regexp_matches(text, '[0-9]')) is_table from l""")
def block_flags(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return chunk_sizes(spark, d).select("chunk_id", T.is_list_block(t).alias("is_list"), T.is_index_block(t).alias("is_index"), M.is_table_like(t).alias("is_table"))


@query(rf"""with {CURRENT}, {_LINES} select chunk_id, line_no, length(trim(line)) < 100 and trim(line) <> '' and ((upper(trim(line)) = trim(line) and regexp_matches(trim(line), '[A-Z]')) or starts_with(trim(line), '#')) is_title from ln""")
def title_lines(spark: SparkSession, d: str) -> DataFrame:
    return chunk_lines(spark, d).select("chunk_id", "line_no", M.is_title(F.col("line")).alias("is_title"))


@query(f"""with recursive {CURRENT}, {_SIZES}, o as (select doc_id, chunk_id, first_page page, row_number() over (partition by doc_id order by first_page, chunk_id) rn from sz),
w as (select doc_id, chunk_id, page, rn, page anchor, 1 grp from o where rn = 1 union all select o.doc_id, o.chunk_id, o.page, o.rn, case when o.page - w.anchor >= 3 then o.page else w.anchor end, w.grp + case when o.page - w.anchor >= 3 then 1 else 0 end from w join o on o.doc_id = w.doc_id and o.rn = w.rn + 1)
select doc_id, grp as "group", min(page) first_page, max(page) last_page, count(*) members from w group by 1, 2""")
def page_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = chunk_sizes(spark, d).select("doc_id", F.col("first_page").alias("page"), F.col("chunk_id").alias("key"))
    return M.page_windows(rows, ["doc_id"])


@query("""select run_id, field_id, md5(string_agg(k, ',' order by k)) cache_key from (select distinct run_id, field_id, lower(trim(chunk_id)) k from candidates where trim(coalesce(chunk_id, '')) <> '') group by 1, 2""")
def rerank_cache_key(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidates").where("trim(coalesce(chunk_id, '')) <> ''")
    key = F.array_join(F.sort_array(F.collect_set(F.lower(F.trim("chunk_id")))), ",")
    return rows.groupBy("run_id", "field_id").agg(F.md5(key.cast("binary")).alias("cache_key"))


@query(r"""select doc_id, md5(trim(regexp_replace('# ' || doc_type || chr(10) || chr(10) || regexp_replace(text, '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), e' \t\r\n')) cleaned_md5 from documents where text is not null and doc_type is not null and not contains(text, '[') and not contains(text, '`')""")
def model_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Model output around the documents, cleaned again. Texts with brackets or backticks
    of their own, which the SQL leaves out, are cleaned too."""
    docs = table(spark, d, "documents").where("text is not null and doc_type is not null")
    raw = F.concat(F.lit("```markdown\n[TABLE]"), "text", F.lit("[HEADER]"), "doc_type", F.lit("[/HEADER]\n```"))
    return docs.select("doc_id", F.md5(M.clean_model_markdown(raw).cast("binary")).alias("cleaned_md5"))


@query("""select run_id, field_id, count(distinct doc_id) files, case when count(distinct doc_id) > 1 then 'warning' else 'pass' end status from citations group by 1, 2""")
def consistency_check(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a run that are cited from several files."""
    n = F.count_distinct("doc_id")
    return table(spark, d, "citations").groupBy("run_id", "field_id").agg(n.alias("files"), F.when(n > 1, "warning").otherwise("pass").alias("status"))


@query("""select run_id, field_id, '| ' || field_id || ' | ☑ | ' || string_agg('Doc: ' || coalesce(doc_id, 'unknown') || ' | P' || page_span[1] || '-' || page_span[2], '; ' order by citation_id) || ' |' filled
from (select * from (select distinct citation_id, run_id, field_id, doc_id, page_span from citations where page_span is not null) qualify row_number() over (partition by run_id, field_id order by citation_id) <= 3) group by 1, 2""")
def template_fill(spark: SparkSession, d: str) -> DataFrame:
    """Template rows with their box ticked and at most three citations."""
    rows = table(spark, d, "citations").where("page_span is not null").select("citation_id", "run_id", "field_id", "doc_id", "page_span").distinct()
    three = top_k(rows, ["run_id", "field_id"], 3, F.col("citation_id"))
    cite = F.concat(F.lit("Doc: "), F.coalesce("doc_id", F.lit("unknown")), F.lit(" | P"), F.col("page_span")[0].cast("string"), F.lit("-"), F.col("page_span")[1].cast("string"))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("citation_id", cite.alias("c")))), lambda x: x["c"]), "; ")
    blank = F.concat(F.lit("| "), "field_id", F.lit(" | ☐ | "))
    return three.groupBy("run_id", "field_id").agg(told.alias("t")).select("run_id", "field_id", F.concat(F.regexp_replace(blank, "☐", "☑"), "t", F.lit(" |")).alias("filled"))


@query("""select p_partkey id, case when p_size < 10 or p_retailprice / 10 < 100 then false when p_size * 10 / (p_retailprice / 10) > 0.8 and p_size * 10 / (p_retailprice / 10) < 1.2 and p_size * 10 < 200 then false else true end important from part""")
def image_importance(spark: SparkSession, d: str) -> DataFrame:
    """Images of 100 x 100 or more that are not small squares."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), L.important_image(F.col("p_size") * 10, F.col("p_retailprice") / 10).alias("important"))


@query(f"""with {_B}, m(cls, kind) as (values (0, 'title'), (1, 'text'), (3, 'image'), (4, 'caption'), (5, 'table'), (6, 'footnote')) select id, coalesce(kind, 'text') kind from b left join m on m.cls = b.id % 8 where score / 2000 >= 0.2""")
def detection_types(spark: SparkSession, d: str) -> DataFrame:
    """Detections as typed blocks: low scores fall away, unknown classes are text."""
    kinds = {0: "title", 1: "text", 3: "image", 4: "caption", 5: "table", 6: "footnote"}
    rows = boxes(spark, d).withColumn("score", F.col("score") / 2000).withColumn("label", (F.col("id") % 8).cast("int"))
    return L.typed_blocks(rows, kinds, "label", "score").select("id", "kind")


@query(f"""with {_B}, t as (select id t_id, page, (x0 + x1) / 2 cx, (y0 + y1) / 2 cy from b where id % 2 = 1), a as (select * from b where id % 2 = 0),
i as (select a.id, t.t_id, t.cx >= a.x0 and t.cx <= a.x1 and t.cy >= a.y0 and t.cy <= a.y1 inside from a join t on t.page = a.page
 where t.cx >= a.x0 - 0.1 * (a.x1 - a.x0) and t.cx <= a.x1 + 0.1 * (a.x1 - a.x0) and t.cy >= a.y0 - 0.1 * (a.y1 - a.y0) and t.cy <= a.y1 + 0.1 * (a.y1 - a.y0)),
n as (select id, cast(count(*) filter (inside) as bigint) n_in, count(*) n_near from i group by 1)
select a.id, cast(coalesce(case when n_in > 0 then n_in else n_near end, 0) as bigint) texts from a left join n on n.id = a.id""")
def native_text_fill(spark: SparkSession, d: str) -> DataFrame:
    """Texts inside each block, or where there are none inside it with a tenth of padding."""
    b = boxes(spark, d)
    return L.texts_in_blocks(b.where("id % 2 = 0"), b.where("id % 2 = 1"), ["page"], "id")


@query(f"""with {_B}, r as (select a.id, b2.id o, {_PAIR} / least((a.x1 - a.x0) * (a.y1 - a.y0), (b2.x1 - b2.x0) * (b2.y1 - b2.y0)) s, b2.y0, b2.x0 from b a join b b2 on a.page = b2.page and a.id % 2 = 0 and b2.id % 2 = 1)
select b.page, b.id, t.filled from b left join (select id, count(*) n, string_agg('t' || o, ' ' order by s desc, y0, x0, 't' || o) filled from r where s > 0.3 group by 1) t on t.id = b.id where b.id % 2 = 0""")
def block_fill(spark: SparkSession, d: str) -> DataFrame:
    """Every block with the texts that overlap it."""
    b = boxes(spark, d)
    return L.filled_blocks(b.where("id % 2 = 0"), b.where("id % 2 = 1").withColumn("text", F.concat(F.lit("t"), F.col("id").cast("string"))), ["page"], "id")


@query(None)
def embed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Offline vectors of the documents."""
    return providers.embed(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "values")


@query(None)
def pipeline_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The documents through repair, elements, sizes and merging."""
    children, _ = pipeline.process_documents(table(spark, d, "documents").select("doc_id", "text"))
    return children.select("doc_id", "chunk_id", "parent_id", "section_label", "tokens", "element_type")


@query(None)
def pipeline_parents(spark: SparkSession, d: str) -> DataFrame:
    """The parents of the documents' chunks."""
    _, parents = pipeline.process_documents(table(spark, d, "documents").select("doc_id", "text"))
    return parents.select("doc_id", "parent_id", "parent_type", "child_ids", "page_nos", "tokens")


@query(None)
def pipeline_query(spark: SparkSession, d: str) -> DataFrame:
    """Questions through chunking, indexing, search, reranking and context assembly."""
    children, parents = (checkpoint(x) for x in pipeline.process_documents(table(spark, d, "documents").select("doc_id", "text")))
    questions = spark.createDataFrame([("q1", "debt service coverage of the borrower"), ("q2", "insurance of the collateral")], "question_id string, question string")
    return pipeline.answer_context(pipeline.index(children), children, parents, questions).select("question_id", "place", "kind", "chunk_id", "tokens", "kept")
