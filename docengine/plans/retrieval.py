"""Queries on vector search, candidates and context packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.functions import text as T
from docengine.operators import context as X
from docengine.operators import retrieval as R
from docengine.operators import template as E
from docengine.operators.shapes import latest, top_k
from docengine.session import table

CURRENT = "cur as (select * from chunks where chunk_id is not null qualify row_number() over (partition by chunk_id order by ingested_at desc nulls last, line_end desc nulls last) = 1)"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]]


_SCORE = "round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6)"
_Q = "(select embedding from embeddings where vec_id = 0) q"


@query(f"select vec_id, label, {_SCORE} score, cast(row_number() over (order by {_SCORE} desc, vec_id) as integer) as rank from embeddings e, {_Q} qualify rank <= 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.vector_top_k(table(spark, d, "embeddings"), "embedding", "vec_id", _query_vector(spark, d), 10).select("vec_id", "label", "score", "rank")


@query(f"select vec_id, label, {_SCORE} score, cast(row_number() over (order by {_SCORE} desc, vec_id) as integer) as rank from embeddings e, {_Q} where label in (1, 2, 3) qualify rank <= 10")
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    where = R.metadata_filter({"label": [1, 2, 3]})
    return R.vector_top_k(table(spark, d, "embeddings"), "embedding", "vec_id", _query_vector(spark, d), 10, where).select("vec_id", "label", "score", "rank")


@query(f"select vec_id, label, {_SCORE} score, cast(row_number() over (partition by label order by {_SCORE} desc, vec_id) as integer) as rank from embeddings e, {_Q} qualify rank <= 3")
def vector_topk_per_label(spark: SparkSession, d: str) -> DataFrame:
    scored = table(spark, d, "embeddings").withColumn("score", F.round(R.cosine(F.col("embedding"), _query_vector(spark, d)), 6))
    return top_k(scored, ["label"], 3, F.desc("score"), F.col("vec_id")).select("vec_id", "label", "score", "rank")


_USABLE = "namespace is not null and coalesce(id, '') <> '' and len(values) > 0 and upserted_at is not null"


@query(f"select namespace, id, max(upserted_at) upserted_at from vector_records where {_USABLE} group by 1, 2")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "vector_records").where("namespace is not null and coalesce(id, '') <> '' and size(values) > 0 and upserted_at is not null")
    return latest(rows, ["namespace", "id"], F.desc("upserted_at")).select("namespace", "id", "upserted_at")


@query("select namespace, count(*) records, count(distinct id) ids, cast(max(len(values)) as integer) widest, cast(count(*) filter (len(values) = 64) as bigint) of_width_64 from vector_records group by 1")
def namespace_stats(spark: SparkSession, d: str) -> DataFrame:
    width = F.when(F.col("values").isNotNull(), F.size("values"))
    return table(spark, d, "vector_records").groupBy("namespace").agg(
        F.count("*").alias("records"), F.count_distinct("id").alias("ids"), F.max(width).alias("widest"), F.count(F.when(width == 64, 1)).alias("of_width_64")
    )


@query(f"with {CURRENT} select c.candidate_id, c.run_id, k.doc_id chunk_doc, md5(substr(k.raw_md_fragment, 1, 1200)) snippet_md5 from candidates c join cur k on lower(trim(c.chunk_id)) = lower(trim(k.chunk_id))")
def hydrate_candidates(spark: SparkSession, d: str) -> DataFrame:
    return R.hydrate(table(spark, d, "candidates"), table(spark, d, "chunks")).select("candidate_id", "run_id", "chunk_doc", F.md5(F.col("snippet").cast("binary")).alias("snippet_md5"))


@query(f"with {CURRENT} select c.citation_id ord, lower(trim(c.chunk_id)) as key, k.doc_id chunk_doc, k.section_label from (select distinct citation_id, nullif(lower(trim(chunk_id)), '') chunk_id from citations) c left join cur k on c.chunk_id = lower(trim(k.chunk_id))")
def bulk_lookup_ordered(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "citations").select(F.col("citation_id").alias("ord"), R.clean_id("chunk_id").alias("chunk_id")).distinct()
    return R.lookup(keys, table(spark, d, "chunks")).select("ord", "key", "chunk_doc", "section_label").orderBy("ord")


@query("select candidate_id, field_id, score from candidates where metadata.element_type in ('mixed', 'table') and namespace = 'children' and score >= 0.05")
def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    where = R.metadata_filter({"metadata.element_type": ["mixed", "table"], "namespace": "children"})
    return table(spark, d, "candidates").where(where & (F.col("score") >= 0.05)).select("candidate_id", "field_id", "score")


@query("""select chunk_id, element_type, coalesce(section_label, 'Unknown') section, token_count from chunks
where element_type in ('mixed', 'paragraph') and len(list_filter(page_nos, lambda p: p between 2 and 5)) > 0 and token_count between 50 and 400""")
def chunk_browser_filter(spark: SparkSession, d: str) -> DataFrame:
    pages = F.exists("page_nos", lambda p: p.between(2, 5))
    rows = table(spark, d, "chunks").where(F.col("element_type").isin("mixed", "paragraph") & pages & F.col("token_count").between(50, 400))
    return rows.select("chunk_id", "element_type", F.coalesce("section_label", F.lit("Unknown")).alias("section"), "token_count")


_REL = """
rel as (select c.candidate_id, c.run_id, c.field_id, c.score,
  list_distinct(list_filter(regexp_split_to_array(lower(c.field_id), '[^a-z0-9]+'), lambda w: length(w) > 1)) q,
  list_distinct(list_filter(regexp_split_to_array(lower(substr(k.raw_md_fragment, 1, 1200)), '[^a-z0-9]+'), lambda w: length(w) > 1)) t
  from candidates c join cur k on lower(trim(c.chunk_id)) = lower(trim(k.chunk_id)) where k.raw_md_fragment is not null),
s as (select candidate_id, run_id, field_id, cast(case when len(q) > 0 then floor(len(list_intersect(q, t)) * 100 / len(q)) else 0 end as integer) relevance from rel)"""


def _relevance(spark: SparkSession, d: str) -> DataFrame:
    rows = R.hydrate(table(spark, d, "candidates"), table(spark, d, "chunks")).where("snippet is not null")
    return rows.select("candidate_id", "run_id", "field_id", R.lexical_relevance(F.col("field_id"), F.col("snippet")).alias("relevance"))


@query(f"with {CURRENT}, {_REL} select candidate_id, relevance, case when relevance >= 40 then 'yes' else 'no' end answerable, case when relevance >= 70 then 'high' when relevance >= 40 then 'medium' else 'low' end band from s")
def rerank_lexical(spark: SparkSession, d: str) -> DataFrame:
    score = F.col("relevance")
    return _relevance(spark, d).select("candidate_id", "relevance", R.answerability(score).alias("answerable"), R.relevance_band(score).alias("band"))


@query(f"with {CURRENT}, {_REL} select run_id, field_id, candidate_id, relevance, cast(row_number() over (partition by run_id, field_id order by relevance desc, candidate_id) as integer) as rank from (select distinct * from s) qualify rank <= 15")
def rerank_cut(spark: SparkSession, d: str) -> DataFrame:
    return top_k(_relevance(spark, d).distinct(), ["run_id", "field_id"], 15, F.desc("relevance"), F.col("candidate_id")).select("run_id", "field_id", "candidate_id", "relevance", "rank")


_BEST = "best as (select distinct candidate_id, run_id, field_id, namespace, lower(trim(chunk_id)) k, score, metadata.doc_id doc from candidates where score is not null)"


@query(f"with {_BEST} select run_id, field_id, candidate_id, score, cast(row_number() over (partition by run_id, field_id order by score desc, candidate_id) as integer) as rank from best qualify rank <= 20")
def trace_top20(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidates").where("score is not null").select("run_id", "field_id", "candidate_id", "score").distinct()
    return top_k(rows, ["run_id", "field_id"], 20, F.desc("score"), F.col("candidate_id"))


@query(f"""with {_BEST}, d3 as (select *, row_number() over (partition by run_id, field_id, doc order by score desc, candidate_id) r from best where doc is not null qualify r <= 3)
select run_id, field_id, doc, candidate_id, score, cast(row_number() over (partition by run_id, field_id order by score desc, candidate_id) as integer) as rank from d3 qualify rank <= 10""")
def context_per_doc(spark: SparkSession, d: str) -> DataFrame:
    """Top three of each file, then the ten best of each field."""
    rows = table(spark, d, "candidates").where("score is not null and metadata.doc_id is not null").select("run_id", "field_id", F.col("metadata.doc_id").alias("doc"), "candidate_id", "score").distinct()
    three = top_k(rows, ["run_id", "field_id", "doc"], 3, F.desc("score"), F.col("candidate_id"), name="r")
    return top_k(three, ["run_id", "field_id"], 10, F.desc("score"), F.col("candidate_id")).select("run_id", "field_id", "doc", "candidate_id", "score", "rank")


@query(f"""with recursive {CURRENT}, hits as (select c.run_id, c.field_id, k.chunk_id, cast(ceil(length(k.raw_md_fragment) / 4.0) as integer) size, max(c.score) score
  from candidates c join cur k on lower(trim(c.chunk_id)) = lower(trim(k.chunk_id)) where c.namespace = 'children' and c.score is not null and k.raw_md_fragment is not null group by 1, 2, 3, 4),
p as (select *, cast(row_number() over (partition by run_id, field_id order by score desc, chunk_id) as integer) as rank from hits),
w as (select run_id, field_id, rank, chunk_id, size, cast(size as bigint) used, true kept from p where rank = 1
  union all select p.run_id, p.field_id, p.rank, p.chunk_id, p.size, w.used + case when p.rank <= 3 or w.used + p.size <= 12000 then p.size else 0 end, p.rank <= 3 or w.used + p.size <= 12000
  from w join p on p.run_id = w.run_id and p.field_id = w.field_id and p.rank = w.rank + 1)
select run_id, field_id, rank, chunk_id, size, kept from w""")
def context_pack(spark: SparkSession, d: str) -> DataFrame:
    hits = R.hydrate(table(spark, d, "candidates").where("namespace = 'children' and score is not null"), table(spark, d, "chunks"), limit=1 << 30).where("snippet is not null")
    hits = hits.groupBy("run_id", "field_id", F.col("key").alias("chunk_id"), F.ceil(F.length("snippet") / 4).cast("int").alias("size")).agg(F.max("score").alias("score"))
    ranked = top_k(hits, ["run_id", "field_id"], 1 << 30, F.desc("score"), F.col("chunk_id"))
    return R.context_packs(ranked, ["run_id", "field_id"])


_ORD = "select chunk_id, doc_id, element_type, lower(trim(parent_id)) parent_id, page_span[1] first_page, page_span[2] last_page, coalesce(line_start, line_end, 0) ord from cur"


def ordered(spark: SparkSession, d: str) -> DataFrame:
    return R.current_chunks(table(spark, d, "chunks")).select(
        "chunk_id", "doc_id", "element_type", R.clean_id("parent_id").alias("parent_id"), F.col("page_span")[0].alias("first_page"), F.col("page_span")[1].alias("last_page"),
        F.coalesce("line_start", "line_end", F.lit(0)).alias("ord"),
    )


@query(f"""with {CURRENT}, o as ({_ORD}), n as (select chunk_id, lag(chunk_id) over w a, lead(chunk_id) over w b from o where coalesce(parent_id, '') <> '' window w as (partition by parent_id order by ord, chunk_id))
select chunk_id, a neighbour_id, -1 as "offset" from n where a is not null union all select chunk_id, b, 1 from n where b is not null""")
def sibling_chunks(spark: SparkSession, d: str) -> DataFrame:
    return R.siblings(ordered(spark, d))


_CROSS = f"""o as ({_ORD}), x as (
  select a.chunk_id, b.chunk_id neighbour_id, 'before' side, a.element_type = b.element_type same, b.ord from o a join o b on a.doc_id = b.doc_id and b.last_page = a.first_page - 1
  union all select a.chunk_id, b.chunk_id, 'after', a.element_type = b.element_type, b.ord from o a join o b on a.doc_id = b.doc_id and b.first_page = a.last_page + 1),
y as (select chunk_id, neighbour_id, side, cast(row_number() over (partition by chunk_id, side order by cast(same as int) desc, ord, neighbour_id) as integer) as rank from x where chunk_id <> neighbour_id qualify rank <= 2)"""


@query(f"with {CURRENT}, {_CROSS} select * from y")
def cross_page_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return R.cross_page_neighbours(ordered(spark, d))


@query(f"""with {CURRENT}, {_CROSS}, n as (select chunk_id, lag(chunk_id) over w a, lead(chunk_id) over w b from o where coalesce(parent_id, '') <> '' window w as (partition by parent_id order by ord, chunk_id)),
u as (select chunk_id, a neighbour_id, 0 place from n where a is not null union all select chunk_id, b, 0 from n where b is not null union all select chunk_id, neighbour_id, 1 from y)
select chunk_id, neighbour_id, min(place) place from u group by 1, 2""")
def neighbor_union(spark: SparkSession, d: str) -> DataFrame:
    rows = ordered(spark, d)
    return R.merged_neighbours(R.siblings(rows), R.cross_page_neighbours(rows))


@query(f"""with {CURRENT} select chunk_id, doc_id, coalesce(page_span[1], 0) page_span_start, coalesce(page_span[2], 0) page_span_end, coalesce(metadata.structure_confidence, 1.0) structure_confidence from cur""")
def index_projection(spark: SparkSession, d: str) -> DataFrame:
    """The metadata of the vector records of the chunks that pass the gate before indexing."""
    return R.current_chunks(table(spark, d, "chunks")).where("chunk_id <> ''").select(
        "chunk_id", "doc_id", F.coalesce(F.col("page_span")[0], F.lit(0)).alias("page_span_start"), F.coalesce(F.col("page_span")[1], F.lit(0)).alias("page_span_end"),
        F.coalesce("metadata.structure_confidence", F.lit(1.0)).alias("structure_confidence"),
    )


# chunks and parents as context assembly takes them; hits are the five best known chunks of each run and field
_POOL = f"""{CURRENT}, ch as (select chunk_id, doc_id, nullif(lower(trim(parent_id)), '') parent_id, coalesce(line_start, line_end, 0) ord, page_span[1] first_page, page_span[2] last_page, element_type,
 cast(ceil(length(text_for_embedding) / 4.0) as integer) tokens from cur where text_for_embedding is not null),
par as (select chunk_id, cast(ceil(length(text_for_embedding) / 4.0) as integer) tokens from parent_chunks where text_for_embedding is not null and chunk_id is not null qualify row_number() over (partition by chunk_id order by ingested_at desc nulls last, line_end desc nulls last) = 1),
hit as (select run_id, field_id, k chunk_id, row_number() over (partition by run_id, field_id order by s desc nulls last, k) rnk
 from (select run_id, field_id, lower(trim(chunk_id)) k, max(score) s from candidates where lower(trim(chunk_id)) in (select chunk_id from ch) group by 1, 2, 3) qualify rnk <= 5)"""


def pool(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = R.current_chunks(table(spark, d, "chunks")).where("text_for_embedding is not null")
    chunks = rows.select("chunk_id", "doc_id", R.clean_id("parent_id").alias("parent_id"), F.coalesce("line_start", "line_end", F.lit(0)).alias("ord"), F.col("page_span")[0].alias("first_page"), F.col("page_span")[1].alias("last_page"), "element_type", F.col("text_for_embedding").alias("text"), T.tokens(F.col("text_for_embedding")).alias("tokens"))
    parents = R.current_chunks(table(spark, d, "parent_chunks").where("text_for_embedding is not null")).select("chunk_id", F.col("text_for_embedding").alias("text"), T.tokens(F.col("text_for_embedding")).alias("tokens"))
    hits = table(spark, d, "candidates").select("run_id", "field_id", F.lower(F.trim("chunk_id")).alias("chunk_id"), "score")
    return X.primaries(hits, chunks, ["run_id", "field_id"], "score", 5), chunks, parents


@query(f"with {_POOL} select run_id, field_id, chunk_id, cast(rnk as integer) as rank from hit")
def primary_hits(spark: SparkSession, d: str) -> DataFrame:
    """The best known chunks of each run and field."""
    return pool(spark, d)[0]


@query(f"with {_POOL} select ch.chunk_id, ch.parent_id, par.tokens parent_tokens from ch left join par on par.chunk_id = ch.parent_id")
def parent_hydrate(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with their parents' texts, where there are such."""
    _, chunks, parents = pool(spark, d)
    return X.with_parents(chunks, parents).select("chunk_id", "parent_id", "parent_tokens")


_PACK = f"""{_POOL}, p as (select run_id, field_id, rnk, ch.* from hit join ch using (chunk_id)),
sib as (select chunk_id, lag(chunk_id) over w a, lead(chunk_id) over w b from ch where parent_id is not null window w as (partition by parent_id order by ord, chunk_id)),
x as (select a.chunk_id, b.chunk_id n, 1 side, a.element_type = b.element_type same, b.ord from ch a join ch b on a.doc_id = b.doc_id and b.last_page = a.first_page - 1
  union all select a.chunk_id, b.chunk_id, 2, a.element_type = b.element_type, b.ord from ch a join ch b on a.doc_id = b.doc_id and b.first_page = a.last_page + 1),
cro as (select chunk_id, n, side, row_number() over (partition by chunk_id, side order by cast(same as int) desc nulls last, ord, n) nth from x where chunk_id <> n qualify nth <= 2),
r as (select run_id, field_id, chunk_id, tokens, 0 c1, rnk c2, 0 c3, 0 c4, 'primary' kind from p
  union all select run_id, field_id, parent_id, par.tokens, 0, rnk, 1, 0, 'parent' from p join par on par.chunk_id = p.parent_id
  union all select run_id, field_id, ch.chunk_id, ch.tokens, 1, rnk, 0, -1, 'sibling' from p join sib on sib.chunk_id = p.chunk_id join ch on ch.chunk_id = sib.a
  union all select run_id, field_id, ch.chunk_id, ch.tokens, 1, rnk, 0, 1, 'sibling' from p join sib on sib.chunk_id = p.chunk_id join ch on ch.chunk_id = sib.b
  union all select p.run_id, p.field_id, ch.chunk_id, ch.tokens, case when o.parent_id is not null then 1 else 2 end, p.rnk, side, nth, case when o.parent_id is not null then 'sibling' else 'cross_page' end
   from p join cro on cro.chunk_id = p.chunk_id join ch on ch.chunk_id = cro.n left join (select distinct run_id, field_id, parent_id from p where parent_id is not null) o on o.run_id = p.run_id and o.field_id = p.field_id and o.parent_id = ch.parent_id),
u as (select run_id, field_id, chunk_id, tokens, kind, row_number() over (partition by run_id, field_id order by c1, c2, c3, c4, chunk_id) rn from (select * from r qualify row_number() over (partition by run_id, field_id, chunk_id order by c1, c2, c3, c4, kind, tokens) = 1)),
v as (select *, kind = 'primary' and count(*) filter (kind = 'primary') over (partition by run_id, field_id order by rn) <= 3 sure from u),
f as (select run_id, field_id, rn, chunk_id, kind, tokens, sure or tokens <= 800 kept, case when sure or tokens <= 800 then tokens else 0 end used from v where rn = 1
  union all select v.run_id, v.field_id, v.rn, v.chunk_id, v.kind, v.tokens, v.sure or f.used + v.tokens <= 800, f.used + case when v.sure or f.used + v.tokens <= 800 then v.tokens else 0 end from f join v on v.run_id = f.run_id and v.field_id = f.field_id and v.rn = f.rn + 1)"""


def _packs(spark: SparkSession, d: str) -> DataFrame:
    hits, chunks, parents = pool(spark, d)
    return X.assemble(hits, chunks, parents, ["run_id", "field_id"], budget=800)


@query(f"with recursive {_PACK} select run_id, field_id, cast(rn - 1 as integer) place, kind, chunk_id, tokens, kept from f")
def context_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Packs of 800 tokens: primaries with their parents, siblings, neighbours of other pages."""
    return _packs(spark, d)


@query(f"""with recursive {_PACK} select run_id, field_id, cast(sum(case when kept then tokens else 0 end) as bigint) final_tokens, coalesce(string_agg(kind || ':' || chunk_id, ',' order by rn) filter (kind <> 'primary'), '') added,
coalesce(string_agg(chunk_id, ',' order by rn) filter (not kept), '') dropped from f group by 1, 2""")
def context_trace(spark: SparkSession, d: str) -> DataFrame:
    """What was added to each pack and what did not fit."""
    rows = X.context_trace(_packs(spark, d), ["run_id", "field_id"])
    return rows.withColumn("added", F.array_join("added", ",")).withColumn("dropped", F.array_join("dropped", ","))


@query(f"""with recursive {_PACK}, tx as (select chunk_id, text_for_embedding t from cur union all select chunk_id, text_for_embedding from (select * from parent_chunks where text_for_embedding is not null and chunk_id is not null qualify row_number() over (partition by chunk_id order by ingested_at desc nulls last, line_end desc nulls last) = 1)),
va as (select f.run_id, f.field_id, f.rn, f.chunk_id, nullif(regexp_extract(tx.t, '([$€£]\\s?[0-9][0-9,]*(?:\\.[0-9]+)?)', 1), '') v from f join tx using (chunk_id) where f.kept)
select p.run_id, p.field_id, x.v as value, x.chunk_id from (select distinct run_id, field_id from f) p left join (select run_id, field_id, arg_min(v, rn) v, arg_min(chunk_id, rn) chunk_id from va where v is not null group by 1, 2) x using (run_id, field_id)""")
def field_values(spark: SparkSession, d: str) -> DataFrame:
    """The first amount in each field's pack, with the chunk that holds it."""
    _, chunks, parents = pool(spark, d)
    amounts = lambda df, name: df.select("chunk_id", E.first_amount(F.col("text")).alias(name)).where(F.col(name).isNotNull())
    # no join over a union of both: Spark takes it to be partitioned as its parts are, and fails where it is not broadcast
    rows = _packs(spark, d).join(amounts(chunks, "own"), "chunk_id", "left").join(amounts(parents, "held"), "chunk_id", "left")
    return E.extracted(rows, ["run_id", "field_id"], F.least("own", "held"))
