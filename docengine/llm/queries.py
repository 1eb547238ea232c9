"""Queries of the training-data operators with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm import contamination, mojibake, neardup, neighbours, packing, scans, splitting
from docengine.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_pairs(table(spark, sf_dir, "chunks"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk with its class of near-duplicates and its number of links."""
    return neardup.duplicate_classes(table(spark, sf_dir, "chunks"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the oversized chunks."""
    return splitting.oversized_chunk_pieces(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "source_docs"), table(spark, sf_dir, "chunk_configs"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pieces(spark, sf_dir).where("piece_no = 0").select("chunk_id").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbour_pairs(table(spark, sf_dir, "vector_records"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.marked_lines(table(spark, sf_dir, "page_blocks"))


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired text of the scanned pages."""
    return scans.repaired_pages(table(spark, sf_dir, "page_blocks"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in containers of 1,024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_containers(spark, sf_dir).where("parts > 1 and part = 0").select("doc_id").distinct()


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing.container_fill(p6_containers(spark, sf_dir))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items per document with the number of matching positions."""
    return contamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items with the number of documents that hold them."""
    return p7_leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled documents with the restored text."""
    return mojibake.garbled_documents(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_restored(spark, sf_dir).select("doc_id").distinct()


QUERIES = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p5_repaired": p5_repaired,
    "p6_found": p6_found,
    "p6_containers": p6_containers,
    "p6_fill": p6_fill,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p7_items": p7_items,
    "p8_found": p8_found,
    "p8_restored": p8_restored,
}

_P1 = r"""
with c as (select distinct chunk_id, coalesce(raw_md_fragment, regexp_extract(text_for_embedding, '(?s)\A.*?\n[ \t\r]*\n(.*)\z', 1)) t from chunks),
w as (select chunk_id, regexp_extract_all(lower(t), '[a-z0-9]+') w from c),
s as (select distinct chunk_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g from (select chunk_id, w, unnest(range(1, len(w) - 1)) i from w where len(w) >= 30)),
n as (select chunk_id, count(*) n from s group by 1),
b as (select x.chunk_id a, y.chunk_id b, count(*) m from s x join s y on x.g = y.g and x.chunk_id < y.chunk_id group by 1, 2)
select b.a chunk_id_a, b.b chunk_id_b from b join n p on p.chunk_id = b.a join n q on q.chunk_id = b.b where m >= 0.6 * (p.n + q.n - m) - 1e-9"""
_P7 = r"""
with w as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from documents where text is not null),
i as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from eval_items where text is not null),
iw as (select distinct item_id, array_to_string(w[s : s + 19], ' ') g from (select item_id, w, unnest(range(1, len(w) - 18)) s from i where len(w) >= 20)),
dw as (select doc_id, s, array_to_string(w[s : s + 19], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 18)) s from w where len(w) >= 20))
select doc_id, item_id, count(distinct s) windows from dw join iw using (g) group by 1, 2
"""

ORACLE: dict[str, str] = {
    "p1_found": _P1,
    "p1_classes": r"""
with recursive c as (select distinct chunk_id, coalesce(raw_md_fragment, regexp_extract(text_for_embedding, '(?s)\A.*?\n[ \t\r]*\n(.*)\z', 1)) t from chunks where chunk_id is not null),
d as (select chunk_id, t, min(chunk_id) over (partition by t) rep from c where length(t) >= 59),
w as (select distinct rep, regexp_extract_all(lower(t), '[a-z0-9]+') w from d),
s as (select distinct rep, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g from (select rep, w, unnest(range(1, len(w) - 1)) i from w where len(w) >= 30)),
n as (select rep, count(*) n from s group by 1),
b as (select x.rep a, y.rep b, count(*) m from s x join s y on x.g = y.g and x.rep <> y.rep group by 1, 2),
e as (select b.a, b.b from b join n p on p.rep = b.a join n q on q.rep = b.b where m >= 0.6 * (p.n + q.n - m) - 1e-9),
r as (select rep a, rep b from d union select r.a, e.b from r join e on e.a = r.b),
k as (select a rep, min(b) cls from r group by 1),
l as (select a rep, count(*) links from e group by 1),
x as (select d.chunk_id, k.cls, coalesce(l.links, 0) links from d join k using (rep) left join l using (rep))
select distinct chunk_id, min(chunk_id) over (partition by cls) class_id, links from x""",
    "p3_found": """
with u as (select namespace ns, id, values::double[] v from vector_records where coalesce(id, '') <> '' and len(values) = 64
  and len(list_filter(values, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(values, lambda x: x <> 0)) > 0
  qualify row_number() over (partition by namespace, id order by upserted_at desc) = 1),
t as (select a.ns, a.id a, b.id b from u a join u b on a.ns = b.ns and a.id <> b.id qualify row_number() over (partition by a.ns, a.id order by list_cosine_similarity(a.v, b.v) desc) <= 5)
select distinct least(a, b) id_a, greatest(a, b) id_b from t""",
    "p2_found": """
with f as (select doc_id, max_by(config_id, parsed_at) config_id from source_docs group by 1)
select distinct chunk_id from chunks left join f using (doc_id) left join chunk_configs c on c.config_id = f.config_id
where ceil(length(raw_md_fragment) / 4.0) > coalesce(c.prose_target_tokens, 512)""",
    "p6_found": r"select doc_id from documents where len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]+')) > 1024",
    "p7_found": f"select doc_id, item_id from ({_P7})",
    "p7_leaks": _P7,
    "p7_items": f"select item_id, count(*) documents from ({_P7}) group by 1",
}
