"""Queries on referential integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.operators.orphans import chunk_reference_orphans
from docengine.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    return chunk_reference_orphans(t("chunks"), t("parent_chunks"), t("chunk_tombstones"), t("citations"), t("candidates"))


def p4_per_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references counted per table and month."""
    return p4_found(spark, sf_dir).groupBy("ref_table", "period").agg(F.count("*").alias("orphans"))


_P4 = r"""
with ev as (
  select 'c:' || lower(trim(chunk_id, e' \t\r\n')) k, ingested_at t, 0 dead from chunks
  union all select 'p:' || lower(trim(chunk_id, e' \t\r\n')), ingested_at, 0 from parent_chunks
  union all select 'c:' || lower(trim(chunk_id, e' \t\r\n')), deleted_at, 1 from chunk_tombstones
  union all select 'p:' || lower(trim(chunk_id, e' \t\r\n')), deleted_at, 1 from chunk_tombstones),
r as (
  select 'chunks' ref_table, cast(chunk_id as varchar) ref_key, 'p:' || nullif(lower(trim(parent_id, e' \t\r\n')), '') k, min(ingested_at) t from chunks group by 1, 2, 3
  union all
  select 'citations', cast(citation_id as varchar), 'c:' || nullif(lower(trim(chunk_id, e' \t\r\n')), ''), min(created_at) from citations group by 1, 2, 3
  union all
  select 'candidates', cast(candidate_id as varchar),
    case when lower(trim(namespace)) = 'parents' then 'p:' else 'c:' end || nullif(lower(trim(chunk_id, e' \t\r\n')), ''), min(retrieved_at) from candidates group by 1, 2, 3),
s as (
  select r.ref_table, r.ref_key, r.t, r.k, max({'t': ev.t, 'dead': ev.dead}) l
  from r left join ev on ev.k = r.k and ev.t <= r.t where r.k is not null and r.t is not null group by 1, 2, 3, 4)
select distinct ref_table, ref_key, strftime(t, '%Y-%m') period from s where l is null or l.t is null or l.dead = 1
"""

QUERIES = {"p4_found": p4_found, "p4_per_period": p4_per_period}
ORACLE = {"p4_found": _P4, "p4_per_period": f"select ref_table, period, count(*) orphans from ({_P4}) group by 1, 2"}
