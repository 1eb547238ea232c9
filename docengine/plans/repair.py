"""Queries on repairs. The chunks' lines are damaged first, by the same rule in both languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.operators import repair as P
from docengine.plans.chunking import _LINES, chunk_lines
from docengine.plans.retrieval import CURRENT

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _tables(src: str, out: str) -> str:
    """CTEs: rules put below the heads of tables that have none."""
    p = out + "_"
    return rf"""{p}a as (select *, contains(trim(line), '|') p, regexp_matches(trim(line), '^[\s|:-]+$') r from {src}),
{p}b as (select *, sum(case when p or r then 0 else 1 end) over (partition by chunk_id order by line_no) blk from {p}a),
{p}c as (select *, (p or r) and max(case when p then 1 else 0 end) over (partition by chunk_id, blk order by line_no) = 1 mem from {p}b),
{p}d as (select *, mem and line_no = min(case when mem then line_no end) over (partition by chunk_id, blk) and count(*) filter (mem) over (partition by chunk_id, blk) >= 2
  and not coalesce(bool_or(mem and r) over (partition by chunk_id, blk), false) fix from {p}c),
{p}e as (select chunk_id, line_no, fix, unnest(case when fix then [line, '|' || array_to_string(list_transform(range(length(trim(line)) - length(replace(trim(line), '|', ''))), lambda x: ' --- '), '|') || '|'] else [line] end) line,
  unnest(case when fix then [0, 1] else [0] end) k from {p}d),
{out} as (select chunk_id, cast(row_number() over (partition by chunk_id order by line_no, k) - 1 as integer) line_no, line, case when fix and k = 0 then 'table_repair' end repair from {p}e)"""


def _lists(src: str, out: str) -> str:
    """CTEs: lists of mixed markers given their first one, items joined with what goes on."""
    p = out + "_"
    return rf"""{p}a as (select *, regexp_matches(trim(line), '^([-*+]|[0-9]+\.)\s+(.+)$') it, trim(line) <> '' and not regexp_matches(trim(line), '^([-*+]|[0-9]+\.)\s+(.+)$') and regexp_matches(line, '^\s') mo from {src}),
{p}b as (select *, sum(case when it or mo then 0 else 1 end) over (partition by chunk_id order by line_no) blk, case when it then regexp_extract(trim(line), '^([-*+]|[0-9]+\.)\s+(.+)$', 1) end mark from {p}a),
{p}c as (select *, count(*) filter (it) over (partition by chunk_id, blk order by line_no) nth, min(mark) over (partition by chunk_id, blk) <> max(mark) over (partition by chunk_id, blk) mixed,
  first_value(mark ignore nulls) over (partition by chunk_id, blk order by line_no rows between unbounded preceding and unbounded following) fst from {p}b),
{p}d as (select *, (it or mo) and nth > 0 and coalesce(mixed, false) ch from {p}c),
{p}e as (select chunk_id, blk, case when ch then nth else 0 end i, case when ch then -1 else line_no end l, ch, min(line_no) line_no, min(fst) fst, coalesce(bool_or(mark <> fst), false) oth,
  string_agg(case when ch and it then regexp_extract(trim(line), '^([-*+]|[0-9]+\.)\s+(.+)$', 2) when ch then trim(line) else line end, ' ' order by line_no) t from {p}d group by all),
{out} as (select chunk_id, cast(row_number() over (partition by chunk_id order by line_no) - 1 as integer) line_no, case when ch then fst || ' ' || t else t end line, case when ch and oth then 'list_repair' end repair from {p}e)"""


def _sections(src: str, out: str) -> str:
    """CTEs: a blank line before labels."""
    p = out + "_"
    return rf"""{p}a as (select *, trim(lag(line) over (partition by chunk_id order by line_no)) b from {src}),
{p}b as (select *, coalesce(regexp_matches(trim(line), '^[A-Z][a-z]+(\s+[A-Z][a-z]+)*:\s*$') and b <> '' and not regexp_matches(b, '^#+(\s.*)?$'), false) fix from {p}a),
{p}c as (select chunk_id, line_no, fix, unnest(case when fix then ['', line] else [line] end) line, unnest(case when fix then [0, 1] else [0] end) k from {p}b),
{out} as (select chunk_id, cast(row_number() over (partition by chunk_id order by line_no, k) - 1 as integer) line_no, line, case when fix and k = 0 then 'section_repair' end repair from {p}c)"""


def _odd(column: str) -> str:
    return f"substring({column}, length({column}), 1) in ('1', '3', '5', '7', '9', 'b', 'd', 'f')"


#: In chunks with an odd id rules are missing; every item has one of three markers by its line and a long one goes on in an indented line;
#: blank lines are missing and headings are labels.
_DAMAGED = rf"""d0 as (select chunk_id, line_no, line from ln where not ({_odd('chunk_id')} and regexp_matches(trim(line), '^[\s|:-]+$')) and trim(line) <> ''),
d1 as (select chunk_id, line_no, case when {_odd('chunk_id')} and regexp_matches(line, '^#+ [A-Z][a-z]+( [A-Z][a-z]+)*$') then regexp_replace(line, '^#+ ', '') || ':' when regexp_matches(line, '^- ') then case line_no % 3 when 0 then '* ' when 1 then '- ' else '7. ' end || substring(line, 3) else line end line from d0),
d2 as (select chunk_id, line_no, unnest(case when regexp_matches(line, '^([-*]|7\.) ') and length(line) > 40 then [substring(line, 1, 30), '    x' || substring(line, 31)] else [line] end) line, unnest(case when regexp_matches(line, '^([-*]|7\.) ') and length(line) > 40 then [0, 1] else [0] end) k from d1),
dam as (select chunk_id, row_number() over (partition by chunk_id order by line_no, k) line_no, line from d2)"""
_FROM = f"with {CURRENT}, {_LINES}, {_DAMAGED}"


def damaged(spark: SparkSession, d: str) -> DataFrame:
    rows = chunk_lines(spark, d).select("chunk_id", "line_no", "line").withColumn("odd", F.expr(_odd("chunk_id")))
    rows = rows.where(~(F.col("odd") & F.trim("line").rlike(r"^[\s|:-]+$")) & (F.trim("line") != ""))
    label = F.concat(F.regexp_replace("line", "^#+ ", ""), F.lit(":"))
    mark = F.when(F.col("line_no") % 3 == 0, "* ").when(F.col("line_no") % 3 == 1, "- ").otherwise("7. ")
    line = F.when(F.col("odd") & F.col("line").rlike("^#+ [A-Z][a-z]+( [A-Z][a-z]+)*$"), label).when(F.col("line").rlike("^- "), F.concat(mark, F.expr("substring(line, 3)"))).otherwise(F.col("line"))
    rows = rows.withColumn("line", line)
    two = F.array(F.expr("substring(line, 1, 30)"), F.concat(F.lit("    x"), F.expr("substring(line, 31)")))
    rows = rows.select("chunk_id", "line_no", F.posexplode(F.when(F.col("line").rlike(r"^([-*]|7\.) ") & (F.length("line") > 40), two).otherwise(F.array("line"))).alias("k", "line"))
    return rows.withColumn("line_no", F.col("line_no") * 2 + F.col("k")).drop("k")


@query(f"{_FROM}, {_tables('dam', 'tb')} select * from tb")
def table_repair(spark: SparkSession, d: str) -> DataFrame:
    """Tables with their missing rules put in."""
    return P.repair_tables(damaged(spark, d), ["chunk_id"])


@query(f"{_FROM}, {_lists('dam', 'li')} select * from li")
def list_repair(spark: SparkSession, d: str) -> DataFrame:
    """Lists with one marker, an item a line."""
    return P.repair_lists(damaged(spark, d), ["chunk_id"])


@query(f"{_FROM}, {_sections('dam', 'se')} select * from se")
def section_repair(spark: SparkSession, d: str) -> DataFrame:
    """Labels with a blank line before them."""
    return P.repair_sections(damaged(spark, d), ["chunk_id"])


@query(f"""{_FROM}, {_tables('dam', 'tb')}, {_lists('tb', 'li')}, {_sections('li', 'se')},
n1 as (select chunk_id, count(repair) t from tb group by 1), n2 as (select chunk_id, count(repair) l from li group by 1), n3 as (select chunk_id, count(repair) s, md5(string_agg(line, chr(10) order by line_no)) repaired_md5, bool_or(starts_with(trim(line), '#')) h from se group by 1)
select chunk_id, repaired_md5, t table_repairs, l list_repairs, s section_repairs, case when t + l + s = 0 then 1.0 else round(greatest(0.0, least(1.0, 1.0 - least(0.3, 0.1 * (t + l + s)) - 0.15 * t - 0.1 * l - 0.05 * s + case when h then 0.1 else 0.0 end)), 6) end::double structure_confidence
from n1 join n2 using (chunk_id) join n3 using (chunk_id)""")
def repair_driver(spark: SparkSession, d: str) -> DataFrame:
    """All repairs of each chunk's text one after another, with the confidence in the result."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    texts = damaged(spark, d).groupBy("chunk_id").agg(body.alias("text"))
    return P.repair_text(texts, ["chunk_id"], "text").withColumn("repaired_md5", F.md5(F.col("repaired").cast("binary"))).drop("repaired")
