"""Queries on fields, rules, drafts, events and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.functions import text as T
from docengine.operators import quality as Q
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


_FIELD = "case when regexp_matches(lower({0}), 'amount|price|cost|fee|loan') then 'currency' when regexp_matches(lower({0}), 'date') then 'date' when regexp_matches(lower({0}), 'number|count|quantity') then 'number' else 'text' end"


@query(f"select field_id, {_FIELD.format('field_id')} field_type, case when {_FIELD.format('field_id')} in ('currency', 'number') or contains(lower(field_id), 'financial') then 'financial' else 'covenant' end plan, count(*) hits from candidates group by 1, 2, 3")
def extraction_plan(spark: SparkSession, d: str) -> DataFrame:
    kind = T.field_type(F.col("field_id"))
    plan = F.when(kind.isin("currency", "number") | F.lower("field_id").contains("financial"), "financial").otherwise("covenant")
    return table(spark, d, "candidates").groupBy("field_id", kind.alias("field_type"), plan.alias("plan")).agg(F.count("*").alias("hits"))


@query("""select run_id, cast(count(*) as bigint) fields, cast(count(*) filter (cited > 0) as bigint) filled, round(count(*) filter (cited > 0) / count(*), 6) completeness
from (select run_id, field_id, max(cited) cited from (select run_id, field_id, 0 cited from candidates union all select run_id, field_id, 1 from citations) group by 1, 2) group by 1""")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "candidates").select("run_id", "field_id").unionByName(table(spark, d, "citations").select("run_id", "field_id")).distinct()
    filled = table(spark, d, "citations").select("run_id", "field_id").distinct()
    return Q.completeness(asked, filled, ["run_id"], ["field_id"])


@query("select field_id, round(avg(score), 4) confidence, count(score) scored from candidates group by 1")
def confidence_mean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates").groupBy("field_id").agg(F.round(F.avg("score"), 4).alias("confidence"), F.count("score").alias("scored"))


_RULES = """rules(rule_id, field, condition, lo, hi, severity) as (values ('r1', 'click', 'max', cast(null as double), 50.0::double, 'warning'), ('r2', 'error', 'min', 5.0::double, cast(null as double), 'error'), ('r3', 'view', 'range', 10.0::double, 60.0::double, 'error'))"""
_CHECK = f"""{_RULES}, ck as (select e.event_id, r.rule_id, e.event_type, case when e.value is null then 'warning' when (r.condition in ('max', 'range') and e.value > r.hi) or (r.condition in ('min', 'range') and e.value < r.lo) then r.severity else 'pass' end status from events e join rules r on r.field = e.event_type)"""


def _rules(spark: SparkSession) -> DataFrame:
    rows = [("r1", "click", "max", None, 50.0, "warning"), ("r2", "error", "min", 5.0, None, "error"), ("r3", "view", "range", 10.0, 60.0, "error")]
    return spark.createDataFrame(rows, "rule_id string, field string, condition string, lo double, hi double, severity string")


@query(f"with {_CHECK} select event_id, rule_id, status from ck")
def rule_check(spark: SparkSession, d: str) -> DataFrame:
    return Q.check_rules(table(spark, d, "events"), _rules(spark), "event_type", "value").select("event_id", "rule_id", "status")


@query(f"with {_CHECK} select event_type, count(*) checks, round((count(*) filter (status = 'pass') + 0.5 * count(*) filter (status = 'warning')) / count(*), 6) score from ck group by 1")
def validation_score(spark: SparkSession, d: str) -> DataFrame:
    checked = Q.check_rules(table(spark, d, "events"), _rules(spark), "event_type", "value")
    return checked.groupBy("event_type").agg(F.count("*").alias("checks"), Q.validation_score(F.col("status")).alias("score"))


_DRAFTS = """a as (select o_custkey, max(o_totalprice) v from orders where o_orderdate < timestamp '1996-01-01' group by 1), b as (select o_custkey, max(o_totalprice) v from orders where o_orderdate >= timestamp '1996-01-01' group by 1)"""


def _drafts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders")
    cut = F.lit("1996-01-01").cast("timestamp_ntz")
    half = lambda where: o.where(where).groupBy("o_custkey").agg(F.max("o_totalprice").alias("v"))
    return half(F.col("o_orderdate") < cut), half(F.col("o_orderdate") >= cut)


@query(f"with {_DRAFTS} select coalesce(a.o_custkey, b.o_custkey) o_custkey, case when a.o_custkey is null then 'added' when b.o_custkey is null then 'removed' else 'changed' end change, a.v old, b.v new from a full join b on a.o_custkey = b.o_custkey where a.v is distinct from b.v")
def draft_diff(spark: SparkSession, d: str) -> DataFrame:
    return Q.diff(*_drafts(spark, d), ["o_custkey"], "v")


@query(f"with {_DRAFTS} select 'added' kind, count(*) n from (select o_custkey from b except select o_custkey from a) union all select 'removed', count(*) from (select o_custkey from a except select o_custkey from b) union all select 'common', count(*) from (select o_custkey from a intersect select o_custkey from b)")
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    a, b = (x.select("o_custkey") for x in _drafts(spark, d))
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(b.subtract(a), "added").unionByName(count(a.subtract(b), "removed")).unionByName(count(a.intersect(b), "common"))


@query("""select event_id, cast(json_extract(props, '$.k') as integer) k, case when cast(json_extract(props, '$.k') as integer) between 0 and 100 then 'ok' else 'invalid' end status from events""")
def json_extract_status(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").select("event_id", k.alias("k"), F.when(k.between(0, 100), "ok").otherwise("invalid").alias("status"))


@query("""select event_id, case when contains(s, 'error') then 'error' when contains(s, 'warning') then 'warning' when s = 'pass' then 'pass' else 'warning' end status from (select event_id, lower(trim(case when event_type = 'view' then 'pass' else event_type || '|pass' end)) s from events)""")
def status_normalize(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_type") == "view", "pass").otherwise(F.concat("event_type", F.lit("|pass")))
    return table(spark, d, "events").select("event_id", T.worst_status(raw).alias("status"))


@query("""select event_id, k from (select event_id, cast(json_extract(props, '$.k') as integer) k from events)""")
def fenced_json(spark: SparkSession, d: str) -> DataFrame:
    """JSON out of a fenced answer."""
    answer = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))
    return table(spark, d, "events").select("event_id", F.from_json(T.fenced_json(answer), "k int")["k"].alias("k"))


@query("""select time_bucket(interval '1 hour', ts) start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2""")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return Q.tumbling(table(spark, d, "events"))


@query("""with s as (select user_id, ts, case when ts - lag(ts) over w >= interval '30 minutes' or lag(ts) over w is null then 1 else 0 end st from events window w as (partition by user_id order by ts)),
n as (select user_id, ts, sum(st) over (partition by user_id order by ts rows unbounded preceding) sid from s) select user_id, min(ts) first, max(ts) last, count(*) n from n group by user_id, sid""")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    return Q.sessions(table(spark, d, "events"))


@query("""select event_type, count(*) n, max(ts) last from events group by 1""")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The events as a file stream, last row per key kept in a table, then counted."""
    from docengine.streaming.ingest import stream_latest

    return stream_latest(spark, f"{d}/events.parque[t]", table(spark, d, "events").schema, ["event_id"], "ts").groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


_CELLS = "c as (select p_partkey id, case when p_size % 3 = 0 then '' else p_name end cell, p_type header from part)"


@query(f"with {_CELLS} select id, replace(lower(header), ' ', '_') field_id, {_FIELD.format('header')} field_type from c where trim(cell) = ''")
def template_empty_cells(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a template: its empty cells, named by their header."""
    cells = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name")).alias("cell"), F.col("p_type").alias("header"))
    return cells.where(F.trim("cell") == "").select("id", T.slug(F.col("header")).alias("field_id"), T.field_type(F.col("header")).alias("field_type"))


@query("""select l_returnflag, l_linestatus, sum(l_quantity) sum_qty, round(avg(l_discount), 6) avg_disc, count(*) n from lineitem where l_shipdate <= timestamp '1998-09-02' group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def stats_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""select run_id, field_id, string_agg(cast(citation_id as varchar), ',' order by citation_id) first_three from (select distinct run_id, field_id, citation_id, dense_rank() over (partition by run_id, field_id order by citation_id) r from citations) where r <= 3 group by 1, 2""")
def citations_per_field(spark: SparkSession, d: str) -> DataFrame:
    """At most three citations of each field."""
    from docengine.operators.shapes import top_k

    rows = table(spark, d, "citations").select("run_id", "field_id", "citation_id").distinct()
    three = top_k(rows, ["run_id", "field_id"], 3, F.col("citation_id"))
    ids = F.transform(F.sort_array(F.collect_list("citation_id")), lambda x: x.cast("string"))
    return three.groupBy("run_id", "field_id").agg(F.array_join(ids, ",").alias("first_three"))
