"""Queries on geometry, reading order and tables. Boxes come from the parts: one page for
each size, positions and extents from key and price."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine.functions import geometry as G
from docengine.functions import text as T
from docengine.operators import layout as L
from docengine.operators import retrieval as R
from docengine.operators.chunking import lines
from docengine.plans.chunking import _LINES
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


def boxes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    x, y = (F.col("p_partkey") * 37 % 100) / 128.0, (F.col("p_partkey") * 53 % 100) / 128.0
    w, h = (F.col("p_partkey") % 7 + 1) / 32.0, (F.col("p_partkey") % 5 + 1) / 32.0
    return p.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("page"), x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"), F.col("p_retailprice").alias("score"))


_B = """b as (select p_partkey id, p_size page, (p_partkey * 37 % 100) / 128.0::double x0, (p_partkey * 53 % 100) / 128.0::double y0,
 (p_partkey * 37 % 100) / 128.0::double + (p_partkey % 7 + 1) / 32.0::double x1, (p_partkey * 53 % 100) / 128.0::double + (p_partkey % 5 + 1) / 32.0::double y1, p_retailprice score from part)"""
_PAIR = "greatest(0.0::double, least(a.x1, b2.x1) - greatest(a.x0, b2.x0)) * greatest(0.0::double, least(a.y1, b2.y1) - greatest(a.y0, b2.y0))"
_PAIRS = f"{_B}, pr as (select a.page, a.id a_id, b2.id b_id, {_PAIR} inter, (a.x1 - a.x0) * (a.y1 - a.y0) aa, (b2.x1 - b2.x0) * (b2.y1 - b2.y0) ab, a.x0 ax0, a.y0 ay0, a.x1 ax1, a.y1 ay1, b2.x0 bx0, b2.y0 by0, b2.x1 bx1, b2.y1 by1 from b a join b b2 on a.page = b2.page and a.id < b2.id)"


@query(f"with {_PAIRS} select page, a_id, b_id, round(inter / (aa + ab - inter), 6) iou from pr where inter / least(aa, ab) > 0.3")
def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    pairs = L.spatial_pairs(b, b, ["page"], 0.3).where("a.id < b.id")
    return pairs.select(F.col("a.page").alias("page"), F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), F.round(G.iou(G.box("a."), G.box("b.")), 6).alias("iou"))


@query(f"with {_PAIRS} select a_id, count(*) spans, string_agg(cast(b_id as varchar), ' ' order by inter / least(aa, ab) desc, by0, bx0, b_id) texts from pr where inter / least(aa, ab) > 0.3 group by 1")
def spatial_join_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Spans of a block by overlap, then place, as one text."""
    b = boxes(spark, d)
    pairs = L.spatial_pairs(b, b, ["page"], 0.3).where("a.id < b.id")
    place = F.struct((-G.overlap_ratio(G.box("a."), G.box("b."))).alias("o"), F.col("b.y0"), F.col("b.x0"), F.col("b.id").alias("id"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["id"].cast("string")), " ")
    return pairs.groupBy(F.col("a.id").alias("a_id")).agg(F.count("*").alias("spans"), texts.alias("texts"))


@query(f"with {_PAIRS} select a_id, b_id from pr where inter > 0 and ax0 <= bx0 and ay0 <= by0 and ax1 >= bx1 and ay1 >= by1")
def containment(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    return L.spatial_pairs(b, b, ["page"], 0.99).where((F.col("a.id") < F.col("b.id")) & G.contains(G.box("a."), G.box("b."))).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


@query(f"""with {_B} select id, round(sqrt(pow(greatest(0.0::double, x0 - nx1, nx0 - x1), 2) + pow(greatest(0.0::double, y0 - ny1, ny0 - y1), 2)), 6) gap, x0 <= nx1 and nx0 <= x1 and y0 <= ny1 and ny0 <= y1 touch
from (select *, lead(x0) over w nx0, lead(y0) over w ny0, lead(x1) over w nx1, lead(y1) over w ny1 from b window w as (partition by page order by id)) where nx0 is not null""")
def box_distance(spark: SparkSession, d: str) -> DataFrame:
    """Gap between each box and the next of its page."""
    w = Window.partitionBy("page").orderBy("id")
    rows = boxes(spark, d).withColumns({f"n{c}": F.lead(c).over(w) for c in ("x0", "y0", "x1", "y1")}).where("nx0 is not null")
    return rows.select("id", F.round(G.distance(G.box(), G.box("n")), 6).alias("gap"), G.overlaps(G.box(), G.box("n")).alias("touch"))


@query(f"with {_B} select id, cast(x0 * 1000 as double) nx, cast(floor(x1 * 612) as integer) px, cast(floor(y1 * 792) as integer) py from b")
def box_pixels(spark: SparkSession, d: str) -> DataFrame:
    shown = G.pixels(G.box(), F.lit(612), F.lit(792))
    back = G.normalized(G.Box(F.col("x0") * 1000, F.col("y0"), F.col("x1"), F.col("y1")), F.lit(1.0), F.lit(1.0))
    return boxes(spark, d).select("id", back.x0.alias("nx"), shown.x1.alias("px"), shown.y1.alias("py"))


_IOU = "(greatest(0.0::double, least(k.x1, o.x1) - greatest(k.x0, o.x0)) * greatest(0.0::double, least(k.y1, o.y1) - greatest(k.y0, o.y0)))"


@query(f"""with recursive {_B}, o as (select *, row_number() over (partition by page order by score desc, id) rn from b where x0 < x1 and y0 < y1),
w as (select page, rn, [{{'id': id, 'score': score, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] kept from o where rn = 1
 union all select o.page, o.rn, case when list_bool_or(list_transform(w.kept, lambda k: {_IOU} / ((k.x1 - k.x0) * (k.y1 - k.y0) + (o.x1 - o.x0) * (o.y1 - o.y0) - {_IOU}) > 0.3)) then w.kept
 else list_append(w.kept, {{'id': o.id, 'score': o.score, 'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1}}) end from w join o on o.page = w.page and o.rn = w.rn + 1)
select page, k.id, k.score from (select page, unnest(kept) k from w qualify row_number() over (partition by page order by rn desc) = 1)""")
def nms(spark: SparkSession, d: str) -> DataFrame:
    return L.suppress(L.cleaned_boxes(boxes(spark, d)), ["page"], "id", 0.3).select("page", "id", "score")


@query(f"""with {_B}, s1 as (select *, max(y1) over (partition by page order by y0, y1, id rows between unbounded preceding and 1 preceding) m from b),
s2 as (select *, sum(case when m is null or m < y0 then 1 else 0 end) over (partition by page order by y0, y1, id rows unbounded preceding) band from s1),
s3 as (select *, max(x1) over (partition by page, band order by x0, x1, id rows between unbounded preceding and 1 preceding) mx from s2),
s4 as (select *, sum(case when mx is null or mx < x0 then 1 else 0 end) over (partition by page, band order by x0, x1, id rows unbounded preceding) col from s3)
select page, id, cast(band as bigint) band, cast(col as bigint) "column", cast(row_number() over (partition by page order by band, col, y0, x0, id) as integer) place from s4""")
def reading_order_bands(spark: SparkSession, d: str) -> DataFrame:
    return L.reading_order(boxes(spark, d), ["page"], "id").select("page", "id", "band", "column", "place")


@query(f"""with recursive {_B}, t as (select page, id, x0, (y0 + y1) / 2 y, row_number() over (partition by page order by (y0 + y1) / 2, x0, id) rn from b),
g as (select page, 0.5 * median(gap) least_gap from (select page, y - lag(y) over (partition by page order by rn) gap from t) where gap is not null group by 1),
w as (select page, id, x0, rn, y, y anchor, 0 as row_no from t where rn = 1
 union all select t.page, t.id, t.x0, t.rn, t.y, case when t.y - w.anchor >= g.least_gap then t.y else w.anchor end, w.row_no + case when t.y - w.anchor >= g.least_gap then 1 else 0 end
 from w join t on t.page = w.page and t.rn = w.rn + 1 join g on g.page = t.page)
select page, id, row_no as "row", cast(row_number() over (partition by page, row_no order by x0, id) - 1 as integer) as "column" from w""")
def table_grid(spark: SparkSession, d: str) -> DataFrame:
    return L.grid_rows(boxes(spark, d), ["page"], "id")


# the even boxes are native text, the odd ones what a detector saw; on a raster of 1000 pixels
_COVER = f"""{_B}, px as (select page, id % 2 side, cast(floor(x0 * 1000) as integer) x0, cast(floor(y0 * 1000) as integer) y0, cast(floor(x1 * 1000) as integer) x1, cast(floor(y1 * 1000) as integer) y1 from b),
xs as (select page, v, lead(v) over (partition by page order by v) w from (select distinct page, v from (select page, x0 v from px union all select page, x1 from px))),
ys as (select page, v, lead(v) over (partition by page order by v) w from (select distinct page, v from (select page, y0 v from px union all select page, y1 from px))),
ce as (select xs.page, xs.v x, ys.v y, (xs.w - xs.v) * (ys.w - ys.v) area, bool_or(px.side = 0) n, bool_or(px.side = 1) s from xs join ys on xs.page = ys.page join px on px.page = xs.page and px.x0 <= xs.v and px.x1 >= xs.w and px.y0 <= ys.v and px.y1 >= ys.w where xs.w is not null and ys.w is not null group by all),
st as (select page, cast(coalesce(sum(area) filter (n and s), 0) as bigint) common, cast(sum(area) as bigint) covered from ce group by 1),
sy as (select st.*, case when common / covered < 0.6 and page in (select page from px where side = 1) then 'HI_RES' else 'FAST' end strategy from st)"""


@query(f"with {_COVER} select page, common, covered, strategy from sy")
def page_strategy(spark: SparkSession, d: str) -> DataFrame:
    """Pages on which native and seen text do not cover the same places."""
    b = boxes(spark, d)
    return L.page_strategies(b.where("id % 2 = 0"), b.where("id % 2 = 1"), ["page"])


@query(f"with {_COVER}, pg as (select page % 7 doc, strategy from sy) select doc, case when avg(case when strategy = 'HI_RES' then 1.0 else 0.0 end) > 0.2 then 'HI_RES' else 'FAST' end strategy from pg group by 1")
def doc_strategy(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    rows = L.page_strategies(b.where("id % 2 = 0"), b.where("id % 2 = 1"), ["page"]).withColumn("doc", F.col("page") % 7)
    return rows.groupBy("doc").agg(L.document_strategy(F.col("strategy")).alias("strategy"))


@query("""select l_orderkey, '| line | quantity | flag |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || l_linenumber || ' | ' || cast(l_quantity as integer) || ' | ' || l_returnflag || ' |', chr(10) order by l_linenumber, cast(l_quantity as integer), l_returnflag, l_partkey) as "table" from lineitem group by 1""")
def md_table_render(spark: SparkSession, d: str) -> DataFrame:
    cells = F.array(F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.col("l_returnflag"))
    place = F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q"), "l_returnflag", "l_partkey", cells.alias("cells"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["cells"]).alias("rows"))
    header = F.array(F.lit("line"), F.lit("quantity"), F.lit("flag"))
    return rows.select("l_orderkey", L.markdown_table(header, F.col("rows")).alias("table"))


@query(r"""select doc_id, trim(regexp_replace(replace(text, '|', ' '), '[ \t\r\n]+', ' ', 'g'), ' ') cell from documents where text is not null""")
def sanitize_cell(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.sanitize_cell(F.col("text")).alias("cell"))


_TABLE_LINES = "list_filter(string_split(raw_md_fragment, chr(10)), lambda l: starts_with(trim(l), '|'))"


@query(rf"""with {CURRENT}, t as (select chunk_id, list_transform({_TABLE_LINES}, lambda l: list_transform(string_split(regexp_replace(trim(l), '^\||\|$', '', 'g'), '|'), lambda c: trim(c))) r from cur where raw_md_fragment is not null),
b as (select chunk_id, list_filter(r, lambda x: not list_bool_and(list_transform(x, lambda c: regexp_matches(c, '^:?-{{2,}}:?$')))) r from t where len(r) > 0),
p as (select chunk_id, list_max(list_transform(r, lambda x: len(x))) w, r from b where len(r) > 0),
q as (select chunk_id, w, list_transform(r, lambda x: '| ' || array_to_string(list_resize(x, w, ''), ' | ') || ' |') l from p)
select chunk_id, md5(array_to_string(list_concat([l[1], '| ' || array_to_string(list_transform(range(0, w), lambda i: '---'), ' | ') || ' |'], l[2:]), chr(10))) table_md5 from q""")
def clean_md_table(spark: SparkSession, d: str) -> DataFrame:
    rows = L.clean_tables(lines(R.current_chunks(table(spark, d, "chunks")), ["chunk_id"], "raw_md_fragment"), ["chunk_id"])
    return rows.select("chunk_id", F.md5(F.col("table").cast("binary")).alias("table_md5"))


@query(rf"""with {CURRENT}, t as (select doc_id, coalesce(line_start, line_end, 0) ord, chunk_id, metadata.table_header h, metadata.table_rows n from cur where metadata.table_header is not null),
cm as (select *, row_number() over w rn, coalesce(h = lead(h) over w, false) ok from t window w as (partition by doc_id order by ord, chunk_id)),
k as (select doc_id, count(*) tables, sum(coalesce(n, 0)) n_rows, cast(count(*) filter (ok) as bigint) like_next from cm group by 1)
select doc_id, tables, cast(n_rows as bigint) n_rows, like_next from k""")
def table_header_match(spark: SparkSession, d: str) -> DataFrame:
    rows = R.current_chunks(table(spark, d, "chunks")).where("metadata.table_header is not null")
    rows = rows.select("doc_id", "chunk_id", F.coalesce("line_start", "line_end", F.lit(0)).alias("ord"), F.split("metadata.table_header", " \\| ").alias("header"), F.coalesce("metadata.table_rows", F.lit(0)).alias("n"))
    w = Window.partitionBy("doc_id").orderBy("ord", "chunk_id")
    like = L.mergeable_tables(F.col("header"), F.lead("header").over(w), F.lit(None).cast("string"))
    return rows.withColumn("like", like).groupBy("doc_id").agg(F.count("*").alias("tables"), F.sum("n").alias("n_rows"), F.count(F.when(F.col("like"), 1)).alias("like_next"))


@query(f"""with recursive {CURRENT}, t as (select doc_id, metadata.table_header h, coalesce(metadata.table_rows, 0) n, row_number() over (partition by doc_id order by coalesce(line_start, line_end, 0), chunk_id) rn from cur where metadata.table_header is not null),
cm as (select *, coalesce(h = lead(h) over (partition by doc_id order by rn), false) ok from t),
gr as (select doc_id, h, n, rn, ok, 1 grp, false swallowed from cm where rn = 1
  union all select c.doc_id, c.h, c.n, c.rn, c.ok, g.grp + case when g.ok and not g.swallowed then 0 else 1 end, g.ok and not g.swallowed from gr g join cm c on c.doc_id = g.doc_id and c.rn = g.rn + 1)
select doc_id, cast(grp as bigint) merge_group, arg_min(h, rn) header, cast(sum(n) as bigint) n_rows, count(*) parts from gr group by 1, 2""")
def table_merge(spark: SparkSession, d: str) -> DataFrame:
    """Successive tables of a file with one header, merged in pairs."""
    rows = R.current_chunks(table(spark, d, "chunks")).where("metadata.table_header is not null")
    w = Window.partitionBy("doc_id").orderBy(F.coalesce("line_start", "line_end", F.lit(0)), "chunk_id")
    rows = rows.select("doc_id", F.row_number().over(w).alias("ord"), F.split("metadata.table_header", " \\| ").alias("header"), F.lit(None).cast("string").alias("title"), F.coalesce("metadata.table_rows", F.lit(0)).alias("n_rows"))
    return L.merge_tables(rows, ["doc_id"], "ord").withColumn("header", F.array_join("header", " | "))
