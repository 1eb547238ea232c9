"""The engine's entry points: chunk, index, query."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions import providers
from docengine.functions import tables as B
from docengine.functions import text as T
from docengine.operators import chunking as C
from docengine.operators import context as X
from docengine.operators import retrieval as R
from docengine.operators.repair import repair_text
from docengine.operators.shapes import greedy_pairs, header_path, runs, slice_starts, top_k
from docengine.session import checkpoint


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes of chunks. Tokens are estimated."""

    prose_target_tokens: int = 512
    sentence_window_size: int = 3
    list_items_per_chunk: int = 10
    list_item_overlap: int = 2
    table_rows_per_chunk: int = 20
    table_row_overlap: int = 2
    max_chunk_tokens_hard: int = 2048
    min_chunk_tokens: int = 100
    heading_confidence: float = 0.6
    parent_level: int = 2


def _sections(docs: DataFrame) -> DataFrame:
    """Lines of the texts with page, heading path and section number, markers left out."""
    rows = C.lines(docs.withColumn("text", T.normalize_page_markers(F.col("text"))), ["doc_id"], "text")
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = rows.withColumn("page", F.coalesce(F.last(T.marker_page(F.col("line")), ignorenulls=True).over(w), F.lit(1)))
    rows = rows.withColumn("level", T.heading_level(F.col("line"))).withColumn("title", F.when(F.col("level").isNotNull(), T.heading_text(F.col("line"))))
    rows = header_path(rows, ["doc_id"], ["line_no"], "level", "title").where(T.marker_page(F.col("line")).isNull())
    return C.structure_groups(rows, ["doc_id"], ["line_no"], F.col("level").isNotNull())


def _in_order(order: str, x: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(order, x))), lambda y: y[x])


def chunk(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One chunk for each section of documents ``doc_id, text``, and parents of the sections
    of one label. ``process_documents`` does more: repairs, elements, sizes."""
    rows = _sections(docs)
    sections = rows.groupBy("doc_id", "group").agg(
        F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"),
        F.max_by("header_path", "line_no").alias("header_path"), F.trim(F.array_join(_in_order("line_no", "line"), "\n")).alias("text"), C.homogeneous(F.when(F.col("line") != "", T.line_kind(F.col("line")))).alias("element_type"),
    ).where("text <> ''")
    label = T.section_label(F.lit(None).cast("string"), F.col("header_path"), F.col("text"), F.lit("paragraph"), F.col("first_page"))
    sections = sections.withColumn("section_label", label).withColumn("ord", F.col("line_start")).withColumn("tokens", T.tokens(F.col("text")))
    meta = T.base_meta(F.col("doc_id").cast("string"), F.col("element_type"), F.col("first_page"), F.col("last_page"), F.col("section_label"))
    children = sections.withColumn("chunk_id", T.content_id(F.col("text"), meta))
    return children, C.parent_rollup(C.soft_parents(children))


def elements(docs: DataFrame) -> DataFrame:
    """Elements of documents: runs of prose, and every table, list and image block whole.
    Blank lines part paragraphs, an indented line goes on the list before it."""
    rows = _sections(docs)
    w = Window.partitionBy("doc_id").orderBy("line_no")
    tags = lambda tag: F.size(F.split("line", tag, -1)) - 1
    opened = F.sum(tags(r"\[IMAGE\]") - tags(r"\[/IMAGE\]")).over(w)
    within = (opened > 0) | F.col("line").contains("[/IMAGE]") | F.col("line").contains("[IMAGE]")
    kind = T.line_kind(F.col("line"))
    rows = rows.withColumn("_image", within).withColumn("_kind", F.when(F.col("_image"), "image").otherwise(kind)).withColumn("_gap", F.coalesce(F.lag(kind).over(w) == "blank", F.lit(False)))
    rows = rows.where((F.col("_kind") != "blank") | F.col("_image"))
    indented = F.col("line").rlike(r"^\s") & (F.col("_kind") == "text")
    rows = rows.withColumn("_plain", F.last(F.when(~indented, F.col("_kind")), ignorenulls=True).over(w))
    kinds = F.when(indented & (F.col("_plain") == "list"), "list").when(F.col("_kind").isin("table", "list", "image"), F.col("_kind")).otherwise("prose")
    rows = rows.withColumn("kind", kinds)
    fresh = F.lag("kind").over(w).isNull() | (F.lag("kind").over(w) != F.col("kind")) | (F.lag("group").over(w) != F.col("group")) | (F.col("_gap") & (F.col("kind") != "prose") & ~F.col("_image"))
    rows = runs(rows, ["doc_id"], ["line_no"], fresh, "element")
    rows = rows.withColumn("_t", F.concat(F.when(F.col("_gap") & (F.col("kind") == "prose"), F.lit("\n\n")).otherwise(F.lit("\n")), F.col("line")))
    heading = F.max(F.col("_kind") == "heading") & (F.count("*") == F.count(F.when(F.col("_kind") == "heading", 1)))
    return rows.groupBy("doc_id", "element").agg(
        F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), F.max_by("header_path", "line_no").alias("header_path"),
        F.min_by("title", F.when(F.col("title").isNotNull(), F.col("line_no"))).alias("title"),
        F.when(F.max("kind") != "prose", F.max("kind")).when(heading, "heading").otherwise("paragraph").alias("element_type"), F.btrim(F.array_join(_in_order("line_no", "_t"), ""), F.lit("\n")).alias("text"),
    )


def _windows(target: int, look_back: int) -> object:
    @F.pandas_udf("array<string>")
    def run(sentences: pd.Series) -> pd.Series:
        out = []
        for parts in sentences:
            pieces, own, used, first = [], [], 0, 0
            for i, s in enumerate(parts):
                size = -(-len(s) // T.CHARS_PER_TOKEN)
                if own and used + size > target:
                    pieces.append(" ".join(own))
                    first = i
                    own, used = [*parts[max(0, first - look_back) : first]], 0
                own.append(s)
                used += size
            out.append([*pieces, " ".join(own)] if own else pieces)
        return pd.Series(out, dtype=object)

    return run


def pieces(rows: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Elements in pieces of bounded size: long prose in windows of sentences, each beginning
    with the last ones before it; long tables in slices of rows below their head; long lists
    in slices of items; very long images a paragraph at a time. Adds ``piece``."""
    c = config
    cells = B.markdown_cells(F.col("text"))
    n = F.size(cells) - 1
    table = F.transform(slice_starts(n, c.table_rows_per_chunk, c.table_row_overlap), lambda s: B.sliced_table(cells, s, F.least(s + c.table_rows_per_chunk, n)))
    # an item with the indented lines that go on it
    items = F.split(F.col("text"), r"\n(?=\S)", -1)
    lists = F.transform(slice_starts(F.size(items), c.list_items_per_chunk, c.list_item_overlap), lambda s: F.array_join(F.slice(items, s + 1, c.list_items_per_chunk), "\n"))
    inner = F.btrim(F.regexp_replace("text", r"\[/?IMAGE\]", ""), F.lit("\n "))
    image = F.transform(F.split(inner, "\n\n", -1), lambda p: F.concat(F.lit("[IMAGE]\n"), p, F.lit("\n[/IMAGE]")))
    kind, tokens = F.col("element_type"), T.tokens(F.col("text"))
    prose = _windows(c.prose_target_tokens, c.sentence_window_size)(T.sentences(F.when((kind == "paragraph") & (tokens > c.prose_target_tokens), F.col("text")).otherwise(F.lit(""))))
    whole = F.array("text")
    cut = (
        F.when((kind == "table") & (n > c.table_rows_per_chunk), table)
        .when((kind == "list") & (F.size(items) > c.list_items_per_chunk), lists)
        .when((kind == "image") & (tokens >= 2 * c.max_chunk_tokens_hard), image)
        .when((kind == "paragraph") & (tokens > c.prose_target_tokens), prose)
        .otherwise(whole)
    )
    return rows.withColumn("_cut", cut).select(*[x for x in rows.columns if x != "text"], F.posexplode("_cut").alias("piece", "text")).where("text <> ''")


def process_documents(docs: DataFrame, config: ChunkConfig = ChunkConfig()) -> tuple[DataFrame, DataFrame]:
    """Children and parents of documents ``doc_id, text``: page markers, repairs, elements,
    pieces, tiny ones merged with their next, labels, texts for embedding, ids; parents by
    headings where the structure can be trusted, else by runs of one label.

    Null texts give nothing; of repeated documents one stands; other columns are ignored.
    Children: ``doc_id, chunk_id, ord, first_page, last_page, line_start, line_end,
    header_path, section_label, element_type, text, text_for_embedding, tokens,
    structure_confidence, parent_id``; parents: ``doc_id, parent_id, parent_type, child_ids,
    first_page, last_page, page_nos, line_start, line_end, header_path, section_label, text, tokens``.
    """
    once = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).groupBy("doc_id").agg(F.min("text").alias("text"))
    fixed = repair_text(once, ["doc_id"], "text").select("doc_id", F.col("repaired").alias("text"), "structure_confidence")
    cut = pieces(elements(fixed.select("doc_id", "text")), config)
    order = Window.partitionBy("doc_id").orderBy("element", "piece")
    cut = cut.withColumn("ord", F.row_number().over(order)).withColumn("tokens", T.tokens(F.col("text"))).withColumn("chunk_id", F.col("ord").cast("string"))
    w = Window.partitionBy("doc_id").orderBy("ord")
    merged = greedy_pairs(cut, ["doc_id"], ["ord"], C.can_merge(w, config.min_chunk_tokens, config.max_chunk_tokens_hard)).groupBy("doc_id", "merge_group").agg(
        F.min("ord").alias("ord"), F.min("first_page").alias("first_page"), F.max("last_page").alias("last_page"), F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"),
        F.min_by("header_path", "ord").alias("header_path"), F.min_by("title", "ord").alias("title"), C.homogeneous(F.col("element_type")).alias("element_type"), F.array_join(_in_order("ord", "text"), "\n\n").alias("text"),
    )
    lines = F.split("text", "\n", -1)
    items = F.transform(F.filter(lines, lambda x: F.trim(x).rlike(r"^([-*+]|[0-9]+[.)]) ")), lambda x: F.regexp_replace(F.trim(x), r"^([-*+]|[0-9]+[.)]) +", ""))
    rows = F.transform(B.markdown_cells(F.col("text")), lambda r: F.array_join(r, " | "))
    label = T.kind_label(F.col("element_type"), F.col("title"), F.col("header_path"), F.col("text"), items, F.get(rows, F.lit(0)), F.col("first_page"))
    told = merged.withColumn("section_label", label).withColumn("tokens", T.tokens(F.col("text")))
    prefix = T.embedding_prefix(F.col("doc_id").cast("string"), F.col("first_page"), F.col("last_page"), F.col("header_path"), F.col("section_label"))
    body = F.slice(rows, F.lit(2), F.greatest(F.lit(0), F.size(rows) - 1))
    bare = F.btrim(F.regexp_replace("text", r"\[/?IMAGE\]", ""), F.lit("\n "))
    text = T.serialized(F.col("element_type"), prefix, F.when(F.col("element_type") == "image", bare).otherwise(F.col("text")), items, F.get(rows, F.lit(0)), body, B.table_signature(B.markdown_cells(F.col("text"))), F.array(F.lit(0), F.greatest(F.lit(0), F.size(rows) - 1)))
    meta = T.base_meta(F.col("doc_id").cast("string"), F.col("element_type"), F.col("first_page"), F.col("last_page"), F.col("section_label"))
    children = told.withColumn("text_for_embedding", text).withColumn("chunk_id", T.content_id(F.concat("text", F.lit("#"), F.col("ord").cast("string")), meta)).join(fixed.select("doc_id", "structure_confidence"), "doc_id")
    children = checkpoint(children)  # parents and children share it

    by_heading = C.heading_parents(children, config.parent_level).withColumnRenamed("parent_run", "_heading_run")
    both = C.soft_parents(by_heading)
    trusted = F.avg("structure_confidence").over(Window.partitionBy("doc_id")) >= config.heading_confidence
    both = both.withColumn("parent_type", F.when(trusted, "heading_based").otherwise("soft_section")).withColumn("_run", F.when(trusted, F.col("_heading_run")).otherwise(F.col("parent_run")))
    parents = both.groupBy("doc_id", "parent_type", "_run").agg(
        _in_order("ord", "chunk_id").alias("child_ids"), F.min("first_page").alias("first_page"), F.max("last_page").alias("last_page"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("first_page", "last_page"))))).alias("page_nos"),
        F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), F.min_by("header_path", "ord").alias("header_path"), F.min_by("section_label", "ord").alias("section_label"), F.array_join(_in_order("ord", "text"), "\n\n").alias("text"),
    )
    parent_id = T.content_id(F.array_join("child_ids", ","), F.concat(F.col("doc_id").cast("string"), F.lit("/"), "parent_type"))
    parents = parents.withColumn("parent_id", parent_id).withColumn("tokens", T.tokens(F.col("text")))
    of = parents.select("doc_id", "parent_id", F.explode("child_ids").alias("chunk_id"))
    names = ["doc_id", "chunk_id", "ord", "first_page", "last_page", "line_start", "line_end", "header_path", "section_label", "element_type", "text", "text_for_embedding", "tokens", "structure_confidence", "parent_id"]
    return children.join(of, ["doc_id", "chunk_id"]).select(*names), parents.drop("_run")


def index(chunks: DataFrame, width: int = 64) -> DataFrame:
    """Vector records of chunks."""
    rows = chunks.where("coalesce(chunk_id, '') <> ''")
    prefix = T.embedding_prefix(F.col("doc_id").cast("string"), F.col("first_page"), F.col("last_page"), F.col("header_path"), F.col("section_label"))
    return providers.embed(rows.withColumn("embed_text", F.concat(prefix, F.lit("\n\n"), "text")), "embed_text", width).select(F.col("chunk_id").alias("id"), "values", "doc_id", F.lit("children").alias("namespace"))


def query(vectors: DataFrame, chunks: DataFrame, question: str, k: int = 300, keep: int = 15, budget: int = 12_000, width: int = 64) -> DataFrame:
    """The packed chunks for a question: vector search, lexical reranking, budget."""
    asked = [float(x) for x in providers.hashed_embedding(question, width)]
    hits = R.vector_top_k(vectors, "values", "id", asked, k).select(F.col("id").alias("chunk_id"), "score")
    texts = hits.join(chunks.select("chunk_id", "doc_id", "text", "tokens", "section_label").dropDuplicates(["chunk_id"]), "chunk_id")
    ranked = texts.withColumn("relevance", R.lexical_relevance(F.lit(question), F.col("text"))).withColumn("question", F.lit(question))
    best = top_k(ranked, ["question"], keep, F.desc("relevance"), F.desc("score"), F.col("chunk_id"))
    packed = R.context_packs(best.withColumn("size", F.col("tokens")), ["question"], budget)
    return packed.join(best.select("chunk_id", "doc_id", "text", "relevance"), "chunk_id")


def answer_context(vectors: DataFrame, children: DataFrame, parents: DataFrame, questions: DataFrame, k: int = 50, keep: int = 15, budget: int = 12_000, width: int = 64) -> DataFrame:
    """The assembled context of each of a stated set of questions ``question_id, question``:
    ``question_id, place, kind, chunk_id, tokens, kept, text``, children and parents being
    those of ``process_documents``. The questions are compared with every vector; of these
    the k best are reranked and the best ``keep`` assembled with what is around them."""
    asked = [(r["question_id"], r["question"], [float(x) for x in providers.hashed_embedding(r["question"], width)]) for r in questions.select("question_id", "question").collect()]
    hits = None
    for question_id, question, vector in asked:  # a stated set; each is one pass that keeps k rows
        best = R.vector_top_k(vectors, "values", "id", vector, k).select(F.lit(question_id).alias("question_id"), F.lit(question).alias("question"), F.col("id").alias("chunk_id"), "score")
        hits = best if hits is None else hits.unionByName(best)
    if hits is None:
        return questions.sparkSession.createDataFrame([], "question_id string, place int, kind string, chunk_id string, tokens int, kept boolean, text string")
    ranked = hits.join(children.select("chunk_id", "text"), "chunk_id").withColumn("relevance", R.lexical_relevance(F.col("question"), F.col("text")))
    primary = top_k(ranked, ["question_id"], keep, F.desc("relevance"), F.desc("score"), F.col("chunk_id")).select("question_id", "rank", "chunk_id")
    packs = X.assemble(primary, children, parents.select(F.col("parent_id").alias("chunk_id"), "tokens"), ["question_id"], budget)
    texts = children.select("chunk_id", "text").unionByName(parents.select(F.col("parent_id").alias("chunk_id"), "text"))
    return packs.join(texts, "chunk_id").select("question_id", "place", "kind", "chunk_id", "tokens", "kept", "text")
