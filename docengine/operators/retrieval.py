"""Vector search, hydration, reranking, neighbours and context packing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.operators.shapes import latest, skip_fill, top_k


def cosine(values: Column, query: Sequence[float]) -> Column:
    """Cosine of an array column with a fixed vector; null for a zero vector."""
    norm = sum(x * x for x in query) ** 0.5
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(F.transform(values, lambda x: x.cast("double")), q, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    length = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(length > 0, dot / (length * F.lit(norm)))


def metadata_filter(conditions: dict[str, object]) -> Column:
    """Conjunction over keys: a list is membership, a scalar equality."""
    out = F.lit(True)
    for name, value in conditions.items():
        out = out & (F.col(name).isin(*value) if isinstance(value, list | tuple | set) else F.col(name) == value)
    return out


def vector_top_k(vectors: DataFrame, values: str, key: str, query: Sequence[float], k: int, where: Column | None = None) -> DataFrame:
    """The k rows most similar to the query, ties by key, with ``score`` and ``rank``."""
    rows = vectors if where is None else vectors.where(where)
    best = rows.withColumn("score", F.round(cosine(F.col(values), query), 6)).where("score is not null").orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))  # over k rows


def current_chunks(chunks: DataFrame) -> DataFrame:
    """The last ingested row of each chunk."""
    return latest(chunks.where("chunk_id is not null"), ["chunk_id"], F.desc_nulls_last("ingested_at"), F.desc_nulls_last("line_end"))


def clean_id(name: str) -> Column:
    key = F.lower(F.trim(F.col(name)))
    return F.when(key != "", key)


def hydrate(candidates: DataFrame, chunks: DataFrame, text: str = "raw_md_fragment", limit: int = 1200) -> DataFrame:
    """Candidates with their chunk's text, cut to ``limit`` characters; candidates of
    unknown chunks drop out. Each keeps its own doc_id, so hits of several files mix."""
    found = current_chunks(chunks).select(clean_id("chunk_id").alias("key"), F.col("doc_id").alias("chunk_doc"), F.substring(text, 1, limit).alias("snippet"), "token_count", "parent_id", "page_span")
    return candidates.withColumn("key", clean_id("chunk_id")).join(found, "key")


def lookup(keys: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per key row in the keys' order (column ``ord``), null where nothing is stored."""
    found = current_chunks(chunks).select(clean_id("chunk_id").alias("key"), F.col("doc_id").alias("chunk_doc"), "section_label", "token_count")
    return keys.withColumn("key", clean_id("chunk_id")).join(found, "key", "left")


def lexical_relevance(query: Column, text: Column) -> Column:
    """Share of the query's distinct words (of two characters or more) in the text: 0 to 100."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) > 1))
    q = words(query)
    return F.when(F.size(q) > 0, F.floor(F.size(F.array_intersect(q, words(text))) * 100 / F.size(q))).otherwise(0).cast("int")


def answerability(score: Column) -> Column:
    return F.when(score >= 40, "yes").otherwise("no")


def relevance_band(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")


def siblings(chunks: DataFrame, reach: int = 1) -> DataFrame:
    """Neighbours of each chunk within its parent: ``chunk_id, neighbour_id, offset``."""
    w = Window.partitionBy("parent_id").orderBy("ord", "chunk_id")
    rows = chunks.where("parent_id is not null")
    near = F.array(*[F.struct(F.lit(k).alias("offset"), F.lead("chunk_id", k).over(w).alias("neighbour_id")) for k in range(-reach, reach + 1) if k])
    return rows.withColumn("_n", near).select("chunk_id", F.explode("_n").alias("n")).select("chunk_id", "n.neighbour_id", "n.offset").where("neighbour_id is not null")


def cross_page_neighbours(chunks: DataFrame, n: int = 2) -> DataFrame:
    """Up to n chunks of the page before and of the page after, those of the same element
    type first: ``chunk_id, neighbour_id, side, rank``."""
    a = chunks.select("doc_id", "chunk_id", "element_type", "first_page", "last_page")
    b = chunks.select("doc_id", F.col("chunk_id").alias("neighbour_id"), F.col("element_type").alias("other_type"), F.col("first_page").alias("other_first"), F.col("last_page").alias("other_last"), F.col("ord").alias("other_ord"))
    before = a.withColumn("page", F.col("first_page") - 1).join(b.withColumn("page", F.col("other_last")), ["doc_id", "page"]).withColumn("side", F.lit("before"))
    after = a.withColumn("page", F.col("last_page") + 1).join(b.withColumn("page", F.col("other_first")), ["doc_id", "page"]).withColumn("side", F.lit("after"))
    both = before.unionByName(after).where("chunk_id <> neighbour_id")
    same = (F.col("element_type") == F.col("other_type")).cast("int")
    return top_k(both, ["chunk_id", "side"], n, F.desc(same), "other_ord", "neighbour_id").select("chunk_id", "neighbour_id", "side", "rank")


def merged_neighbours(*parts: DataFrame) -> DataFrame:
    """Union of neighbour lists (``chunk_id, neighbour_id``), the earlier list's place first."""
    every = None
    for k, p in enumerate(parts):
        part = p.select("chunk_id", "neighbour_id").withColumn("place", F.lit(k))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("chunk_id", "neighbour_id").agg(F.min("place").alias("place"))


def context_packs(primaries: DataFrame, by: Sequence[str], budget: int = 12_000, forced: int = 3) -> DataFrame:
    """Which ranked items (``rank, chunk_id, size``) of each group enter the pack: adds
    ``kept``. The first ``forced`` always do; others are skipped where they don't fit."""
    items = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "size")))
    packed = primaries.groupBy(*by).agg(items.alias("items")).withColumn("keep", skip_fill(F.col("items"), budget, forced))
    both = packed.select(*by, F.explode(F.arrays_zip("items", "keep")).alias("x"))
    return both.select(*by, "x.items.rank", "x.items.chunk_id", "x.items.size", F.col("x.keep").alias("kept"))


def upsert(stored: DataFrame, new: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """Stored and new rows, the last version of each key; a new row wins a tie."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, key, F.desc_nulls_last(version), F.desc("_new")).drop("_new")


def lookup_one(chunks: DataFrame, doc_id: str, chunk_id: str) -> DataFrame:
    """The chunk of a file and id; no row where it is not stored. Over a store partitioned
    by file only that file is read."""
    return chunks.where((F.col("doc_id") == doc_id) & (F.col("chunk_id") == chunk_id))


def known_doc(doc: Column) -> Column:
    """A file id; null for an empty one and ``unknown``."""
    return F.when(~doc.isin("", "unknown"), doc)


def chunk_pool(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children and parents in one table with ``kind``; columns that only one has are null
    in the other's rows, and of two types of a column neither is kept."""
    a, b = dict(children.dtypes), dict(parents.dtypes)
    keep = lambda own, other: [c for c, t in own.items() if other.get(c, t) == t]
    return children.select(*keep(a, b)).withColumn("kind", F.lit("child")).unionByName(parents.select(*keep(b, a)).withColumn("kind", F.lit("parent")), allowMissingColumns=True)


def all_doc_ids(*tables: DataFrame) -> DataFrame:
    """Every known file id of the tables."""
    every = tables[0].select("doc_id")
    for t in tables[1:]:
        every = every.unionByName(t.select("doc_id"))
    return every.select(known_doc(F.col("doc_id")).alias("doc_id")).where("doc_id is not null").distinct()


def compare_id_sets(a: DataFrame, b: DataFrame, by: str, key: str) -> DataFrame:
    """The ids of both tables per group: ``by, ids, only_a, same`` (number in either, number
    in a alone, whether both hold the same). Only counts are shuffled on, no sets."""
    side = lambda df, name: df.select(F.col(by), clean_id(key).alias("_k"), F.lit(1).alias(name)).where("_k is not null").distinct()
    both = side(a, "_a").join(side(b, "_b"), [by, "_k"], "full")
    return both.groupBy(by).agg(F.count("*").alias("ids"), F.count(F.when(F.col("_b").isNull(), 1)).alias("only_a"), (F.count("_a") + F.count("_b") == 2 * F.count("*")).alias("same"))


def ingest_stats(children: DataFrame, parents: DataFrame) -> DataFrame:
    """One row: ``children, parents, avg_tokens`` (0 for no chunks)."""
    a = children.agg(F.count("*").alias("children"), F.coalesce(F.round(F.avg("token_count"), 4), F.lit(0.0)).alias("avg_tokens"))
    return a.join(parents.agg(F.count("*").alias("parents")), F.lit(True)).select("children", "parents", "avg_tokens")  # one row each


def to_dicts(chunks: DataFrame) -> DataFrame:
    """Chunks as JSON objects: ``chunk``."""
    return chunks.select(F.to_json(F.struct(*chunks.columns)).alias("chunk"))


def from_dicts(rows: DataFrame, schema) -> DataFrame:
    """JSON objects as chunks; what the schema does not know is dropped."""
    return rows.select(F.from_json("chunk", schema).alias("c")).select("c.*")


def facets(chunks: DataFrame) -> DataFrame:
    """How many chunks have each page, section and element type: ``facet, value, n``, in one scan."""
    entry = lambda name, c: F.struct(F.lit(name).alias("facet"), c.cast("string").alias("value"))
    one = F.array(entry("section", F.coalesce("section_label", F.lit("Unknown"))), entry("element_type", F.col("element_type")))
    pages = F.transform(F.coalesce("page_nos", F.array().cast("array<int>")), lambda p: entry("page", p))
    return chunks.select(F.explode(F.concat(one, pages)).alias("e")).groupBy("e.facet", "e.value").agg(F.count("*").alias("n"))
