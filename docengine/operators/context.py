"""Context assembly: from ranked hits to the ordered, budgeted pack of chunks around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.operators.retrieval import cross_page_neighbours, siblings
from docengine.operators.shapes import skip_fill, top_k


def primaries(hits: DataFrame, chunks: DataFrame, by: Sequence[str], score: str, n: int = 15) -> DataFrame:
    """The n best known chunks of each group, each once: ``*by, chunk_id, rank``. Hits of
    unknown chunks drop out before ranks are given; ties go to the smaller id."""
    known = hits.where(F.col("chunk_id").isNotNull()).join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")
    best = known.groupBy(*by, "chunk_id").agg(F.max(score).alias("_score"))
    return top_k(best, by, n, F.desc_nulls_last("_score"), F.col("chunk_id")).select(*by, "chunk_id", "rank")


def rerank_input(hits: DataFrame, by: Sequence[str], score: str, text: str, n: int = 50, characters: int = 1200) -> DataFrame:
    """What goes to a reranker: the n best hits of each group with their text cut. Adds ``place, snippet``."""
    return top_k(hits, by, n, F.desc_nulls_last(score), F.col("chunk_id"), name="place").withColumn("snippet", F.substring(text, 1, characters))


def reranked(answers: DataFrame, hits: DataFrame, by: Sequence[str], n: int = 15) -> DataFrame:
    """A reranker's answers ``*by, chunk_id, relevance_score, answerability`` joined to the
    hits, best first: answers that name no hit, and invalid ones (a score outside 0 to 100,
    an answerability other than yes and no) fall away; of equal ones the earlier hit comes first."""
    valid = answers.where(F.col("relevance_score").between(0, 100) & F.col("answerability").isin("yes", "no"))
    return top_k(hits.join(valid, [*by, "chunk_id"]), by, n, F.desc("relevance_score"), F.col("place"), F.col("chunk_id"))


def with_parents(chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """Chunks with their parent's text, null where there is no such parent."""
    return chunks.join(parents.select(F.col("chunk_id").alias("parent_id"), F.col("text").alias("parent_text"), F.col("tokens").alias("parent_tokens")), "parent_id", "left")


def assemble(hits: DataFrame, chunks: DataFrame, parents: DataFrame, by: Sequence[str], budget: int = 12_000, forced: int = 3, reach: int = 1, cross: int = 2) -> DataFrame:
    """The pack of each group: ``*by, place, kind, chunk_id, tokens, kept``, in order.

    hits: ``*by, rank, chunk_id``; chunks: ``chunk_id, doc_id, parent_id, ord, first_page,
    last_page, element_type, tokens``, one row each; parents: ``chunk_id, tokens``. Primaries
    come in rank order, each followed by its parent; then their siblings (``reach`` to either
    side, and neighbours of other pages with a primary's parent), then up to ``cross`` chunks
    of the pages before and after. A chunk stands once, at its first place. What would pass
    the budget is left out, never the first ``forced`` primaries. Unknown hits, parents and
    neighbours are no error; the rows not kept and their kinds are the trace.
    """
    by = list(by)
    known = hits.select(*by, "rank", "chunk_id").join(chunks.select("chunk_id", "parent_id", "tokens"), "chunk_id")
    place = lambda a, b, c, d: F.struct(F.lit(a).alias("class"), b.cast("int").alias("rank"), c.cast("int").alias("sub"), d.cast("int").alias("pos"))
    none = F.lit(0)
    rows = known.select(*by, "chunk_id", "tokens", place(0, F.col("rank"), none, none).alias("at"), F.lit("primary").alias("kind"))
    held = known.select(*by, "rank", "parent_id").join(parents.select(F.col("chunk_id").alias("parent_id"), "tokens"), "parent_id")
    rows = rows.unionByName(held.select(*by, F.col("parent_id").alias("chunk_id"), "tokens", place(0, F.col("rank"), F.lit(1), none).alias("at"), F.lit("parent").alias("kind")))

    # neighbours are sought for the hits only
    asked = known.select("chunk_id").distinct()
    families = chunks.join(chunks.join(asked, "chunk_id", "left_semi").select("parent_id").distinct(), "parent_id", "left_semi")
    near = siblings(families, reach).join(asked, "chunk_id", "left_semi")
    size = chunks.select(F.col("chunk_id").alias("neighbour_id"), "tokens", F.col("parent_id").alias("other_parent"))
    beside = known.select(*by, "rank", "chunk_id").join(near, "chunk_id").join(size, "neighbour_id")
    rows = rows.unionByName(beside.select(*by, F.col("neighbour_id").alias("chunk_id"), "tokens", place(1, F.col("rank"), none, F.col("offset")).alias("at"), F.lit("sibling").alias("kind")))
    over = known.select(*by, "rank", "chunk_id").join(cross_page_neighbours(chunks, cross).withColumnRenamed("rank", "nth"), "chunk_id").join(size, "neighbour_id")
    ours = known.where("parent_id is not null").select(*by, F.col("parent_id").alias("other_parent"), F.lit(True).alias("ours")).distinct()
    over = over.join(ours, [*by, "other_parent"], "left")
    at = F.struct(F.when(F.col("ours"), 1).otherwise(2).alias("class"), F.col("rank").cast("int").alias("rank"), F.when(F.col("side") == "before", 1).otherwise(2).alias("sub"), F.col("nth").cast("int").alias("pos"))
    rows = rows.unionByName(over.select(*by, F.col("neighbour_id").alias("chunk_id"), "tokens", at.alias("at"), F.when(F.col("ours"), "sibling").otherwise("cross_page").alias("kind")))

    once = rows.groupBy(*by, "chunk_id").agg(F.min(F.struct("at", "kind", F.col("tokens").alias("size"))).alias("x"))
    items = F.array_sort(F.collect_list(F.struct("x.at", "chunk_id", "x.kind", "x.size")))
    packs = once.groupBy(*by).agg(items.alias("items"))
    nth = F.transform("items", lambda x, i: F.size(F.filter(F.slice("items", F.lit(1), i + 1), lambda y: y["kind"] == "primary")))
    always = F.transform(F.arrays_zip("items", nth.alias("nth")), lambda z: (z["items"]["kind"] == "primary") & (z["nth"] <= forced))
    packs = packs.withColumn("keep", skip_fill(F.col("items"), budget, always=always))
    flat = packs.select(*by, F.posexplode(F.arrays_zip("items", "keep")).alias("place", "z"))
    return flat.select(*by, "place", F.col("z.items.kind").alias("kind"), F.col("z.items.chunk_id").alias("chunk_id"), F.col("z.items.size").alias("tokens"), F.col("z.keep").alias("kept"))


def context_trace(packs: DataFrame, by: Sequence[str]) -> DataFrame:
    """``*by, final_tokens, added, dropped``: what was added to the primaries (``kind:id``)
    and what did not fit, both in the pack's order."""
    listed = lambda cond, x: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("place", x.alias("x"))))), lambda y: y["x"])
    return packs.groupBy(*by).agg(
        F.sum(F.when(F.col("kept"), F.col("tokens")).otherwise(0)).alias("final_tokens"),
        listed(F.col("kind") != "primary", F.concat("kind", F.lit(":"), "chunk_id")).alias("added"),
        listed(~F.col("kept"), F.col("chunk_id")).alias("dropped"),
    )
