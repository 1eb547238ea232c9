"""Evaluation passages inside corpus documents.

A document is contaminated by an item if it holds MIN_RUN successive words of the item.
Method: prefix-filtered set join. Each window of MIN_RUN words of an item is the set of
its MIN_RUN - SHINGLE + 1 word shingles. A document that holds the window holds all of
them, so the necessary prefix of the window, ordered by rarity in the corpus, is its one
rarest shingle. One pass over all documents counts how many documents hold each shingle
of the items; a second pass joins the documents' shingles with the prefixes, applies the
length and positional bounds (the window must lie within the document) and verifies the
window word by word.

Scale: two passes over the documents, however many items there are. The tasks know the
items only as a bitmap of BITS places, of 2 MB; a shingle whose place is set is sent on, so
that of items with far more shingles than BITS more is sent than needed, and nothing is
lost. Counts are summed within a task first. Prefixes and documents meet in a join by
shingle, with no more of the document than the words around the place; items are joined to
what is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions import bitmaps
from docengine.llm.words import WordIds, mix, seeds
from docengine.session import checkpoint

MIN_RUN = 20
SHINGLE = 5
SPAN = MIN_RUN - SHINGLE  # how far the last shingle of a window lies behind the first
BITS = 1 << 24
BATCH_WORDS = 1 << 19
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of the lower-cased text."""
    return _WORD.findall(text.lower()) if text else []


def _shingles(ids: np.ndarray) -> np.ndarray:
    """Hash of the SHINGLE words from each position on, the last ones left out."""
    n = len(ids) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for i, m in enumerate(seeds("run", SHINGLE)):
        h = mix(h + mix(ids[i : i + n] ^ m))
    return h


def _item_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ids = WordIds()
    for pdf in batches:
        out = []
        for item, text in zip(pdf["item_id"], pdf["text"], strict=True):
            found = words(text)
            if len(found) >= MIN_RUN:
                out.append((item, found, _shingles(np.array([ids[w] for w in found], dtype=np.uint64)).view(np.int64)))
        yield pd.DataFrame(out, columns=["item_id", "words", "shingles"])


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """The places of ``h`` as packed bits; it comes to the driver in at most BITS / 65,536 containers."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"high": pdf["high"].head(1), "bits": [bitmaps.encode(np.unique(pdf["low"].to_numpy()))]})

    place = F.col("h").bitwiseAND(F.lit(BITS - 1))
    rows = hashes.select(F.shiftright(place, 16).cast("int").alias("high"), place.bitwiseAND(F.lit(bitmaps.SPAN - 1)).cast("int").alias("low")).distinct()
    bits = np.zeros(BITS, dtype=bool)
    for high, part in rows.groupBy("high").applyInPandas(run, "high int, bits binary").toLocalIterator():
        bits[high * bitmaps.SPAN + bitmaps.decode(bytes(part))] = True
    return np.packbits(bits)


def _held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = (h & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return np.flatnonzero(bits[place >> 3] >> (7 - (place & 7)) & 1)


def _batches(rows: Iterator[pd.DataFrame]):
    """(doc ids, words, hash of each word, start of each document's words)."""
    ids = WordIds()
    get = ids.__getitem__
    docs, flat, starts = [], [], []
    for pdf in rows:
        for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            found = words(text)
            if len(found) < MIN_RUN:
                continue
            docs.append(doc)
            starts.append(len(flat))
            flat += found
            if len(flat) >= BATCH_WORDS:
                yield docs, flat, np.fromiter(map(get, flat), np.uint64, len(flat)), np.array(starts)
                docs, flat, starts = [], [], []
    if docs:
        yield docs, flat, np.fromiter(map(get, flat), np.uint64, len(flat)), np.array(starts)


def _hits(bits: np.ndarray, rows: Iterator[pd.DataFrame]):
    """For each batch: document ids, words, starts, ends; of each held shingle its place, hash and document."""
    for docs, flat, ids, starts in _batches(rows):
        ends = np.append(starts[1:], len(flat))
        h = _shingles(ids)
        at = _held(bits, h)
        doc = np.searchsorted(starts, at, side="right") - 1
        inside = at + SHINGLE <= ends[doc]
        yield docs, flat, starts, ends, at[inside], h[at[inside]], doc[inside]


def _counts(bits: np.ndarray):
    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _docs, _flat, _starts, _ends, _at, h, doc in _hits(bits, rows):
            once = np.unique(np.stack([h, doc.astype(np.uint64)], axis=1), axis=0)[:, 0]
            shingle, n = np.unique(once, return_counts=True)
            yield pd.DataFrame({"h": shingle.view(np.int64), "n": n})

    return run


def _places(bits: np.ndarray):
    """Where a document holds a prefix: the words from SPAN before it to MIN_RUN behind its
    beginning, as far as the document goes; ``lead`` of them stand before it."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for docs, flat, starts, ends, at, h, doc in _hits(bits, rows):
            lo, hi = np.maximum(starts[doc], at - SPAN), np.minimum(ends[doc], at + MIN_RUN)
            around = [flat[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            yield pd.DataFrame({"h": h.view(np.int64), "doc_id": pd.Series([docs[i] for i in doc.tolist()], dtype=object), "at": at - starts[doc], "lead": at - lo, "around": pd.Series(around, dtype=object)})

    return run


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, windows``: documents that hold at least MIN_RUN successive words
    of an item, and how many of the document's word positions start such a run.

    docs: ``doc_id, text``; items: ``item_id, text``; other columns are ignored. Null and
    blank texts and texts of fewer words match nothing; repeated rows count once; no
    items give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # a nullable long comes to pandas as a float
    asked = items.select("item_id", "text").where("text is not null and item_id is not null").distinct()
    # an id with several texts stands for each of them
    asked = asked.mapInPandas(_item_rows, "item_id long, words array<string>, shingles array<long>").withColumn("text_no", F.xxhash64("words"))
    shingles = asked.select("item_id", "text_no", F.size("shingles").alias("size"), F.posexplode("shingles").alias("pos", "h"))
    counts = docs.mapInPandas(_counts(_bitmap(shingles)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    # the rarest shingle of each window; one with a shingle that no document holds can't occur
    ahead = Window.partitionBy("item_id", "text_no").orderBy("pos").rowsBetween(0, SPAN)
    known = shingles.join(counts, "h", "left").withColumn("least", F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pos", "h")).over(ahead))
    prefixes = known.where(F.col("pos") + SPAN < F.col("size")).where("least.n > 0").select("item_id", "text_no", F.col("pos").alias("begin"), (F.col("least.pos") - F.col("pos")).alias("offset"), F.col("least.h").alias("h"))
    prefixes = checkpoint(prefixes)  # both the bitmap and the join read them
    places = docs.mapInPandas(_places(_bitmap(prefixes.select("h"))), "h long, doc_id string, at int, lead int, around array<string>")
    # positional bound: enough words before and behind the prefix
    met = places.join(prefixes, "h").where((F.col("lead") >= F.col("offset")) & (F.size("around") - F.col("lead") >= MIN_RUN - F.col("offset")))
    full = met.join(asked.select("item_id", "text_no", "words"), ["item_id", "text_no"])
    same = F.expr(f"slice(around, lead - offset + 1, {MIN_RUN}) = slice(words, begin + 1, {MIN_RUN})")
    found = full.where(same).select("doc_id", "item_id", (F.col("at") - F.col("offset")).alias("at"))
    return found.withColumn("doc_id", F.col("doc_id").cast("long")).groupBy("doc_id", "item_id").agg(F.count_distinct("at").alias("windows"))
