"""Filling containers of fixed capacity with documents.

Method: lexical retrieval packing. Documents are spread over shards of bounded size, those
with rare words in common together: a document's key is the smallest hash of its RARE rarest
words, rarity being counted over all documents, and a shard holds all items of its keys.
Each shard builds a BM25 inverted index over its items; the largest unused item opens a
container as its seed, the index ranks the unused items by their score for the seed, and
the ranked neighbours that still fit are put in greedily. What is then left of the window
is closed by best fit: the largest unused item that fits, again and again. Only items
above the capacity are split, into full parts and one rest; full parts are containers of
their own and the rest is packed like any item.

Scale: word counts come to the driver in a table of fixed size. A key of more than
SHARD_ITEMS items (a hot group of copies) is cut by a hash of the document id, and keys are
spread over the shards by hash, so that a shard holds a small multiple of SHARD_ITEMS items
of at most one container's text each, whatever the collection's size. The items' texts are
shuffled once. Nothing depends on the partitioning of the input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.words import WordIds, mix
from docengine.session import checkpoint, partitions_for

CAPACITY = 1024
SHARD_ITEMS = 2048
RARE = 6
TABLE = 1 << 18  # places of the word counts
K1, B = 1.2, 0.75
_TOKEN = re.compile(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]+")
_ITEMS = "doc_id string, part int, parts int, tokens int, start int, stop int, key long, text string"
_PACKED = "container string, doc_id string, part int, parts int, tokens int, start int, stop int"


def _ids(text: str, ids: WordIds) -> np.ndarray:
    return np.array([ids[w] for w in set(text.lower().split())], dtype=np.uint64)


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many documents hold the words of each place of the table."""
    ids, total = WordIds(), np.zeros(TABLE, dtype=np.int64)
    for pdf in batches:
        for text in pdf["text"]:
            if text:
                np.add.at(total, (_ids(text, ids) % np.uint64(TABLE)).astype(np.int64), 1)
    at = np.flatnonzero(total)
    yield pd.DataFrame({"slot": at, "n": total[at]})


def _lexical_key(text: str, ids: WordIds, counts: np.ndarray) -> int:
    """The smallest hash among the rarest words that other documents hold too (of all words
    where there is none)."""
    w = _ids(text, ids)
    if not len(w):
        return 0
    n = counts[(w % np.uint64(TABLE)).astype(np.int64)]
    if (n > 1).any():
        w, n = w[n > 1], n[n > 1]
    rare = w[np.lexsort((w, n))[:RARE]]
    return int(mix(rare).min().astype(np.int64))


def _items(capacity: int, counts: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = WordIds()
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                text = text or ""
                spans = [m.span() for m in _TOKEN.finditer(text)] if len(text) > capacity else None
                n = len(spans) if spans is not None else len(_TOKEN.findall(text))
                if n <= capacity:
                    out.append((doc, 0, 1, n, 0, len(text), _lexical_key(text, ids, counts), text))
                    continue
                parts = -(-n // capacity)
                for p in range(parts):
                    first, last = p * capacity, min(n, (p + 1) * capacity) - 1
                    a = spans[first][0] if p else 0
                    b = spans[last + 1][0] if last + 1 < n else len(text)
                    full = last - first + 1 == capacity
                    out.append((doc, p, parts, last - first + 1, a, b, 0 if full else _lexical_key(text[a:b], ids, counts), None if full else text[a:b]))
            yield pd.DataFrame(out, columns=["doc_id", "part", "parts", "tokens", "start", "stop", "key", "text"])

    return run


class Bm25:
    """Inverted index of a shard: postings sorted by term, with ready BM25 weights."""

    def __init__(self, texts: list[str]):
        vocabulary: dict[str, int] = {}
        terms, items, counts = [], [], []
        for i, text in enumerate(texts):
            t, c = np.unique([vocabulary.setdefault(w, len(vocabulary)) for w in _TOKEN.findall(text.lower())] or [0], return_counts=True)
            if text:
                terms.append(t)
                items.append(np.full(len(t), i))
                counts.append(c)
        n = max(1, len(texts))
        self.n = len(texts)
        if not terms:
            self.of, self.starts, self.item, self.weight = [np.zeros(0, np.int64)] * self.n, np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0)
            return
        self.of = [np.zeros(0, np.int64)] * self.n
        for t, i in zip(terms, items, strict=True):
            self.of[i[0]] = t
        term, item, count = map(np.concatenate, (terms, items, counts))
        length = np.bincount(item, weights=count, minlength=self.n)
        df = np.bincount(term, minlength=len(vocabulary))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / max(1.0, length.mean()))
        order = np.argsort(term, kind="stable")
        self.item = item[order]
        self.weight = (idf[term] * count * (K1 + 1) / (count + norm[item]))[order]
        self.starts = np.append(0, np.cumsum(df))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 score of every item for the seed's terms."""
        t = self.of[seed]
        lo, size = self.starts[t], self.starts[t + 1] - self.starts[t]
        at = np.repeat(lo - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum()) if len(t) else np.zeros(0, np.int64)
        return np.bincount(self.item[at], weights=self.weight[at], minlength=self.n)


def pack(texts: list[str], sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item. The sizes are from 1 to capacity."""
    n = len(texts)
    index = Bm25(texts)
    container = np.full(n, -1)
    by_size = np.lexsort((np.arange(n), -sizes))
    rank = np.empty(n, dtype=np.int64)
    rank[by_size] = np.arange(n)
    ordered = -sizes[by_size]  # ascending
    free = np.arange(n + 1)  # over ranks, largest first: next unused rank, path-compressed

    def unused(r: int) -> int:
        root = r
        while free[root] != root:
            root = free[root]
        while free[r] != root:
            free[r], r = root, free[r]
        return root

    def put(i: int, k: int) -> int:
        container[i] = k
        free[rank[i]] = rank[i] + 1
        return int(sizes[i])

    k = 0
    while (r := unused(0)) < n:
        seed = by_size[r]
        room = capacity - put(seed, k)
        smallest = sizes[by_size[-1]]
        if room >= smallest:
            score = index.scores(seed)
            open_ = np.flatnonzero((container < 0) & (sizes <= room) & (score > 0))
            # neighbours go in while they leave room for others; the rest is closed by best fit
            for i in open_[np.lexsort((open_, -score[open_]))]:
                if sizes[i] <= room:
                    room -= put(i, k)
                    if room < smallest or room <= capacity // 8:
                        break
        while room > 0 and (r := unused(int(np.searchsorted(ordered, -room, side="left")))) < n:
            room -= put(by_size[r], k)
        k += 1
    return container


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers of at most ``capacity`` tokens with the documents (or parts) in them.

    docs: ``doc_id``, ``text``; other columns are ignored. Result: ``container, doc_id, part, parts,
    tokens, start, stop``; start and stop are the code points of the part's text. Null,
    empty and blank texts have no tokens and stand in no container (``container`` null).
    Repeated rows are packed as often as they occur.
    """
    spark = docs.sparkSession
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # a nullable long comes to pandas as a float
    counts = np.zeros(TABLE, dtype=np.int64)
    for slot, n in named.select("text").mapInPandas(_word_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[slot] = n
    items = checkpoint(named.mapInPandas(_items(capacity, counts), _ITEMS))
    # full parts and empty texts are packed already; they are spread by their id
    whole = (F.col("tokens") == capacity) | (F.col("tokens") == 0)
    keys = items.where(~whole).groupBy("key").agg(F.count("*").alias("n"))
    hot = F.broadcast(keys.where(F.col("n") > SHARD_ITEMS).select("key", F.ceil(F.col("n") / SHARD_ITEMS).alias("cuts")))  # at most rows / SHARD_ITEMS
    shards = partitions_for(spark, items.count(), SHARD_ITEMS)
    cut = F.when(F.col("cuts").isNotNull() | whole, F.pmod(F.xxhash64("doc_id", "part"), F.coalesce("cuts", F.lit(shards)))).otherwise(0)
    placed = items.join(hot, "key", "left").withColumn("shard", F.pmod(F.xxhash64("key", cut), F.lit(shards)).cast("int")).drop("cuts", "key")

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "part", "parts", "tokens", "start", "text"], kind="stable", na_position="first").reset_index(drop=True)
        full, none = pdf["tokens"] == capacity, pdf["tokens"] == 0
        rest = pdf[~full & ~none]
        number = pack(rest["text"].tolist(), rest["tokens"].to_numpy(), capacity)
        container = pd.Series(None, index=pdf.index, dtype=object)
        container[rest.index] = [f"{s}-{k}" for s, k in zip(rest["shard"], number, strict=True)]
        container[full] = [f"{s}-full-{k}" for k, s in enumerate(pdf["shard"][full])]
        return pdf.assign(container=container)[["container", "doc_id", "part", "parts", "tokens", "start", "stop"]]

    return placed.groupBy("shard").applyInPandas(shard, _PACKED).withColumn("doc_id", F.col("doc_id").cast("long"))


def container_fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers and their fill: ``containers, tokens, least_possible, fill``."""
    each = packed.where("container is not null").groupBy("container").agg(F.sum("tokens").alias("tokens"))
    return each.agg(
        F.count("*").alias("containers"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.ceil(F.coalesce(F.sum("tokens"), F.lit(0)) / capacity).alias("least_possible"),
        F.round(F.sum("tokens") / (F.count("*") * capacity), 4).alias("fill"),
    )
