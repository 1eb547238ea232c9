"""Near-duplicate texts by Golay-code fuzzy hashing.

Every distinct text gets a fingerprint of SEGMENTS words of 24 bits (each bit is the low
bit of the smallest hash among the text's words that fall into the bit's bin) and, for
each segment, two min-hashes of its shingles. Each segment is decoded to its nearest
codewords of the (24, 12, 8) Golay code, one to six of them; a key is (segment, the two
min-hashes, codeword index). The bit errors of two similar texts spread over the
segments, so that by the pigeonhole principle some carry no or one error, which always
share a codeword, or two to four, which often do. Plain 12-bit codeword keys would be
shared by a fixed part of all pairs of texts, so the number of candidates would grow as
the square of the collection; the min-hashes thin this out by the square of the texts'
similarity. Texts that share a key and differ in at most SKETCH_BINS of the 64 bins of
their sketches (two bits of the smallest hash in each bin) become candidates, and every
candidate is verified exactly on its word shingles.

Scale: copies are brought together before anything else, by a partial aggregate that sends
a text once per task; keys are thus made for distinct texts, whatever the partitioning, and
the same shuffle serves the verification. Keys carry ids and sketches only. A key of more
than HOT_KEY texts is joined in blocks of that size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm import golay
from docengine.llm.words import WordIds, mix, seeds
from docengine.session import checkpoint

SEGMENTS = 18
SKETCH_BINS = 34  # of similar texts (0.6) three bins in ten differ, 19 of 64 on average; this is four deviations more
HOT_KEY = 20_000
BATCH_WORDS = 1 << 18
_WORD = re.compile(r"[a-z0-9]+")
_KEYS = "key long, tid long, low long, high long"


def chunk_text() -> Column:
    """A chunk's own text: ``raw_md_fragment``, or if null what follows the first blank
    line of ``text_for_embedding``."""
    return F.coalesce("raw_md_fragment", F.regexp_extract("text_for_embedding", r"(?s)\A.*?\n[ \t\r]*\n(.*)\z", 1))


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _filled(low: np.ndarray) -> np.ndarray:
    """Empty bins take the value of the next full one to the right, mixed with the way to
    it, so that two short texts do not agree just where both have nothing."""
    n, bins = low.shape
    at = np.where(low == np.iinfo(np.uint64).max, 4 * bins, np.arange(bins))
    at = np.minimum.accumulate(np.append(at, at + bins, axis=1)[:, ::-1], axis=1)[:, ::-1][:, :bins]
    way = (at - np.arange(bins)).astype(np.uint64)
    return mix(np.take_along_axis(low, at % bins, axis=1) + way * seeds("way", 1)[0])


def _fingerprints(tids: list[int], texts: list[list[int]], k: int) -> pd.DataFrame:
    """Keys of a batch of texts, given as lists of word hashes."""
    sizes = np.array([len(t) for t in texts])
    w = np.fromiter((x for t in texts for x in t), dtype=np.uint64, count=sizes.sum())
    starts = np.append(0, np.cumsum(sizes)[:-1])
    n = len(sizes)
    doc = np.repeat(np.arange(n), sizes)
    shingle = mix(w)
    for i, m in enumerate(seeds("shingle", k)[1:], 1):
        shingle[:-i] += mix(w[i:] ^ m) * m
    inside = np.arange(len(w)) < np.repeat(starts + sizes - k + 1, sizes)
    shingle = mix(shingle[inside])
    s_starts = np.append(0, np.cumsum(sizes - k + 1)[:-1])
    s_doc = doc[inside]

    def smallest(h: np.ndarray, of: np.ndarray, bins: int) -> np.ndarray:
        low = np.full(n * bins, np.iinfo(np.uint64).max)
        np.minimum.at(low, of * bins + (h % np.uint64(bins)).astype(np.int64), h >> np.uint64(8))
        return low.reshape(n, bins)

    def word(bits: np.ndarray) -> np.ndarray:
        return np.bitwise_or.reduce((bits & np.uint64(1)) << np.arange(bits.shape[1], dtype=np.uint64), axis=1).view(np.int64)

    sketch = _filled(smallest(mix(shingle ^ seeds("sketch", 1)[0]), s_doc, 64))
    sketch_low, sketch_high = word(sketch), word(sketch >> np.uint64(1))
    tid = np.array(tids, dtype=np.int64)
    out = []
    low = seeds("low", 2 * SEGMENTS)
    high = seeds("high", SEGMENTS)
    for j in range(SEGMENTS):
        a = np.minimum.reduceat(mix(shingle ^ low[2 * j]), s_starts)
        b = np.minimum.reduceat(mix(shingle ^ low[2 * j + 1]), s_starts)
        index, valid = golay.nearby(word(smallest(mix(w ^ high[j]), doc, 24)))
        anchor = mix(a + mix(b) + high[j])
        key = mix(anchor[:, None] + index.astype(np.uint64))
        row, _ = np.nonzero(valid)
        out.append((key[valid].view(np.int64), tid[row], sketch_low[row], sketch_high[row]))
    return pd.DataFrame(dict(zip(("key", "tid", "low", "high"), map(np.concatenate, zip(*out)), strict=True)))


def _key_rows(k: int, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = WordIds()
        get = ids.__getitem__
        tids, texts, held = [], [], 0
        for pdf in batches:
            for tid, text in zip(pdf["tid"], pdf["text"], strict=True):
                found = words(text)
                if len(found) < least:
                    continue
                tids.append(tid)
                texts.append(list(map(get, found)))
                held += len(found)
                if held >= BATCH_WORDS:
                    yield _fingerprints(tids, texts, k)
                    tids, texts, held = [], [], 0
        if tids:
            yield _fingerprints(tids, texts, k)

    return run


def shingle_set(text: str, k: int) -> frozenset:
    w = words(text)
    return frozenset(zip(*(w[i:] for i in range(k)), strict=False))


def _verified(k: int, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets: dict[int, frozenset] = {}

            def of(tid: int, text: str) -> frozenset:
                if tid not in sets:
                    sets[tid] = shingle_set(text, k)
                return sets[tid]

            out = []
            for a, b, x, y in pdf[["a", "b", "x", "y"]].itertuples(index=False):
                s, t = of(a, x), of(b, y)
                both = len(s & t)
                out.append(both / max(1, len(s) + len(t) - both))
            sim = np.array(out)
            keep = sim >= threshold - 1e-12
            yield pd.DataFrame({"a": pdf["a"][keep], "b": pdf["b"][keep], "similarity": sim[keep]})

    return run


def distinct_texts(texts: DataFrame, *more: Column) -> DataFrame:
    """One row per text: ``tid, text`` and the aggregates asked for."""
    return texts.where(F.col("text").isNotNull()).groupBy("tid").agg(F.min("text").alias("text"), *more)


def shared_keys(keys: DataFrame) -> DataFrame:
    """``a, b`` with a < b: pairs of texts that share a key and have near sketches, once for
    each such key. keys: ``key, tid, low, high``, each (key, tid) once."""
    # the join asks for no nulls and for all columns; asked for here too, all uses below share one shuffle
    keys = keys.where("key is not null and tid is not null and low is not null and high is not null").repartition("key")
    seen = F.bit_or(F.col("tid").bitwiseOR(F.col("low")).bitwiseOR(F.col("high")))
    counts = keys.groupBy("key").agg(F.count("*").alias("n"), seen.alias("seen"))
    crowded = F.broadcast(counts.where((F.col("n") > HOT_KEY) & F.col("seen").isNotNull()).select("key", "n"))  # at most rows / HOT_KEY
    # a left join, since an anti join would be moved before the shuffle and so make it another one
    known = keys.join(crowded, "key", "left")
    single = known.where("n is null").select("key", "tid", "low", "high")
    hot = known.where("n is not null").withColumn("blocks", F.ceil(F.col("n") / HOT_KEY).cast("int"))
    one = hot.withColumn("block", F.pmod(F.xxhash64("tid"), "blocks").cast("int")).select("key", "tid", "low", "high", "block")
    all_ = hot.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "tid", "low", "high", "block")

    def pairs(x: DataFrame, y: DataFrame, on: list[str]) -> DataFrame:
        x, y = x.alias("x"), y.alias("y")
        cond = F.col("x.tid") < F.col("y.tid")
        for c in on:
            cond = cond & (F.col(f"x.{c}") == F.col(f"y.{c}"))
        differ = F.bit_count(F.col("x.low").bitwiseXOR(F.col("y.low")).bitwiseOR(F.col("x.high").bitwiseXOR(F.col("y.high"))))
        return x.join(y, cond & (differ <= SKETCH_BINS)).select(F.col("x.tid").alias("a"), F.col("y.tid").alias("b"))

    return pairs(single, single, ["key"]).unionByName(pairs(one, all_, ["key", "block"]))


def similar_texts(texts: DataFrame, shingle: int, threshold: float, min_words: int) -> DataFrame:
    """Pairs of distinct texts with a Jaccard similarity of at least ``threshold`` on
    their sets of ``shingle`` successive words: ``a, b, similarity`` with a < b.

    texts: ``tid`` (64-bit hash of the text), ``text``; other columns are ignored. Null
    texts and texts of fewer than ``min_words`` words (at least ``shingle``) are left
    out; repeated rows count once. Texts whose 64-bit hashes collide count as one.
    """
    unique = distinct_texts(texts)
    pairs = checkpoint(shared_keys(unique.mapInPandas(_key_rows(shingle, max(min_words, shingle)), _KEYS)).distinct())
    both = pairs.join(unique.select(F.col("tid").alias("a"), F.col("text").alias("x")), "a").join(unique.select(F.col("tid").alias("b"), F.col("text").alias("y")), "b")
    return both.mapInPandas(_verified(shingle, threshold), "a long, b long, similarity double")


def chunk_members(chunks: DataFrame, min_words: int = 30) -> DataFrame:
    """``chunk_id, tid, text`` of the chunks whose text may have ``min_words`` words (a
    text of fewer than 2 * min_words - 1 characters can't)."""
    return chunks.select("chunk_id", chunk_text().alias("text")).where((F.length("text") >= 2 * min_words - 1) & F.col("chunk_id").isNotNull()).withColumn("tid", F.xxhash64("text"))


def near_duplicate_pairs(chunks: DataFrame, shingle: int = 3, threshold: float = 0.6, min_words: int = 30) -> DataFrame:
    """Pairs of different chunk ids whose texts are similar: ``chunk_id_a, chunk_id_b``
    with a < b, without repeats. Chunks with one and the same text are pairs too."""
    members = chunk_members(chunks, min_words)
    links = similar_texts(members, shingle, threshold, min_words).select("a", "b")
    # texts held by several chunk ids; whether such a text is long enough is asked once
    long_enough = F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))) >= max(min_words, shingle)
    copies = distinct_texts(members, F.min("chunk_id").alias("lo"), F.max("chunk_id").alias("hi")).where(F.col("lo") < F.col("hi")).where(long_enough)
    links = links.unionByName(copies.select(F.col("tid").alias("a"), F.col("tid").alias("b")))
    of = members.select("tid", "chunk_id")
    out = links.join(of.select(F.col("tid").alias("a"), F.col("chunk_id").alias("p")), "a").join(of.select(F.col("tid").alias("b"), F.col("chunk_id").alias("q")), "b")
    return out.where("p <> q").select(F.least("p", "q").alias("chunk_id_a"), F.greatest("p", "q").alias("chunk_id_b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """Connected components of links ``a, b``: ``node, label`` with the smallest node of
    the component. Every round takes the smallest label among the neighbours and then the
    label's own label, so that rounds grow as the logarithm of a chain's length; each
    round is written to the shared folder."""
    both = checkpoint(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = checkpoint(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        far = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        after = checkpoint(met.join(far, "low", "left").select("node", F.coalesce(F.least("low", "far"), "low").alias("label"), F.col("label").alias("before")))
        labels = after.select("node", "label")
        if after.where("label <> before").limit(1).count() == 0:
            return labels


def duplicate_classes(chunks: DataFrame, shingle: int = 3, threshold: float = 0.6, min_words: int = 30) -> DataFrame:
    """``chunk_id, class_id, links``: every chunk with a text of at least 2 * min_words - 1
    characters, its class and the number of different texts similar to its own. Chunks of
    one class are joined by a chain of similar texts; a class is named by its smallest
    chunk id. Copies of a text share its row of links."""
    members = chunk_members(chunks, min_words)
    links = checkpoint(similar_texts(members, shingle, threshold, min_words).select("a", "b"))
    count = links.select(F.explode(F.array("a", "b")).alias("tid")).groupBy("tid").agg(F.count("*").alias("links"))
    rows = members.select("chunk_id", "tid").distinct().join(components(links).withColumnRenamed("node", "tid"), "tid", "left").join(count, "tid", "left")
    rows = rows.select("chunk_id", F.coalesce("label", "tid").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    names = rows.groupBy("label").agg(F.min("chunk_id").alias("class_id"))
    return rows.join(names, "label").select("chunk_id", "class_id", "links")
