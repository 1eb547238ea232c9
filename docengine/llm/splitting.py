"""Splitting oversized texts at natural boundaries.

Every position of a text where a cut reads well has a strength (paragraph end, table row
or list item end, sentence end, line end, word end). A sparse table over the strengths
answers "strongest cut in this window" in constant time, ties going to the right-most
cut. A piece may end anywhere in the upper half of its permissible length; where no
boundary lies in the window the cut is made at the limit. The next piece starts ``overlap``
characters before the cut, so that successive pieces share exactly these.

Scale: only texts above the limit reach Python, one at a time; memory is linear in one
text, time is linear in its length but for the table's logarithm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4
DEFAULT_TARGET, DEFAULT_OVERLAP = 512, 50
KINDS = ("limit", "word", "line", "sentence", "item", "paragraph")
_BOUNDARIES = (
    (5, re.compile(r"\n[ \t\r]*\n\s*")),
    (4, re.compile(r"\n(?=[ \t]*(?:[-*+|]|\d+[.)]))|(?<=\|)[ \t\r]*\n")),
    (3, re.compile(r"[.!?][\"'’”)\]]*(?:\s+|$)")),
    (2, re.compile(r"\n")),
    (1, re.compile(r"[ \t\r\f\v  ]+")),
)


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions before which a cut reads well, in order, and their strengths."""
    best: dict[int, int] = {}
    for strength, pattern in reversed(_BOUNDARIES):
        for m in pattern.finditer(text):
            best[m.end()] = strength
    at = np.array(sorted(best), dtype=np.int64)
    return at, np.array([best[p] for p in at.tolist()], dtype=np.int64)


class RangeMax:
    """Sparse table for the index of the range maximum; the last of equal ones wins."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        level = values * (n + 1) + np.arange(n)
        self.n, self.levels = n, [level]
        width = 1
        while 2 * width <= n:
            level = np.maximum(level[:-width], level[width:])
            self.levels.append(level)
            width *= 2

    def argmax(self, lo: int, hi: int) -> int:
        """Index of the largest value in [lo, hi), which must not be empty."""
        k = (hi - lo).bit_length() - 1
        level = self.levels[k]
        return int(max(level[lo], level[hi - (1 << k)])) % (self.n + 1)


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces (start, end, strength of the cut at the end) of at most ``limit``
    characters. An overlap of half the limit or more is cut down to just below it; one
    below zero counts as zero. A text within the limit is one piece."""
    n = len(text)
    limit = max(1, limit)
    overlap = max(0, min(overlap, (limit - 1) // 2))
    if n <= limit:
        return [(0, n, 5)]
    at, strength = boundaries(text)
    index = RangeMax(strength) if len(at) else None
    out, start = [], 0
    while n - start > limit:
        least = start + max(limit // 2, overlap) + 1
        lo, hi = np.searchsorted(at, [least, start + limit + 1]).tolist()
        if index is not None and lo < hi:
            k = index.argmax(lo, hi)
            cut, kind = int(at[k]), int(strength[k])
        else:
            cut, kind = start + limit, 0
        out.append((start, cut, kind))
        start = cut - overlap
    out.append((start, n, 5))
    return out


def split_texts(df: DataFrame) -> DataFrame:
    """Pieces of the texts above their limit.

    df: ``chunk_id string, text string, target int, overlap int`` (the last two in tokens
    of four characters); other columns are ignored. Result: ``chunk_id, piece_no, start,
    stop, tokens, cut, piece``, where start and stop are code points and ``cut`` names the
    boundary at the piece's end. Null texts and texts within the limit give no rows; a
    null, zero or negative target counts as 512, a null overlap as 50; repeated rows give
    repeated pieces.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, text, target, overlap in pdf.itertuples(index=False):
                parts = cuts(text, CHARS_PER_TOKEN * int(target), CHARS_PER_TOKEN * int(overlap))
                yield pd.DataFrame(
                    {
                        "chunk_id": key,
                        "piece_no": np.arange(len(parts), dtype=np.int32),
                        "start": [a for a, _, _ in parts],
                        "stop": [b for _, b, _ in parts],
                        "tokens": np.array([-(-(b - a) // CHARS_PER_TOKEN) for a, b, _ in parts], dtype=np.int32),
                        "cut": [KINDS[k] if b < len(text) else "end" for _, b, k in parts],
                        "piece": [text[a:b] for a, b, _ in parts],
                    }
                )

    target = F.when(F.col("target") > 0, F.col("target")).otherwise(DEFAULT_TARGET)
    big = df.select("chunk_id", "text", target.alias("target"), F.coalesce("overlap", F.lit(DEFAULT_OVERLAP)).alias("overlap")).where(F.length("text") > CHARS_PER_TOKEN * F.col("target"))
    return big.mapInPandas(run, "chunk_id string, piece_no int, start int, stop int, tokens int, cut string, piece string")


def oversized_chunk_pieces(chunks: DataFrame, source_docs: DataFrame, configs: DataFrame) -> DataFrame:
    """Pieces of the chunks above their file's ``prose_target_tokens``.

    A file's configuration is that of its last parse; where it is null or unknown, 512
    and 50 tokens hold. Re-ingested rows of one chunk with the same text count once.
    """
    limits = configs.where("config_id is not null").groupBy("config_id").agg(F.max("prose_target_tokens").alias("target"), F.max("prose_overlap_tokens").alias("overlap"))
    files = (
        source_docs.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max(F.struct(F.coalesce("parsed_at", F.lit("0001-01-01").cast("timestamp_ntz")), "config_id")).getField("config_id").alias("config_id"))
        .join(limits, "config_id")
        .select("doc_id", "target", "overlap")
    )
    least = configs.agg(F.min(F.when(F.col("prose_target_tokens") > 0, F.col("prose_target_tokens")))).first()[0]
    size = CHARS_PER_TOKEN * min(DEFAULT_TARGET, least or DEFAULT_TARGET)
    big = chunks.select("chunk_id", "doc_id", F.col("raw_md_fragment").alias("text")).where(F.length("text") > size)
    once = big.join(files, "doc_id", "left").where(F.length("text") > CHARS_PER_TOKEN * F.coalesce("target", F.lit(DEFAULT_TARGET))).dropDuplicates(["chunk_id", "doc_id", "text"])
    return split_texts(once)
