"""Recurring computation shapes as DataFrame transforms and Column factories."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def greedy_pairs(df: DataFrame, by: Sequence[str], order: Sequence[str], ok: Column) -> DataFrame:
    """Greedy merging of adjacent pairs: adds ``merge_group``.

    ``ok`` says of a row whether it may merge with the next one (it may use
    ``F.lead(...).over(w)`` with the same partition and order). A merged row is never
    merged again. Within each run of rows that may merge, those at odd positions start a
    merge and swallow the next row. Rows of one group share ``merge_group``.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    run = Window.partitionBy(*by, "_island", "_ok").orderBy(*order)
    out = df.withColumn("_ok", F.coalesce(ok, F.lit(False)) & F.lead(F.lit(True)).over(w).isNotNull())
    out = out.withColumn("_island", F.sum((~F.col("_ok")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("_start", F.col("_ok") & (F.row_number().over(run) % 2 == 1))
    out = out.withColumn("_swallowed", F.coalesce(F.lag("_start").over(w), F.lit(False)))
    out = out.withColumn("merge_group", F.sum((~F.col("_swallowed")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.drop("_ok", "_island", "_start", "_swallowed")


def runs(df: DataFrame, by: Sequence[str], order: Sequence[str], starts: Column, name: str = "run") -> DataFrame:
    """Gaps and islands: adds the number of the run, which grows where ``starts`` holds."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(w))


def header_path(df: DataFrame, by: Sequence[str], order: Sequence[str], level: str, title: str, levels: int = 6, name: str = "header_path") -> DataFrame:
    """Path of the open headings of each row, joined by `` > ``; null where none is open.

    A heading of level l closes all open ones of level l or more. Level l is open where
    its last heading is later than the last one of every level above it.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_pos", F.row_number().over(w))
    parts: list[Column] = []
    for k in range(1, levels + 1):
        last = F.last(F.when(F.col(level) == k, F.struct("_pos", F.col(title).alias("t"))), ignorenulls=True).over(upto)
        out = out.withColumn(f"_l{k}", last)
    for k in range(1, levels + 1):
        above = [F.coalesce(F.col(f"_l{j}._pos"), F.lit(0)) for j in range(1, k)]
        top = F.greatest(*above) if len(above) > 1 else above[0] if above else F.lit(0)
        parts.append(F.when(F.col(f"_l{k}._pos") > top, F.col(f"_l{k}.t")))
    path = F.concat_ws(" > ", *parts)
    return out.withColumn(name, F.when(path != "", path)).drop("_pos", *[f"_l{k}" for k in range(1, levels + 1)])


def slice_starts(n: Column, size: int, overlap: int) -> Column:
    """0-based starts of overlapping windows over n items (one for n <= 0: none)."""
    if size <= overlap:
        raise ValueError("a window must be larger than its overlap")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))


def _fold(returns: str, step) -> object:
    """A pandas UDF over arrays: one pass over each, whose state is a few numbers."""

    @F.pandas_udf(returns)
    def run(sizes: pd.Series, always: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else step(x, y) for x, y in zip(sizes, always, strict=True)], dtype=object)

    return run


def skip_fill(items: Column, budget: int, forced: int = 0, always: Column | None = None) -> Column:
    """Which items of an ordered ``array<struct<size: int, ...>>`` fit a budget, skipping
    what doesn't fit: ``array<boolean>``. The first ``forced`` items always go in, and those
    marked in ``always``, an ``array<boolean>``. A null size is 0."""

    def step(sizes: np.ndarray, sure: np.ndarray) -> list[bool]:
        used, keep = 0, []
        for size, must in zip(sizes, sure, strict=True):
            fits = bool(must) or used + size <= budget
            used += size if fits else 0
            keep.append(fits)
        return keep

    sizes = F.transform(items, lambda x: F.coalesce(x["size"].cast("long"), F.lit(0)))
    first = F.transform(items, lambda x, i: i < forced)
    return _fold("array<boolean>", step)(sizes, first if always is None else F.zip_with(first, always, lambda a, b: a | F.coalesce(b, F.lit(False))))


def pack_fill(sizes: Column, target: int) -> Column:
    """Pack numbers of an ordered ``array<int>``: a new pack begins where the next item
    would take the current, non-empty one above ``target``."""

    def step(values: np.ndarray, _: np.ndarray) -> list[int]:
        used, pack, packs = 0, 0, []
        for size in values:
            if used > 0 and used + size > target:
                pack, used = pack + 1, 0
            used += int(size)
            packs.append(pack)
        return packs

    values = F.transform(sizes, lambda x: F.coalesce(x.cast("long"), F.lit(0)))
    return _fold("array<int>", step)(values, F.array().cast("array<boolean>"))


def anchored_groups(values: Column, reach: Column) -> Column:
    """Group numbers of an ordered ``array<double>``: a value ``reach`` or more above its
    group's first one opens the next group (no reach: one group)."""

    def step(xs: np.ndarray, reach: np.ndarray) -> list[int]:
        anchor, group, groups = None, -1, []
        for x in xs:
            if anchor is None or (reach[0] is not None and reach[0] == reach[0] and x - anchor >= reach[0]):
                anchor, group = x, group + 1
            groups.append(group)
        return groups

    return _fold("array<int>", step)(values, F.array(reach.cast("double")))


def latest(df: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order (last write wins with a descending one)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def top_k(df: DataFrame, by: Sequence[str], k: int, *order: Column, name: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
