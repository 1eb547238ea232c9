"""Orphan references: references whose target did not live at their time.

Method: target keys are dictionary-encoded as integers within hash ranges; per range and
month one compressed bitmap holds the keys referenced in it and another the keys that
lived through it. Reference AND-NOT living, on the bitmaps' bytes, leaves the suspects,
which are decoded back to keys. A suspect whose target had no event in that month is an
orphan for certain; for the others the month's changes of state travel with the suspect,
and each reference finds the last change before its own time.

Scale: events are reduced to changes of state per (key, day) and then per (key, month),
references to (key, month) before they meet, so that a key which holds a third of all rows
counts as a few rows. The references themselves move twice: to find the earliest row of
each and to meet the suspects; a (key, month) with more than HOT of them is cut into parts
of HOT there. The list of such keys, which is broadcast, has at most rows / HOT entries.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions import bitmaps
from docengine.session import partitions_for

KEYS_PER_RANGE = 1 << 14
HOT = 1_000_000
_SUSPECTS = "key string, month int, alive boolean, steps array<long>"


def clean_key(name: str):
    """Trimmed, lower-cased id; null where nothing is left."""
    key = F.lower(F.btrim(F.col(name), F.lit(" \t\r\n")))
    return F.when(key != "", key)


def _month(t):
    return (F.year(t) * 12 + F.month(t) - 1).cast("int")


def _micros(t: str) -> Column:
    """Microseconds of a time without zone, whatever the session's zone."""
    return F.expr(f"unix_date(cast({t} as date)) * 86400000000L + hour({t}) * 3600000000L + minute({t}) * 60000000L + cast(extract(second from {t}) * 1000000 as bigint)")


def _steps(events: DataFrame) -> DataFrame:
    """``key, month, steps``: the sorted changes of state of each key and month as twice
    the microseconds, plus 1 for a deletion, which thus comes last at its instant."""
    rows = events.select("key", F.to_date("t").alias("day"), _month(F.col("t")).alias("month"), (2 * _micros("t") + F.col("dead")).alias("step"))
    for part in ("day", "month"):
        w = Window.partitionBy("key", part).orderBy("step")
        rows = rows.withColumn("_before", F.lag("step").over(w)).where("_before is null or (_before & 1) <> (step & 1)").drop("_before")
    return rows.groupBy("key", "month").agg(F.array_sort(F.collect_list("step")).alias("steps"))


def _suspects(pdf: pd.DataFrame) -> pd.DataFrame:
    """One hash range: dictionary, bitmaps per month, AND-NOT, decode."""
    words, ids = np.unique(pdf["key"].to_numpy(dtype=object).astype(str), return_inverse=True)
    month, is_ref = pdf["month"].to_numpy(), pdf["is_ref"].to_numpy(dtype=bool)
    steps = pdf["steps"].to_numpy()
    referenced: dict[int, dict[int, bytes]] = {}
    living: dict[int, dict[int, bytes]] = {}
    starts: dict[int, np.ndarray] = {}  # bits of the keys that live at a month's beginning
    changes: dict[int, dict[int, np.ndarray]] = {}
    alive = np.zeros(len(words), dtype=bool)
    order = np.argsort(month, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(month[order])) + 1):
        m = int(month[rows[0]])
        events = rows[~is_ref[rows]]
        changed = ids[events]
        refs = np.unique(ids[rows[is_ref[rows]]])
        if len(refs):
            through = alive.copy()
            through[[i for i, e in zip(changed, events, strict=True) if (steps[e] & 1).any()]] = False
            referenced[m], living[m] = bitmaps.encode_any(refs), bitmaps.encode_any(np.flatnonzero(through))
            starts[m] = np.packbits(alive)
            changes[m] = dict(zip(changed.tolist(), steps[events], strict=True))
        alive[changed] = [not steps[e][-1] & 1 for e in events]
    out: list[tuple] = []
    for m, asked in referenced.items():
        left = bitmaps.decode_any(bitmaps.and_not_any(asked, living[m]))
        begun = np.unpackbits(starts[m])[left].astype(bool)
        out += [(words[i], m, bool(b), changes[m].get(i)) for i, b in zip(left.tolist(), begun, strict=True)]
    return pd.DataFrame(out, columns=["key", "month", "alive", "steps"])


def orphan_references(refs: DataFrame, events: DataFrame, ranges: int) -> DataFrame:
    """Rows of ``refs`` whose target does not live at their time.

    refs: ``ref_table, ref_key, key, t``; events: ``key, t, dead`` (dead: a deletion).
    A target lives at t if its last event up to t, t included, is not a deletion; of
    several events at one instant a deletion counts as the last. References with null
    key or null time are no cases; events with null key or time are left out; a target
    with no event never lives. Result: the columns of ``refs``.
    """
    refs = refs.where(F.col("key").isNotNull() & F.col("t").isNotNull()).withColumn("month", _month(F.col("t")))
    steps = _steps(events.where(F.col("key").isNotNull() & F.col("t").isNotNull()))
    asked = refs.groupBy("key", "month").agg(F.count("*").alias("n"))
    both = steps.select("key", "month", F.lit(False).alias("is_ref"), "steps").unionByName(
        asked.select("key", "month", F.lit(True).alias("is_ref"), F.array().cast("array<long>").alias("steps"))
    )
    suspects = (
        both.withColumn("range", F.pmod(F.xxhash64("key"), F.lit(ranges)).cast("int"))
        .groupBy("range")
        .applyInPandas(lambda pdf: _suspects(pdf), _SUSPECTS)
    )
    hot = F.broadcast(asked.where(F.col("n") > HOT).select("key", "month", F.ceil(F.col("n") / HOT).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    cut = refs.join(hot, ["key", "month"], "left").withColumn("part", F.when(parts == 1, 0).otherwise(F.pmod(F.xxhash64("ref_table", "ref_key"), parts).cast("int"))).drop("parts")
    spread = suspects.join(hot, ["key", "month"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    last = F.array_max(F.filter("steps", lambda x: x <= 2 * F.col("at") + 1))
    dead = F.coalesce(last.bitwiseAND(F.lit(1)) == 1, ~F.col("alive"))
    return cut.join(spread, ["key", "month", "part"]).withColumn("at", _micros("t")).where(dead).select("ref_table", "ref_key", "key", "t")


def chunk_reference_orphans(chunks: DataFrame, parents: DataFrame, tombstones: DataFrame, citations: DataFrame, candidates: DataFrame) -> DataFrame:
    """References of chunks, citations and candidates with no living target at their
    time: ``ref_table, ref_key, period`` with the month of the reference as yyyy-MM.

    A reference's time is the earliest among the rows of its key; a key whose rows name
    several targets counts once for each. Empty tables give no rows.
    """
    spark = chunks.sparkSession

    def event(df: DataFrame, ns: str, t: str, dead: int) -> DataFrame:
        return df.select(F.concat(F.lit(ns), clean_key("chunk_id")).alias("key"), F.col(t).cast("timestamp_ntz").alias("t"), F.lit(dead).alias("dead"))

    def ref(df: DataFrame, name: str, ref_key: str, target, ns, t: str) -> DataFrame:
        return (
            df.select(F.col(ref_key).cast("string").alias("ref_key"), F.concat(ns, target).alias("key"), F.col(t).cast("timestamp_ntz").alias("t"))
            .where("key is not null")
            .select(F.lit(name).alias("ref_table"), "ref_key", "key", "t")
        )

    child, parent = F.lit("c:"), F.lit("p:")
    events = (
        event(chunks, "c:", "ingested_at", 0)
        .unionByName(event(parents, "p:", "ingested_at", 0))
        .unionByName(event(tombstones, "c:", "deleted_at", 1))
        .unionByName(event(tombstones, "p:", "deleted_at", 1))
    )
    refs = (
        ref(chunks, "chunks", "chunk_id", clean_key("parent_id"), parent, "ingested_at")
        .unionByName(ref(citations, "citations", "citation_id", clean_key("chunk_id"), child, "created_at"))
        .unionByName(
            ref(candidates, "candidates", "candidate_id", clean_key("chunk_id"), F.when(F.lower(F.trim("namespace")) == "parents", parent).otherwise(child), "retrieved_at")
        )
    )
    refs = refs.groupBy("ref_table", "ref_key", "key").agg(F.min("t").alias("t"))
    rows = reduce(DataFrame.union, (df.select(F.lit(1)) for df in (chunks, parents, tombstones, citations, candidates))).count()
    found = orphan_references(refs, events, partitions_for(spark, rows, KEYS_PER_RANGE))
    return found.select("ref_table", "ref_key", F.date_format("t", "yyyy-MM").alias("period")).distinct()
