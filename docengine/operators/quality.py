"""Completeness, rules, drafts, windows over events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def completeness(asked: DataFrame, filled: DataFrame, by: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Share of the asked keys that are filled, per group (of no asked key: no row)."""
    marked = asked.join(filled.withColumn("_f", F.lit(1)), [*by, *key], "left")
    return marked.groupBy(*by).agg(F.count("*").alias("fields"), F.count("_f").alias("filled"), F.round(F.count("_f") / F.count("*"), 6).alias("completeness"))


def check_rules(values: DataFrame, rules: DataFrame, field: str, value: str) -> DataFrame:
    """Rules ``rule_id, field, condition max|min|range, lo, hi, severity`` applied to the
    values of their field: adds ``rule_id, status``. A missing value is a warning."""
    v = F.col(value)
    broken = (F.col("condition").isin("max", "range") & (v > F.col("hi"))) | (F.col("condition").isin("min", "range") & (v < F.col("lo")))
    status = F.when(v.isNull(), "warning").when(broken, F.col("severity")).otherwise("pass")
    return values.join(rules.withColumnRenamed("field", field), field).withColumn("status", status)


def validation_score(status: Column) -> Column:
    """Aggregate: a pass counts 1, a warning one half; 1 for nothing."""
    points = F.sum(F.when(status == "pass", 1.0).when(status == "warning", 0.5).otherwise(0.0))
    return F.when(F.count("*") == 0, 1.0).otherwise(F.round(points / F.count("*"), 6))


def diff(old: DataFrame, new: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Added, removed and changed keys with both values; equal ones are left out."""
    a = old.select(*key, F.col(value).alias("old"), F.lit(1).alias("_a"))
    b = new.select(*key, F.col(value).alias("new"), F.lit(1).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return a.join(b, list(key), "full").where("not (old <=> new)").select(*key, change.alias("change"), "old", "new")


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type; on a stream add a watermark first."""
    return events.groupBy(F.window(F.col("ts"), width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user, ended by a gap."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("s")
