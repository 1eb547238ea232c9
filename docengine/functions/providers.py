"""Seams for models with offline defaults that give the same result every time."""

from __future__ import annotations

import time

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hashed_embedding(text: str, width: int) -> np.ndarray:
    """Signed feature hashing of the words, of length one (zero for no words)."""
    out = np.zeros(width, dtype=np.float32)
    for word in text.lower().split():
        h = xxhash.xxh64_intdigest(word)
        out[h % width] += 1.0 if h >> 63 else -1.0
    length = float(np.linalg.norm(out))
    return out / length if length else out


def embedding(text: Column, width: int = 64, model: Callable[[str, int], np.ndarray] = hashed_embedding) -> Column:
    """Vectors of a text column by a model, batch by batch; null for null."""

    @F.pandas_udf("array<float>")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: None if t is None else model(t, width))

    return run(text)


def embed(df: DataFrame, text: str, width: int = 64, name: str = "values") -> DataFrame:
    """Adds the vectors; each distinct text goes through the model once."""
    each = df.select(text).where(F.col(text).isNotNull()).distinct().withColumn(name, embedding(F.col(text), width))
    return df.join(each, text, "left")


def provided(rows: DataFrame, column: str, call, returns: str = "string", batch: int = 100, retries: int = 3, wait: float = 1.0) -> DataFrame:
    """The answers of a model to a column, as ``answer``: the seam for text generation,
    vision, OCR and layout models.

    ``call`` takes a list of values, texts or bytes, and gives as many answers; it is called
    in the tasks, with at most ``batch`` values. A call that fails is tried again after
    ``wait`` * 2^k seconds, ``retries`` times; a batch that still fails has null answers and
    the job goes on. Null values are not asked and have null answers. Equal values of a
    batch are asked once.
    """

    def ask(values: list) -> list:
        for k in range(retries + 1):
            try:
                answers = list(call(values))
                if len(answers) != len(values):
                    raise ValueError(f"{len(answers)} answers to {len(values)} values")
                return answers
            except Exception:  # noqa: BLE001  whatever a model's client raises
                if k < retries:
                    time.sleep(wait * 2**k)
        return [None] * len(values)

    @F.pandas_udf(returns)
    def run(values: pd.Series) -> pd.Series:
        known = list(dict.fromkeys(v for v in values if v is not None))
        told: dict = {}
        for i in range(0, len(known), batch):
            told |= dict(zip(known[i : i + batch], ask(known[i : i + batch]), strict=True))
        return pd.Series([told.get(v) for v in values], dtype=object)

    return rows.withColumn("answer", run.asNondeterministic()(F.col(column)))
