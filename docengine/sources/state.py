"""Images, artifacts of runs, progress of long page jobs, delta logs and settings."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as bytes: ``path, length, content``. Only files of image suffixes are read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,gif,bmp,tif,tiff,webp}").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def pages_in_range(pages: DataFrame, page: str, start: int = 0, end: int | None = None) -> DataFrame:
    """Pages from ``start`` up to, not including, ``end``, counted from 0; an end beyond the
    last page, or none, is the last page's."""
    rows = pages.where(F.col(page) >= start)
    return rows if end is None else rows.where(F.col(page) < end)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def read_artifact(spark: SparkSession, path: str, run_id: str, artifact: str) -> DataFrame | None:
    """One artifact of a run as it was written; None where there is none."""
    place = f"{path}/run_id={run_id}/{artifact}"
    fs, folder = _fs(spark, place)
    return spark.read.json(place) if fs.exists(folder) else None


class Progress:
    """How far long page jobs have come, one JSON file for each, in any Hadoop file system."""

    VERSION = "1.0"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _file(self, name: str):
        if not name or "/" in name:
            raise ValueError(f"not a name: {name!r}")
        return _fs(self.spark, f"{self.path}/{name}.json")

    def save(self, name: str, document: str, last_batch: int, last_page: int, strategy: str | None = None, batches: Iterable[Mapping] = ()) -> None:
        """Write or replace; a file that is being written is not seen before it is whole."""
        state = {"version": self.VERSION, "document_path": document, "last_batch": last_batch, "last_page": last_page, "strategy": strategy, "batches": [dict(b) for b in batches]}
        fs, file = self._file(name)
        part = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_{name}.part")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        fs.delete(file, False)
        fs.rename(part, file)

    def load(self, name: str) -> dict:
        fs, file = self._file(name)
        if not fs.exists(file):
            raise FileNotFoundError(f"{self.path}/{name}.json")
        return json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.path}/{name}.json", wholetext=True).collect()))

    def names(self) -> list[str]:
        fs, folder = _fs(self.spark, self.path)
        if not fs.exists(folder):
            return []
        return sorted(n[:-5] for s in fs.listStatus(folder) if (n := s.getPath().getName()).endswith(".json"))

    def delete(self, name: str) -> bool:
        fs, file = self._file(name)
        return fs.delete(file, False)


def write_delta_log(changes: DataFrame, path: str, run_id: str) -> None:
    """Changes between two drafts as JSON lines under their run, with the time of writing;
    what was written for the run before stays."""
    changes.withColumn("run_id", F.lit(run_id)).withColumn("logged_at", F.current_timestamp()).write.mode("append").json(f"{path}/delta")


def settings(defaults: Mapping[str, object], file: str | None = None, environment: Mapping[str, str] | None = None) -> dict[str, object]:
    """Defaults, overridden by a file of ``NAME=value`` lines and that by the environment.
    Values take their default's type; names without default are ignored; a missing file is
    no error; lines without ``=`` and those that begin with # say nothing."""
    told: dict[str, str] = {}
    if file and os.path.exists(file):
        with open(file, encoding="utf-8") as f:
            for line in f:
                name, eq, value = line.strip().partition("=")
                if eq and not name.startswith("#"):
                    told[name.strip()] = value.strip().strip("\"'")
    told |= {k: v for k, v in (os.environ if environment is None else environment).items() if k in defaults}
    out = dict(defaults)
    for name, value in told.items():
        if name in out:
            kind = type(out[name])
            out[name] = value.lower() in ("1", "true", "yes", "on") if kind is bool else value if out[name] is None else kind(value)
    return out
