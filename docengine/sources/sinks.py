"""Writers for chunks, JSON lines, vectors and run artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.operators.retrieval import upsert
from docengine.operators.shapes import latest


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks by file; a rewritten file's older chunks go. Rows without id are skipped."""
    rows = chunks.where("coalesce(chunk_id, '') <> ''")
    rows.write.partitionBy("doc_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_run(df: DataFrame, path: str, run_id: str, artifact: str) -> None:
    """One artifact of a run as JSON under its run id."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").json(f"{path}/run_id={run_id}/{artifact}")


BUCKETS = 64


def upsert_vectors(spark: SparkSession, new: DataFrame, path: str, version: str) -> None:
    """Merge vector records ``namespace, id, values, ...`` into a table of versions. A record's
    bucket is a hash of namespace and id; a version holds the buckets that the new records
    touch, merged, and a reader takes each bucket from its last version, so that a batch
    rewrites the touched buckets only and a failed write leaves the last good state. Records
    without id or values are skipped."""
    usable = new.where("coalesce(id, '') <> '' and size(values) > 0")
    bucket = F.pmod(F.xxhash64("namespace", "id"), F.lit(BUCKETS)).cast("int")
    touched = [r["b"] for r in usable.select(bucket.alias("b")).distinct().collect()]  # at most BUCKETS
    stored = read_vectors(spark, path, touched)
    merged = latest(usable, ["namespace", "id"], F.desc_nulls_last(version)) if stored is None else upsert(stored, usable, ["namespace", "id"], version)
    last = latest_version(spark, path)
    rows = merged.withColumn("vector_bucket", bucket).repartition("vector_bucket")
    rows.write.mode("overwrite").partitionBy("vector_bucket").parquet(f"{path}/v={0 if last is None else last + 1}")


def read_vectors(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame | None:
    """The last version of every bucket, or of some; None where nothing is stored."""
    fs, folder = _fs(spark, path)
    if not fs.exists(folder):
        return None
    found: dict[int, str] = {}
    for n in _versions(spark, path):
        for s in fs.listStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v={n}")):
            name = s.getPath().getName()
            key, _, number = name.partition("=")
            if key == "vector_bucket" and (buckets is None or int(number) in buckets):
                found[int(number)] = f"{path}/v={n}/{name}"
    # read folder by folder, so that no part of a path becomes a column
    return spark.read.parquet(*found.values()) if found else None


def _fs(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that were written to their end, in order."""
    fs, folder = _fs(spark, path)
    if not fs.exists(folder):
        return []
    done = [s.getPath() for s in fs.listStatus(folder) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName()[2:]) for p in done if p.getName().startswith("v="))


def latest_version(spark: SparkSession, path: str) -> int | None:
    """The largest version that was written to its end."""
    return max(_versions(spark, path), default=None)
