"""Windows that correct themselves: a stream in update mode, kept as versions.

In update mode a window is written each time rows change it, long before the watermark closes it. Every micro-batch writes its changed windows to
its own folder, so a repeated batch overwrites itself, and the version with the highest batch number counts. `compact` merges the versions that no reader needs
apart into one table per key, so that readers and folders do not grow with the number of batches.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyrail.streaming import jobs

BATCH = T.StructField("batch_id", T.LongType())


def run_upserts(stream: DataFrame, folder: str, every: str | None = None, state_partitions: int | None = None) -> StreamingQuery:
    """Keep the changed rows of a windowed stream (such as `window_calls`) under `folder`."""
    return jobs.run_batches(stream, folder, lambda batch: batch, "update", every, state_partitions)


def latest(spark: SparkSession, folder: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """The last version of every window written so far; one row per key."""
    return _newest(versions(spark, folder, schema), keys).select(schema.fieldNames())


def compact(spark: SparkSession, folder: str, schema: T.StructType, keys: Sequence[str]) -> int:
    """Merge all versions so far into one table and remove what it holds; gives the last batch merged, -1 if there is none.

    The merged table is complete before anything is removed, and readers take the newest complete one with the batches after it; so it
    does not matter where a run is interrupted. Call it between batches, or beside the running query: new batches are left alone.
    """
    upto = max(numbers(spark, f"{folder}/data", "batch_id"), default=-1)
    base = max(numbers(spark, f"{folder}/base", "upto"), default=-1)
    if upto <= base:
        return base
    merged = versions(spark, folder, schema).where(F.col("batch_id") <= upto)
    _newest(merged, keys).write.mode("overwrite").parquet(f"{folder}/base/upto={upto}")
    for number in numbers(spark, f"{folder}/data", "batch_id"):
        if number <= upto:
            remove(spark, f"{folder}/data/batch_id={number}")
    if base >= 0:
        remove(spark, f"{folder}/base/upto={base}")
    return upto


def _newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Map-side combine keeps one version per key and task, however often a window was written."""
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v")).select(*keys, "_v.*")


def versions(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All versions that are kept: the newest complete merged table and the batches after it."""
    versioned = T.StructType([*schema.fields, BATCH])
    base = max(numbers(spark, f"{folder}/base", "upto"), default=-1)
    later = [n for n in numbers(spark, f"{folder}/data", "batch_id") if n > base]
    out = spark.read.schema(versioned).parquet(f"{folder}/base/upto={base}") if base >= 0 else spark.createDataFrame([], versioned)
    if later:
        found = spark.read.schema(versioned).option("basePath", f"{folder}/data").parquet(*[f"{folder}/data/batch_id={n}" for n in later])
        out = out.unionByName(found)
    return out


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The numbers of the complete tables `name`=N in a folder."""
    place, fs = _path(spark, folder)
    if not fs.exists(place):
        return []
    found = [re.fullmatch(rf"{name}=(\d+)", s.getPath().getName()) for s in fs.listStatus(place)]
    done = [m[1] for m in found if m and fs.exists(_path(spark, f"{folder}/{m[0]}/_SUCCESS")[0])]
    return sorted(map(int, done))


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder."""
    place, fs = _path(spark, path)
    fs.delete(place, True)
