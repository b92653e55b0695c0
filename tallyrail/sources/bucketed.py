"""Logs stored in buckets of their correlation key, so that legs are paired where they lie.

A report over a bucketed log reads bucket by bucket: all messages of a channel and trace number are in one file per day, and no log row is
shuffled. A key with too many messages would make one bucket a straggler, so heavy keys are found when the log is written and stored apart,
spread and in the order of time; reports pair them by a shuffle of per-key counts. A day must be written at once, since a key may be heavy on one day only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrail.session import settings
from tallyrail.sources.sinks import COMPARABLE_TIMES, write_log

BUCKET_KEYS = ("switch_id", "trc_ad_no")
#: Times the mean size of a bucket that one key may have; so at most buckets / HEAVY keys are heavy.
HEAVY = 2


class BucketedLog(NamedTuple):
    """A log in two tables: `even` in buckets, `heavy` with the keys that would fill buckets alone."""

    even: DataFrame
    heavy: DataFrame


def heavy_keys(log: DataFrame, buckets: int, on: Sequence[str] = BUCKET_KEYS, heavy: float = HEAVY) -> DataFrame:
    """The keys with more rows than `heavy` mean buckets; there can be no more than `buckets / heavy` of them."""
    limit = heavy * log.count() / buckets
    return log.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).drop("_n")


def write_bucketed(log: DataFrame, name: str, path: str, buckets: int, on: Sequence[str] = BUCKET_KEYS, day: str = "trx_dt",
                   heavy: float = HEAVY, mode: str = "append") -> BucketedLog:
    """Store `log` as the tables `name`_even and `name`_heavy under `path`, partitioned by day.

    Every bucket of a day is one file, sorted by the key. Choose `buckets` for the size of the longest span that one report reads; a
    join of two logs needs the same number and keys.
    """
    keys = F.broadcast(heavy_keys(log, buckets, on, heavy))
    same = reduce(and_, [log[c].eqNullSafe(keys[c]) for c in on])
    even, apart = log.join(keys, same, "left_anti"), log.join(keys, same, "left_semi")
    writer = even.repartition(buckets, *on).write.mode(mode).format("parquet").partitionBy(day).bucketBy(buckets, *on).sortBy(*on)
    with settings(log.sparkSession, COMPARABLE_TIMES):
        writer.option("path", f"{path}/even").saveAsTable(f"{name}_even")
    write_log(apart, f"{path}/heavy", (day,), mode)
    return read_bucketed(log.sparkSession, name, path)


def read_bucketed(spark: SparkSession, name: str, path: str) -> BucketedLog:
    even = spark.table(f"{name}_even")
    return BucketedLog(even, spark.read.schema(even.schema).parquet(f"{path}/heavy"))


def open_bucketed(spark: SparkSession, name: str, path: str, buckets: int, on: Sequence[str] = BUCKET_KEYS, day: str = "trx_dt") -> BucketedLog:
    """A bucketed log that another session wrote: its table is declared again for this catalog, and its days are found."""
    schema = spark.read.option("basePath", f"{path}/even").parquet(f"{path}/even").schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    listed = ", ".join(f"`{c}`" for c in on)
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}_even` ({columns}) USING parquet PARTITIONED BY (`{day}`) "
              f"CLUSTERED BY ({listed}) SORTED BY ({listed}) INTO {buckets} BUCKETS LOCATION '{path}/even'")
    spark.catalog.recoverPartitions(f"{name}_even")
    return read_bucketed(spark, name, path)
