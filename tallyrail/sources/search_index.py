"""A search index over stored logs: which files can hold a keyword at all.

For every file, payload column and channel the index keeps a Bloom sketch of the n-grams of its payloads: each gram sets one bit of `BITS`, kept as
64-bit masks by their place. A keyword occurs in a payload only if all its grams do, so files that lack a bit of one are left out before the
payload scan; the search itself stays exact, on the files that remain. Files that are not in the index yet are always read.

The index is made by built-in functions with map-side combine (a task sends on at most its files' masks) and sorted by place, so a search
reads only the row groups of its few places. It is brought up to date by `index_files`, which reads only files that are new.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAM, BITS = 4, 1 << 18
MASKS = T.StructType([T.StructField("file", T.StringType()), T.StructField("column", T.StringType()), T.StructField("switch_id", T.StringType()),
                      T.StructField("place", T.IntegerType()), T.StructField("mask", T.LongType())])
FILES = T.StructType([T.StructField("file", T.StringType())])


class Found(NamedTuple):
    """A log narrowed to the files that can hold the keywords, and how many of its files that are."""

    log: DataFrame
    files: int
    all_files: int


def grams(text: Column, gram: int = GRAM) -> Column:
    """Distinct bits of a text's n-grams; none for a shorter text."""
    starts = F.sequence(F.lit(1), F.char_length(text) - (gram - 1))
    bit = F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substr(text, i, F.lit(gram))), F.lit(BITS)))
    return F.when(F.char_length(text) >= gram, F.array_distinct(bit))


def literal_parts(keywords: Iterable[str], like: bool = False) -> list[str]:
    """What a payload must hold as it stands; with `like`, wildcards part a keyword."""
    return [part for word in keywords for part in (re.split("[%_]", word) if like else [word]) if part]


def log_files(spark: SparkSession, path: str) -> list[str]:
    """The data files of a stored log."""
    return sorted(spark.read.parquet(path).inputFiles())


def index_files(spark: SparkSession, path: str, index: str, columns: Sequence[str], schema: T.StructType, gram: int = GRAM) -> int:
    """Add the files of the log at `path` that the index at `index` lacks; gives how many.

    Masks are written before the list of files, so a file counts as indexed only when its masks are there; what an interrupted run leaves
    is written again and does no harm, since masks only say what may be there.
    """
    known = set(indexed_files(spark, index))
    new = [f for f in log_files(spark, path) if f not in known]
    if not new:
        return 0
    log = spark.read.schema(schema).option("basePath", path).parquet(*new).withColumn("file", F.input_file_name())
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("payload")) for c in columns]))
    bits = log.select("file", "switch_id", each.alias("p")).select("file", "p.column", "switch_id", F.explode(grams(F.col("p.payload"), gram)).alias("bit"))
    masks = bits.groupBy("file", "column", "switch_id", (F.col("bit") / 64).cast("int").alias("place")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("bit", F.lit(64)).cast("int"))).alias("mask"))
    masks.repartitionByRange("place", "file").sortWithinPartitions("place").select(MASKS.fieldNames()).write.mode("append").parquet(f"{index}/masks")
    spark.createDataFrame([(f,) for f in new], FILES).coalesce(1).write.mode("append").parquet(f"{index}/files")
    return len(new)


def indexed_files(spark: SparkSession, index: str) -> list[str]:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{index}/files")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return []
    return [r.file for r in spark.read.schema(FILES).parquet(f"{index}/files").collect()]  # a path per file of the log


def candidates(spark: SparkSession, index: str, columns: Sequence[str], channel: str, keywords: Sequence[str], like: bool = False,
               gram: int = GRAM) -> list[str] | None:
    """The indexed files in which one of the columns may hold all keywords; None if the keywords are too short to tell."""
    parts = [p for p in literal_parts(keywords, like) if len(p) >= gram]
    if not parts:
        return None
    needed = spark.range(1).select(F.explode(F.array_distinct(F.flatten(F.array(*[grams(F.lit(p), gram) for p in parts])))).alias("bit"))
    wanted: dict[int, int] = {}
    for row in needed.select((F.col("bit") / 64).cast("int").alias("place"), F.pmod("bit", F.lit(64)).cast("int").alias("at")).collect():
        wanted[row.place] = wanted.get(row.place, 0) | 1 << row.at
    signed = {p: m - (1 << 64) if m >> 63 else m for p, m in wanted.items()}
    masks = spark.read.schema(MASKS).parquet(f"{index}/masks").where(
        F.col("place").isin(list(signed)) & F.col("column").isin(list(columns)) & (F.col("switch_id") == channel))
    asked = F.create_map(*[F.lit(x) for p, m in signed.items() for x in (p, m)])
    whole = masks.groupBy("file", "column", "place").agg(F.bit_or("mask").alias("mask")).where(
        F.col("mask").bitwiseAND(F.element_at(asked, F.col("place"))) == F.element_at(asked, F.col("place")))
    hits = whole.groupBy("file", "column").agg(F.count("*").alias("n")).where(F.col("n") == len(signed))
    return sorted(r.file for r in hits.select("file").distinct().collect())


def narrowed(spark: SparkSession, path: str, index: str, columns: Sequence[str], schema: T.StructType, channel: str, keywords: Sequence[str],
             like: bool = False, gram: int = GRAM) -> Found:
    """The log at `path` without the files that cannot hold all keywords in any of `columns`; give it to `payload.search_payload`."""
    every = log_files(spark, path)
    hits = candidates(spark, index, columns, channel, keywords, like, gram)
    keep = every
    if hits is not None:
        known, found = set(indexed_files(spark, index)), set(hits)
        keep = [f for f in every if f in found or f not in known]
    log = spark.read.schema(schema).option("basePath", path).parquet(*keep) if keep else spark.createDataFrame([], schema)
    return Found(log, len(keep), len(every))
