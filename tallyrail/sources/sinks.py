"""Report writers: JSON objects, JSON value rows with metadata, CSV, and the partitioned log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrail.functions.text import amount_text
from tallyrail.session import settings

#: Times as whole numbers. In Parquet's older form, which Spark writes by itself, times have no statistics and no filter skips anything.
COMPARABLE_TIMES = {"spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS"}


def write_json_objects(df: DataFrame, path: str, names: Mapping[str, str] | None = None,
                       amounts: Sequence[str] = ()) -> None:
    """One JSON object per row; `names` maps columns to output keys. NULL values are kept.

    Columns in `amounts` are written as display text.
    """
    names = names or {c: c for c in df.columns}
    out = df.select([(amount_text(c) if c in amounts else F.col(c)).alias(key)
                     for c, key in names.items()])
    out.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_json_rows(df: DataFrame, path: str) -> None:
    """Value rows under `rows/` (one JSON array per line) and column names under `metaData/`."""
    values = F.to_json(F.array([F.col(c).cast("variant") for c in df.columns]))
    df.select(values.alias("value")).write.mode("overwrite").text(f"{path}/rows")
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "name string")
    names.coalesce(1).write.mode("overwrite").json(f"{path}/metaData")


def write_csv(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.mode("overwrite").option("header", str(header).lower()).csv(path)


def write_log(log: DataFrame, path: str, by: Sequence[str] = ("trx_dt",), mode: str = "append",
              cluster: Sequence[str] = ("event_ts",), lookups: Sequence[str] = ("ret_ref_no",)) -> None:
    """Store a log partitioned by business day and, inside a day, in the order of time.

    Partition the inbound log by ("trx_dt", "io_cd"): a report over both legs then reads each leg's files once.
    Rows are dealt by ranges of (`by`, `cluster`) and sorted by them, so the statistics of row groups and pages tell a lookback which
    few to read, instead of all of a day; rows of one instant are told apart by a hash, so that a burst is split as well. AQE merges
    ranges that stay small. Columns in `lookups` get Parquet Bloom filters: a search for one value skips row groups without it.
    """
    order = [*by, *(c for c in cluster if c in log.columns)]
    tie = F.xxhash64(*[F.col(f"`{f.name}`") for f in log.schema.fields if f.dataType.typeName() not in ("map", "variant")])
    rows = log.repartitionByRange(*order, tie).sortWithinPartitions(*order)
    writer = rows.write.mode(mode).partitionBy(*by).option("parquet.bloom.filter.adaptive.enabled", "true")
    for column in lookups:
        if column in log.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    with settings(log.sparkSession, COMPARABLE_TIMES):
        writer.parquet(path)
