"""Table readers."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrail.functions.timeaxis import instant


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def jdbc_options(settings: Mapping[str, str], table: str, split_on: str | None = None,
                 lower: str | None = None, upper: str | None = None, parts: int = 1,
                 fetch_size: int = 10_000) -> dict[str, str]:
    """Options of a split JDBC read. URL and secrets come from the caller's configuration only."""
    for key in ("url", "user", "password"):
        if not settings.get(key):
            raise ValueError(f"JDBC setting {key!r} is missing")
    options = {**settings, "dbtable": table, "fetchsize": str(fetch_size)}
    if split_on:
        if lower is None or upper is None or parts < 2:
            raise ValueError("a split read needs lower, upper and at least two parts")
        options.update(partitionColumn=split_on, lowerBound=str(lower), upperBound=str(upper),
                       numPartitions=str(parts))
    return options


def read_jdbc(spark: SparkSession, settings: Mapping[str, str], table: str, **split) -> DataFrame:
    """Read a log table from a database, split over executors on a date or number column."""
    return spark.read.format("jdbc").options(**jdbc_options(settings, table, **split)).load()


def log_with_times(log: DataFrame) -> DataFrame:
    """Zone-less log times as timestamps, so that batch and streaming plans use one type."""
    zoneless = [f.name for f in log.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return log.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else log


def scan_day(log: DataFrame, as_of: datetime, day: str = "trx_dt") -> DataFrame:
    """The rows of one business day; prunes partitions where the table is partitioned by day."""
    return log.where(F.col(day) == F.lit(as_of.date()))


def scan_trailing_days(log: DataFrame, as_of: datetime, days: int, day: str = "trx_dt") -> DataFrame:
    return log.where(F.col(day) >= F.date_sub(F.lit(as_of.date()), days))


def between(log: DataFrame, start: datetime, end: datetime, ts: str, inclusive: bool = True,
            day: str | None = "trx_dt") -> DataFrame:
    """Rows with `start <= ts <= end` (`< end` if not inclusive), as literals the scan can filter by.

    `day` names the business-day column, which prunes partitions. One day of slack is kept at the start:
    a response may come after midnight and still carry its request's day.
    """
    upper = F.col(ts) <= instant(end) if inclusive else F.col(ts) < instant(end)
    rows = log.where((F.col(ts) >= instant(start)) & upper)
    if day is None:
        return rows
    first = (start - timedelta(days=1)).date()
    return rows.where(F.col(day).between(F.lit(first), F.lit(end.date())))


def lookback(log: DataFrame, as_of: datetime, minutes: int, ts: str = "event_ts",
             day: str | None = "trx_dt") -> DataFrame:
    return between(log, as_of - timedelta(minutes=minutes), as_of, ts, day=day)


def lagged_window(log: DataFrame, as_of: datetime, lag_seconds: int, width_seconds: int,
                  ts: str = "reg_ts", inclusive: bool = False, day: str | None = "trx_dt") -> DataFrame:
    """Rows of the window that ended `lag_seconds` ago; `inclusive` also takes its end point."""
    end = as_of - timedelta(seconds=lag_seconds)
    return between(log, end - timedelta(seconds=width_seconds), end, ts, inclusive, day)
