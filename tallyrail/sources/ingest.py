"""From raw database rows to the logical tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrail.schemas import blanks_to_null, require_columns, with_timestamp

LOG_TIMES = {"event_ts": ("trx_dt", "trx_tm"), "reg_ts": ("trx_dt", "reg_tm")}
FEED_TIMES = {"event_ts": ("feed_dt", "feed_tm")}


def to_table(raw: DataFrame, schema: T.StructType, times: Mapping[str, tuple[str, str]] | None = None,
             names: Mapping[str, str] | None = None) -> DataFrame:
    """Raw rows in the columns and types of a logical table.

    `names` maps raw column names (any case) to logical ones, `times` builds timestamps from a date and an
    `HH:mm:ss` text column. Blank text becomes NULL; other text, payloads too, is kept to the last blank.
    """
    df = _renamed(raw, names)
    for name, (day, time) in (times or {}).items():
        df = with_timestamp(require_columns(df, [day, time]), name, day, time)
    require_columns(df, schema.fieldNames())
    typed = df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    return blanks_to_null(typed, [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)])


def rejected_times(raw: DataFrame, times: Mapping[str, tuple[str, str]], names: Mapping[str, str] | None = None) -> DataFrame:
    """Rows per day whose time text does not give a time, by timestamp: they keep a NULL time and fall out of windows."""
    df = _renamed(raw, names)
    for name, (day, time) in times.items():
        df = with_timestamp(require_columns(df, [day, time]), name, day, time)
    days = {day for day, _ in times.values()}
    if len(days) != 1:
        raise ValueError("the times must be of one day column")
    return df.groupBy(*days).agg(*[F.count(F.when(F.col(n).isNull(), 1)).alias(n) for n in times])


def _renamed(raw: DataFrame, names: Mapping[str, str] | None) -> DataFrame:
    names = {k.lower(): to for k, to in (names or {}).items()}
    return raw.select([F.col(f"`{c}`").alias(names.get(c.lower(), c.lower())) for c in raw.columns])
