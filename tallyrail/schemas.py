"""Logical tables and ingestion normalisation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _TS, _I = T.StringType(), T.DateType(), T.TimestampType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


INBOUND_LOG = _struct(
    trx_dt=_D, event_ts=_TS, reg_ts=_TS, switch_id=_S, bsns_cd=_S, io_cd=_S, trx_cd=_S, svc_cd=_S,
    resp_cd=_S, trc_ad_no=_S, ret_ref_no=_S, log_data=_S)
OUTBOUND_LOG = _struct(
    trx_dt=_D, event_ts=_TS, reg_ts=_TS, switch_id=_S, bsns_cd=_S, trx_cd=_S, resp_cd=_S, resp_val=_S,
    trc_ad_no=_S, ret_ref_no=_S, i_log_data=_S, o_log_data=_S)
CATALOG = _struct(cnts_nm=_S, cnts_1=_S, cnts_2=_S, cnts_3=_S, cnts_4=_S, cnts_5=_S)
RECORD_LAYOUT = _struct(map_id=_S, inout_cd=_S, seq_no=_I, field_nm=_S, field_len=_I)
PRICE_FEED = _struct(feed_dt=_D, event_ts=_TS, ric=_S)
CARD_TXN = _struct(
    trx_dt=_D, merchant_name=_S, location=_S, merchant_tp=_S, trx_amount=T.DecimalType(18, 2), onoff=_S)
CODE_TABLE = _struct(type=_S, code=_S, code_nm=_S, code1=_S)
CHANNEL_RANK = _struct(switch_id=_S, bsns_cd=_S, rank=_I)
MESSAGE_FAMILY = _struct(trx_cd=_S, family=_S)
CODE_TITLE = _struct(code=_S, title=_S)
ALERT_RULE = _struct(switch_id=_S, since=_S, until=_S, max_rate=_I)
CHANNEL_LABEL = _struct(switch_id=_S, bsns_cd=_S, label=_S)


def literal_table(spark: SparkSession, rows: Iterable[tuple], schema: T.StructType) -> DataFrame:
    """A small table from literal rows, made on the JVM and with a known size, so joins broadcast it."""
    structs = [F.struct(*[F.lit(value).cast(f.dataType).alias(f.name) for value, f in zip(row, schema)])
               for row in rows]
    table = F.array(*structs).cast(T.ArrayType(schema))
    return spark.range(0, 1, 1, 1).select(F.inline(table))


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def blanks_to_null(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Blank text becomes NULL, so that null tests and null-safe compares see one kind of missing."""
    return df.withColumns({c: F.when(F.trim(c) != "", F.col(c)) for c in columns})


def with_timestamp(df: DataFrame, name: str, day: str, time: str) -> DataFrame:
    """Join a date column and an `HH:mm:ss` text column into one timestamp (midnight-safe)."""
    text = F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), F.col(time))
    return df.withColumn(name, F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))
