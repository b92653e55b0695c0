"""Time bucket expressions on whole seconds since the epoch."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def instant(moment: datetime) -> Column:
    """A wall-clock moment in the session time zone (independent of the driver's own zone)."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp")


def slot_start(ts: str | Column, minutes: int) -> Column:
    seconds = F.unix_seconds(F.col(ts) if isinstance(ts, str) else ts)
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(minutes * 60)))


def hour_label(ts: str = "event_ts") -> Column:
    return F.date_format(ts, "HH")


def slot_label(ts: str | Column, with_seconds: bool = False) -> Column:
    return F.date_format(ts, "HH:mm:ss" if with_seconds else "HH:mm")
