"""Alert rules over dashboard readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrail import config
from tallyrail.functions.timeaxis import slot_label


def _between_labels(label: Column, hours: tuple[str, str]) -> Column:
    """Text compare, as the dashboards do: `20:00` still lies before `20:00:00`, `08:30` not after it."""
    return (label > hours[0]) & (label < hours[1])


def feed_silent(heartbeat: DataFrame, slot: int = config.ALERT_SLOT,
                hours: tuple[str, str] = config.FEED_HOURS) -> DataFrame:
    """Polls on a working day whose newest complete slot got no feed row."""
    label = slot_label("slot_ts", with_seconds=True)
    return heartbeat.where((F.col("slot_no") == slot) & _between_labels(label, hours)
                           & (F.col("tot") <= 0) & (F.weekday("poll_ts") < 5))


def zero_approval(series: DataFrame, channels: Sequence[str], slot: int = config.ALERT_SLOT,
                  hours: tuple[str, str] = config.SLOT_HOURS) -> DataFrame:
    """Polls whose newest complete slot of a watched channel approved nothing (or was empty)."""
    return series.where((F.col("slot_no") == slot) & F.col("switch_id").isin(list(channels))
                        & _between_labels(slot_label("slot_ts"), hours)
                        & (F.coalesce("rate", F.lit(0)) <= 0))


def failing(health: DataFrame, limit: int = config.FAILURE_LIMIT) -> DataFrame:
    return health.where(F.col("failure_rate") >= limit)
