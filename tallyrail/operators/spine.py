"""Time axes and key lists that keep their empty entries."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrail.functions.timeaxis import MICROS, instant, slot_start


def with_slot(log: DataFrame, step: int = 5, ts: str = "event_ts") -> DataFrame:
    """The slot of each row, and whether the row lies exactly on its start.

    A poll at a slot's start sees of that slot only the rows on the start; `on_start` keeps them apart, so
    that polls can be worked out on slot counts instead of rows.
    """
    return log.withColumn("slot_ts", slot_start(ts, step)).withColumn(
        "on_start", F.col(ts) == F.col("slot_ts"))


def seen_at(facts: DataFrame, as_of: datetime, by: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Slot counts as one poll sees them; the counted rows must be within the poll's lookback."""
    return facts.withColumn("poll_ts", instant(as_of)).groupBy("poll_ts", "slot_ts", *by).agg(
        *[F.sum(c).alias(c) for c in sums])


def seen_every(facts: DataFrame, every: int, by: Sequence[str], sums: Sequence[str], minutes: int = 60,
               step: int = 5) -> DataFrame:
    """Slot counts as each regular poll sees them: a replay of the dashboard over a whole log.

    Only slot counts are copied to the polls that show them, never log rows.
    """
    if every % step or minutes % step or minutes < every:
        raise ValueError("polls and lookback must be whole slots, and the lookback reach the poll before")
    start = F.unix_seconds("slot_ts")
    opens = F.when(F.col("on_start"), start).otherwise(start + step * 60)
    polls = F.sequence(_ceil(opens, every * 60), _floor(start + minutes * 60, every * 60))
    seen = facts.withColumn("_poll", F.explode(polls)).withColumn(
        "poll_ts", F.timestamp_seconds(F.col("_poll") * every * 60))
    return seen.groupBy("poll_ts", "slot_ts", *by).agg(*[F.sum(c).alias(c) for c in sums])


def polls_at(spark: SparkSession, as_of: datetime) -> DataFrame:
    return spark.range(0, 1, 1, 1).select(instant(as_of).alias("poll_ts"))


def polls_every(log: DataFrame, every: int, minutes: int = 60, ts: str = "event_ts") -> DataFrame:
    """All regular polls between the first and the last that see a row of the log."""
    bounds = log.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).where("lo is not null")
    size = every * 60 * MICROS
    first = _ceil(F.unix_micros("lo"), size)
    last = _floor(F.unix_micros("hi") + minutes * 60 * MICROS, size)
    return bounds.select(F.explode(F.sequence(first, last)).alias("_poll")).select(
        F.timestamp_seconds(F.col("_poll") * every * 60).alias("poll_ts"))


def polls_between(spark: SparkSession, first: datetime, last: datetime, every: int, minutes: int = 60) -> DataFrame:
    """All regular polls that see a time between `first` and `last`, without reading a log."""
    size, lookback = every * 60, minutes * 60
    start, end = F.unix_micros(F.lit(first)), F.unix_micros(F.lit(last))
    polls = F.sequence(_ceil(start, size * MICROS), _floor(end + lookback * MICROS, size * MICROS))
    return spark.range(0, 1, 1, 1).select(F.explode(polls).alias("_poll")).select(
        F.timestamp_seconds(F.col("_poll") * size).alias("poll_ts"))


def days_between(spark: SparkSession, first: date, last: date, day: str = "trx_dt") -> DataFrame:
    """Every day between two days, without reading a log."""
    return spark.range(0, 1, 1, 1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias(day))


def _floor(value: Column, size: int) -> Column:
    return ((value - F.pmod(value, F.lit(size))) / size).cast("bigint")


def _ceil(value: Column, size: int) -> Column:
    return ((value + F.pmod(-value, F.lit(size))) / size).cast("bigint")


def minute_spine(polls: DataFrame, minutes: int = 60, step: int = 5) -> DataFrame:
    """Slots of each poll: from the lookback start, floored to ten minutes, in steps of `step`."""
    start = slot_start(F.col("poll_ts") - F.make_dt_interval(mins=F.lit(minutes)), 2 * step)
    slots = F.sequence(start, start + F.make_dt_interval(mins=F.lit(minutes)),
                       F.make_dt_interval(mins=F.lit(step)))
    return polls.select("poll_ts", F.posexplode(slots).alias("slot_no", "slot_ts"))


def day_spine(log: DataFrame, day: str = "trx_dt") -> DataFrame:
    """Every day between the first and the last day of the log."""
    bounds = log.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    return bounds.where("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias(day))


def hour_spine(days: DataFrame) -> DataFrame:
    hours = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.lpad(h.cast("string"), 2, "0"))
    return days.withColumn("hour", F.explode(hours))


def with_keys(spine: DataFrame, name: str, values: Sequence[str]) -> DataFrame:
    """One copy of the spine per listed key, so that a key without rows still shows."""
    return spine.withColumn(name, F.explode(F.array([F.lit(v) for v in values])))


def on_spine(spine: DataFrame, facts: DataFrame, on: Sequence[str],
             counts: Sequence[str] = ()) -> DataFrame:
    """Keep every spine row; `counts` of rows without facts are zero.

    Facts must be aggregated to the spine's grain, so the join moves spine-sized data only.
    """
    joined = spine.join(facts, list(on), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})


def trim_spine(series: DataFrame, head: int = 1, tail: int = 1, minutes: int = 60, step: int = 5) -> DataFrame:
    """Drop the incomplete first and last slots of each series by slot number."""
    return series.where(F.col("slot_no").between(head, minutes // step - tail))
