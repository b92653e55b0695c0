"""Tumbling-window volume and approval on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrail.functions.rates import floor_pct
from tallyrail.operators.legs import approval_measures, counted


def window_paired(paired: DataFrame, width: str, by: Sequence[str] = ()) -> DataFrame:
    """Windowed sums of a paired stream (`pair_stream`), by request time."""
    sums = paired.groupBy(F.window("request_ts", width).alias("_w"), *by).agg(
        F.sum("approve").alias("approve"), F.sum("tot").alias("tot"))
    return _with_rate(sums, by)


def window_calls(calls: DataFrame, width: str, by: Sequence[str] = (), delay: str = "210 seconds",
                 ts: str = "event_ts") -> DataFrame:
    """Windowed counts of an outbound stream."""
    counts = calls.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("_w"), *by).agg(
        *counted(approval_measures()))
    return _with_rate(counts, by)


def throughput_stream(paired: DataFrame, calls: DataFrame, width: str = "10 seconds",
                      delay: str = "210 seconds", ts: str = "event_ts") -> DataFrame:
    """Both directions per window; rows later than the settle delay are left out, as in the live reading."""
    inc = window_paired(paired, width).withColumn("direction", F.lit("INC"))
    out = window_calls(calls, width, (), delay, ts).withColumn("direction", F.lit("OUT"))
    return inc.unionByName(out)


def _with_rate(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    return sums.select(F.col("_w.start").alias("window_start"), *by, "approve", "tot",
                       floor_pct(F.col("approve"), F.col("tot")).alias("rate"))
