"""Counts in consecutive short windows that ended a settle lag ago."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrail import config
from tallyrail.functions.rates import floor_pct
from tallyrail.functions.timeaxis import MICROS, instant
from tallyrail.operators.legs import KEYS_5, answers_to, approval_measures, counted, pair_sums, requests, responses
from tallyrail.operators.spine import on_spine, with_keys
from tallyrail.sources.readers import lagged_window

DIRECTIONS = ("INC", "OUT")


def with_window_no(log: DataFrame, as_of: datetime, lag: int, width: int, windows: int,
                   ts: str = "reg_ts", inclusive: bool = False, day: str | None = "trx_dt") -> DataFrame:
    """Number each row's window; window 0 ended `lag` seconds before `as_of`, window k `k` widths earlier.

    Windows are half-open. With `inclusive`, a row on a boundary belongs to both neighbours.
    """
    rows = lagged_window(log, as_of, lag, width * windows, ts, inclusive, day)
    age = F.unix_micros(instant(as_of)) - lag * MICROS - F.unix_micros(F.col(ts))
    size = F.lit(width * MICROS)
    newest = _div(age - 1, size)
    numbers = F.sequence(newest, _div(age, size)) if inclusive else F.array(newest)
    return (rows.withColumn("window_no", F.explode(numbers))
            .where(F.col("window_no").between(0, windows - 1)))


def throughput(inbound: DataFrame, outbound: DataFrame, as_of: datetime, lag: int = 210, width: int = 10,
               windows: int = 1, inclusive: bool = False, ts: str = "reg_ts", live: bool = False,
               settle: int | None = None) -> DataFrame:
    """Paired inbound and raw outbound counts per window; empty windows count zero.

    `live` narrows the responses by the keys of the windows' requests before they are counted (`answers_to`). `settle` says that no response
    comes earlier than its request or more than so many seconds later: the responses are then read by time as well. Without it any
    response of the day counts.

    One window is the live reading, eleven (with lag 220) the dashboard's strip; all windows come from
    one read of each log leg.
    """
    def numbered(log: DataFrame) -> DataFrame:
        return with_window_no(log, as_of, lag, width, windows, ts, inclusive)

    asked = numbered(requests(inbound).where(F.col("bsns_cd") != config.ODS))
    answered = responses(inbound)
    if settle is not None:
        answered = lagged_window(answered, as_of, lag - settle, width * windows + settle, ts, True)
    if live:
        answered = answers_to(asked, answered, KEYS_5)
    inc = pair_sums(asked, answered, KEYS_5, ["window_no"], approval_measures())
    out = numbered(outbound).groupBy("window_no").agg(
        *counted(approval_measures()))
    facts = inc.withColumn("direction", F.lit("INC")).unionByName(out.withColumn("direction", F.lit("OUT")))
    axis = with_keys(inbound.sparkSession.range(windows).withColumnRenamed("id", "window_no"),
                     "direction", DIRECTIONS)
    shown = instant(as_of) - F.make_dt_interval(secs=F.col("window_no") * width)
    return (on_spine(axis, facts, ["window_no", "direction"], ["approve", "tot"])
            .withColumn("label_ts", shown)
            .withColumn("rate", floor_pct(F.col("approve"), F.col("tot"))))


def rolling_strip(samples: DataFrame, length: int = 11) -> DataFrame:
    """What a strip of the last `length` samples shows after each sample, oldest first.

    Every sample is sent to the strips it appears in, so strips are built in parallel, without one
    ordered pass over the whole series.
    """
    first = F.greatest(F.col("window_no") - (length - 1), F.lit(0).cast("bigint"))
    shown = samples.withColumn("strip_no", F.explode(F.sequence(first, F.col("window_no"))))
    cells = F.sort_array(F.collect_list(F.struct("window_no", "tot")), asc=False)
    return shown.groupBy("direction", "strip_no").agg(
        F.max("label_ts").alias("label_ts"),
        F.sum("approve").alias("approve"),
        F.sum("tot").alias("tot"),
        F.array_join(F.transform(cells, lambda cell: cell["tot"].cast("string")), ",").alias("samples"))


def _div(value: Column, size: Column) -> Column:
    """Whole-number division, rounded down."""
    return ((value - F.pmod(value, size)) / size).cast("bigint")
