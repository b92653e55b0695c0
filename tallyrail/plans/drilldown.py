"""Hourly details of one channel, code or product, and transaction detail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrail import config
from tallyrail.functions.rates import n_rows
from tallyrail.functions.timeaxis import hour_label
from tallyrail.operators.legs import KEYS_5, pair_counts, requests, responses
from tallyrail.operators.payload import field_places, known_places, layout_extract
from tallyrail.operators.spine import hour_spine, on_spine

HOUR = ("trx_dt", "hour")


def hourly_codes(inbound: DataFrame, channel: str, trx_cd: str | None = None) -> DataFrame:
    """Answered requests of one channel per hour, code and response."""
    asked = requests(inbound).where(
        (F.col("switch_id") == channel) & (F.col("bsns_cd") != config.ODS))
    if trx_cd is not None:
        asked = asked.where(F.col("trx_cd") == trx_cd)
    return pair_counts(asked.withColumn("hour", hour_label()), responses(inbound), KEYS_5,
                       [*HOUR, "trx_cd"])


def hourly_detail(inbound: DataFrame, days: DataFrame, channel: str, trx_cd: str) -> DataFrame:
    """All hours of each day with the counts of one code; hours without messages show NULLs."""
    return on_spine(hour_spine(days), hourly_codes(inbound, channel, trx_cd), HOUR)


def hourly_channel(inbound: DataFrame, outbound: DataFrame, days: DataFrame, channel: str,
                   exclude: Sequence[str] = config.NON_FINANCIAL, exclude_text: str = "LOG") -> DataFrame:
    """All hours of each day with every code of a channel, inbound and outbound."""
    wanted = ~F.col("trx_cd").isin(list(exclude)) & ~F.col("trx_cd").contains(exclude_text)
    inc = hourly_codes(inbound.where(wanted | (F.col("io_cd") == "O")), channel).withColumn(
        "direction", F.lit("INC"))
    out = (outbound.where((F.col("switch_id") == channel) & wanted)
           .withColumn("hour", hour_label())
           .groupBy(*HOUR, "trx_cd", "resp_cd").agg(n_rows().alias("n"))
           .withColumn("direction", F.lit("OUT")))
    return on_spine(hour_spine(days), inc.unionByName(out), HOUR)


def hourly_pivot(hourly: DataFrame, codes: Sequence[str]) -> DataFrame:
    """One column per response code and one row per hour; a code without messages is NULL."""
    return hourly.groupBy(*HOUR).pivot("resp_cd", list(codes)).agg(F.sum("n"))


def correlated(log: DataFrame, switch_id: str, trc_ad_no: str, ret_ref_no: str) -> DataFrame:
    """The rows of one transaction."""
    return log.where((F.col("switch_id") == switch_id) & (F.col("trc_ad_no") == trc_ad_no)
                     & (F.col("ret_ref_no") == ret_ref_no))


def transaction_detail(inbound: DataFrame, outbound: DataFrame, offsets: DataFrame,
                       scale: int = 0) -> DataFrame:
    """Currency and amount of request legs and outbound calls, decoded by each message's own layout.

    Give it logs narrowed to one transaction (`correlated`), or whole logs.
    """
    places = known_places(field_places(offsets))
    columns = ["switch_id", "ccy", "amt", "trx_dt", "event_ts", "ret_ref_no", "trx_cd", "bsns_cd",
               "resp_cd"]
    inc = layout_extract(requests(inbound), places, "log_data", scale).select(columns)
    out = layout_extract(outbound, places, "i_log_data", scale).withColumns({
        "ccy": F.coalesce("ccy", F.lit(" ")),
        "amt": F.coalesce("amt", F.lit(0).cast("decimal(18,2)"))}).select(columns)
    return inc.unionByName(out)
