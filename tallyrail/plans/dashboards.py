"""Dashboard readings: slot series, health rings, terminal scores, feed heartbeat."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrail import config
from tallyrail.config import ChannelRule
from tallyrail.functions.codes import binary_resp_code, decode_values, in_channels, is_approved
from tallyrail.functions.rates import floor_pct, round_pct
from tallyrail.functions.text import field
from tallyrail.operators.legs import (
    KEYS_3, KEYS_4, KEYS_5, answers_to, approval_measures, counted, pair_counts, pair_sums, pair_sums_by_key,
    requests, responses)
from tallyrail.operators.spine import (
    minute_spine, on_spine, polls_at, seen_at, seen_every, with_keys, with_slot)
from tallyrail.sources.readers import between, lookback

SLOT = ("slot_ts", "on_start", "switch_id")
COUNTS = ("approve", "tot")


def inbound_slots(log: DataFrame, keys: Sequence[str] = KEYS_3, exclude_trx: Sequence[str] = (),
                  exclude_resp: Sequence[str] = (), exclude_bsns: Sequence[str] = (),
                  exclude_response_trx: Sequence[str] = (), as_of: datetime | None = None,
                  minutes: int = 60, step: int = 5, settle: int | None = None) -> DataFrame:
    """Answered requests per slot and channel; with `as_of`, of the requests one poll looks back on.

    `settle` says that a response comes at most so many seconds after its request; a poll then reads the responses by time as well.
    """
    asked, answered = requests(log), responses(log)
    if as_of is not None:
        asked = lookback(asked, as_of, minutes)
    if exclude_trx:
        asked = asked.where(~F.col("trx_cd").isin(list(exclude_trx)))
    if exclude_bsns:
        asked = asked.where(~F.col("bsns_cd").isin(list(exclude_bsns)))
    if exclude_resp:
        answered = answered.where(~F.col("resp_cd").isin(list(exclude_resp)))
    if exclude_response_trx:
        answered = answered.where(~F.col("trx_cd").isin(list(exclude_response_trx)))
    if as_of is not None:
        if settle is not None:
            answered = between(answered, as_of - timedelta(minutes=minutes), as_of + timedelta(seconds=settle), "event_ts")
        answered = answers_to(asked, answered, keys)
    return pair_sums(with_slot(asked, step), answered, keys, SLOT, approval_measures())


def outbound_slots(outbound: DataFrame, exclude_trx: Sequence[str] = (), only_trx: Sequence[str] = (),
                   as_of: datetime | None = None, minutes: int = 60, step: int = 5) -> DataFrame:
    """Outbound calls per slot and channel; every code but the approved one is a failure."""
    calls = outbound if as_of is None else lookback(outbound, as_of, minutes)
    if exclude_trx:
        calls = calls.where(~F.col("trx_cd").isin(list(exclude_trx)))
    if only_trx:
        calls = calls.where(F.col("trx_cd").isin(list(only_trx)))
    coded = with_slot(calls, step).withColumn("resp_cd", binary_resp_code())
    return coded.groupBy(*SLOT).agg(*counted(approval_measures()))


def both_slots(inbound_facts: DataFrame, outbound_facts: DataFrame) -> DataFrame:
    return inbound_facts.unionByName(outbound_facts).groupBy(*SLOT).agg(
        *[F.sum(c).alias(c) for c in COUNTS])


def live_series(facts: DataFrame, as_of: datetime, channels: Sequence[str], minutes: int = 60,
                step: int = 5) -> DataFrame:
    """The series of one poll: every slot of the listed channels with its approval percent."""
    spine = minute_spine(polls_at(facts.sparkSession, as_of), minutes, step)
    return _series(seen_at(facts, as_of, ["switch_id"], COUNTS), spine, channels)


def replayed_series(facts: DataFrame, polls: DataFrame, every: int, channels: Sequence[str],
                    minutes: int = 60, step: int = 5) -> DataFrame:
    """The series of every regular poll."""
    spine = minute_spine(polls, minutes, step)
    return _series(seen_every(facts, every, ["switch_id"], COUNTS, minutes, step), spine, channels)


def _series(seen: DataFrame, spine: DataFrame, channels: Sequence[str]) -> DataFrame:
    series = on_spine(with_keys(spine, "switch_id", channels), seen, ["poll_ts", "slot_ts", "switch_id"],
                      COUNTS)
    return series.withColumn("rate", floor_pct(F.col("approve"), F.col("tot")))


def feed_slots(feed: DataFrame, as_of: datetime | None = None, minutes: int = 60, step: int = 5) -> DataFrame:
    """Price-feed rows per slot; rows without an instrument do not count."""
    rows = feed if as_of is None else lookback(feed, as_of, minutes, day="feed_dt")
    return with_slot(rows, step).groupBy("slot_ts", "on_start").agg(
        F.count("ric").alias("tot"))


def live_heartbeat(facts: DataFrame, as_of: datetime, minutes: int = 60, step: int = 5) -> DataFrame:
    spine = minute_spine(polls_at(facts.sparkSession, as_of), minutes, step)
    return on_spine(spine, seen_at(facts, as_of, [], ["tot"]), ["poll_ts", "slot_ts"], ["tot"])


def replayed_heartbeat(facts: DataFrame, polls: DataFrame, every: int, minutes: int = 60,
                       step: int = 5) -> DataFrame:
    seen = seen_every(facts, every, [], ["tot"], minutes, step)
    return on_spine(minute_spine(polls, minutes, step), seen, ["poll_ts", "slot_ts"], ["tot"])


def _health(facts: DataFrame, days: DataFrame, channels: Sequence[str]) -> DataFrame:
    ring = on_spine(with_keys(days, "switch_id", channels), facts, ["trx_dt", "switch_id"],
                    ["approve", "tot"])
    tot, approve = F.col("tot"), F.col("approve")
    return (ring.withColumn("failure_rate", round_pct(tot - approve, tot))
            .withColumn("approval_rate", round_pct(approve, tot)))


def outbound_health(outbound: DataFrame, days: DataFrame,
                    rules: Sequence[ChannelRule] = config.HEALTH_OUTBOUND) -> DataFrame:
    """Approved and total calls of each listed channel and day; silent channels show zero."""
    facts = outbound.where(in_channels(rules)).groupBy("trx_dt", "switch_id").agg(
        *counted(approval_measures()))
    return _health(facts, days, [r.switch_id for r in rules])


def inbound_health(inbound: DataFrame, days: DataFrame,
                   rules: Sequence[ChannelRule] = config.HEALTH_INBOUND,
                   exclude_resp: Sequence[str] = config.HEALTH_EXCLUDED_RESPONSES) -> DataFrame:
    listed = inbound.where(F.col("switch_id").isin([r.switch_id for r in rules]))
    facts = pair_sums_by_key(listed, KEYS_5, ["trx_dt", "switch_id"], approval_measures(),
                             asked=in_channels(rules), answered=~F.col("resp_cd").isin(list(exclude_resp)))
    return _health(facts, days, [r.switch_id for r in rules])


def terminal_activity(inbound: DataFrame, channel: str,
                      families: Mapping[str, str] = config.TERMINAL_FAMILIES,
                      exclude_trx: Sequence[str] = config.ADMIN_ATM,
                      terminal_field: tuple[int, int] = config.TERMINAL_FIELD) -> DataFrame:
    """Answered requests of one channel per day, terminal, transaction family and response."""
    prefix = F.substring("trx_cd", 1, 4)
    asked = (requests(inbound)
             .where((F.col("switch_id") == channel) & prefix.isin(list(families))
                    & ~F.col("trx_cd").isin(list(exclude_trx)))
             .withColumn("terminal", field("log_data", *terminal_field))
             .withColumn("family", decode_values(prefix, families)))
    return pair_counts(asked, responses(inbound), KEYS_4, ["trx_dt", "terminal", "family"])


def terminal_score(activity: DataFrame, first: str = "WDL", second: str = "TRF") -> DataFrame:
    """Signed success of two families (approved minus failed, of all messages), in percent up to 100."""
    n = F.col("n")
    signed = F.when(is_approved(), n).otherwise(-n)

    def score(family: str):
        points = F.coalesce(F.sum(F.when(F.col("family") == family, signed)), F.lit(0))
        return F.least(F.lit(100).cast("bigint"), floor_pct(points, F.sum("n")))

    return activity.groupBy("trx_dt", "terminal").agg(
        score(first).alias("x"), score(second).alias("y"), F.sum("n").alias("tot"))
