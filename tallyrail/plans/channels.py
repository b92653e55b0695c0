"""Channel reports: volume and success by channel, code and response."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrail import config
from tallyrail.config import ChannelRule
from tallyrail.functions.codes import effective_resp_code, in_channels, is_error, is_service_error
from tallyrail.functions.rates import floor_pct, n_rows
from tallyrail.functions.text import field
from tallyrail.functions.timeaxis import hour_label
from tallyrail.operators.digest import digest, error_code_digest, with_digest_rank
from tallyrail.operators.legs import (
    KEYS_3, KEYS_4, KEYS_5, counted, error_measures, pair_counts, pair_sums, pair_sums_by_key, requests,
    responses)

CHANNEL = ("trx_dt", "switch_id", "bsns_cd")
LEG_ORDER = ("io_cd", "n", "resp_cd")


def with_two_rates(sums: DataFrame) -> DataFrame:
    """`cae`: percent without any error; `sar`: percent without errors the service caused."""
    volume = F.col("volume")
    return (sums.withColumn("cae", floor_pct(volume - F.col("errors"), volume))
            .withColumn("sar", floor_pct(volume - F.col("service_errors"), volume)))


def two_rate_summary(inbound: DataFrame, outbound: DataFrame,
                     inbound_rules: Sequence[ChannelRule] = config.SUMMARY_INBOUND,
                     outbound_rules: Sequence[ChannelRule] = config.SUMMARY_OUTBOUND,
                     customer_codes: Sequence[str] = config.CUSTOMER_CODES,
                     outbound_bsns: str = config.OUTBOUND_BSNS) -> DataFrame:
    """Volume and both success rates per channel: answered inbound requests and outbound calls.

    The inbound grouping is part of the pairing key: one scan and one shuffle on the key pair the legs.
    """
    measures = error_measures(customer_codes=customer_codes)
    listed = inbound.where(F.col("switch_id").isin([r.switch_id for r in inbound_rules]))
    inc = pair_sums_by_key(listed, KEYS_5, CHANNEL, measures, asked=in_channels(inbound_rules))
    out = (outbound.where(in_channels(outbound_rules))
           .select("trx_dt", "switch_id", F.lit(outbound_bsns).alias("bsns_cd"),
                   effective_resp_code().alias("resp_cd"))
           .groupBy(*CHANNEL).agg(*counted(measures)))
    both = inc.unionByName(out).groupBy(*CHANNEL).agg(
        *[F.sum(c).alias(c) for c in ("volume", "errors", "service_errors")])
    return with_two_rates(both)


def leg_counts(inbound: DataFrame, outbound: DataFrame,
               inbound_rules: Sequence[ChannelRule] = config.LEG_MIX_INBOUND,
               outbound_rules: Sequence[ChannelRule] = config.LEG_MIX_OUTBOUND,
               outbound_bsns: str = config.OUTBOUND_BSNS) -> DataFrame:
    """Rows per channel, leg (`I`, `O`, outbound `A`) and response code: one scan per log."""
    columns = [*CHANNEL, "io_cd", "resp_cd"]
    legs = inbound.where(in_channels(inbound_rules)).select(columns)
    calls = (outbound.where(in_channels(outbound_rules))
             .withColumn("bsns_cd", F.lit(outbound_bsns)).withColumn("io_cd", F.lit("A")).select(columns))
    return legs.unionByName(calls).groupBy(*columns).agg(n_rows().alias("n"))


def leg_mix_summary(counts: DataFrame) -> DataFrame:
    """Volume from request legs and calls, errors from response legs and calls, with an error digest."""
    leg, n = F.col("io_cd"), F.col("n")
    failed = leg.isin("O", "A") & is_error()
    ranked = with_digest_rank(counts, CHANNEL, LEG_ORDER, only=leg.isin("O", "A"))
    sums = ranked.groupBy(*CHANNEL).agg(
        F.coalesce(F.sum(F.when(leg.isin("I", "A"), n)), F.lit(0)).alias("volume"),
        F.coalesce(F.sum(F.when(failed, n)), F.lit(0)).alias("errors"),
        digest().alias("error_codes"))
    return sums.withColumn("success_rate", floor_pct(F.col("volume") - F.col("errors"), F.col("volume")))


def leg_digest(counts: DataFrame) -> DataFrame:
    return error_code_digest(counts, CHANNEL, LEG_ORDER, only=F.col("io_cd").isin("O", "A"))


def active_channels(inbound: DataFrame, outbound: DataFrame,
                    inbound_rules: Sequence[ChannelRule] = config.ACTIVE_INBOUND,
                    outbound_rules: Sequence[ChannelRule] = config.ACTIVE_OUTBOUND,
                    outbound_bsns: str = config.OUTBOUND_BSNS) -> DataFrame:
    inc = inbound.where(in_channels(inbound_rules)).select(*CHANNEL)
    out = outbound.where(in_channels(outbound_rules)).select(
        "trx_dt", "switch_id", F.lit(outbound_bsns).alias("bsns_cd"))
    return inc.unionByName(out).distinct()


def catalog_counts(inbound: DataFrame, outbound: DataFrame, catalog: DataFrame,
                   split_channels: Sequence[str], outbound_feeds: Mapping[str, Sequence[str]],
                   outbound_field: tuple[int, int] = config.OUTBOUND_BSNS_FIELD,
                   outbound_prefix: str = config.OUTBOUND_FEED_PREFIX,
                   request_coded: Mapping[str, Sequence[str]] | None = None,
                   strict_channels: Sequence[str] = (),
                   single_bsns: str = config.OUTBOUND_BSNS, *, days: tuple[date, date]) -> DataFrame:
    """Answered messages per day, catalogued code and response; codes unused on a day are kept with a zero.

    `days` are the first and last day of the report. Only catalogued requests are paired, and each leg is read once.

    `split_channels` report their business codes apart, the others under `single_bsns`. `outbound_feeds`
    adds the calls of other channels to a channel, with the business code taken from the response payload.
    Messages in `request_coded` (channel -> codes) are paired on three keys and counted by the code on the
    request leg. `strict_channels` need equal business codes on both legs and leave out `ODS`. Rows without
    a response code count zero.
    """
    used = ["trx_dt", "switch_id", "bsns_cd", "trx_cd"]
    listed = catalog.select(F.col("cnts_5").alias("switch_id"), F.col("cnts_1").alias("trx_cd")).distinct()
    strict = F.col("switch_id").isin(list(strict_channels))
    coded = request_coded or {}
    by_request = F.lit(False)
    for channel, codes in coded.items():
        by_request = by_request | (
            (F.col("switch_id") == channel) & F.coalesce(F.col("trx_cd").isin(list(codes)), F.lit(False)))

    # A leg's key beyond channel and trace: usually the reference, and where both legs need it the business code. A
    # request that is paired on three keys has neither, and so has a second copy of its channel's responses.
    usual = F.struct(F.lit(False).alias("short"), F.col("ret_ref_no").alias("ref"),
                     F.when(strict, F.col("bsns_cd")).otherwise(F.lit("")).alias("own"))
    short = F.struct(F.lit(True).alias("short"), F.lit("").alias("ref"), F.lit("").alias("own"))
    asked = (requests(inbound).join(listed, ["switch_id", "trx_cd"], "left_semi")
             .where(by_request | ~strict | (F.col("bsns_cd") != config.ODS))
             .withColumn("_key", F.when(by_request, short).otherwise(usual)))
    ways = F.when(F.col("switch_id").isin(list(coded)), F.array(usual, short)).otherwise(F.array(usual))
    answered = (responses(inbound).join(listed.select("switch_id").distinct(), ["switch_id"], "left_semi")
                .withColumn("_key", F.explode(ways)))
    keys = [*KEYS_3, "_short", "_ref", "_own"]
    asked, answered = (leg.withColumns({f"_{k}": F.col(f"_key.{k}") for k in ("short", "ref", "own")})
                       for leg in (asked, answered))
    asked = asked.withColumn("_asked_code", F.when(by_request, F.col("resp_cd")))
    paired = pair_counts(asked, answered, keys, [*used, "_short", "_asked_code"])
    code = F.when(F.col("_short"), F.col("_asked_code")).otherwise(F.col("resp_cd"))
    parts = [paired.select(*used, code.alias("resp_cd"), "n")]
    for channel, feeds in outbound_feeds.items():
        calls = outbound.where(F.col("switch_id").isin(list(feeds))
                               & F.col("trx_cd").startswith(outbound_prefix))
        calls = calls.select("trx_dt", F.lit(channel).alias("switch_id"),
                             field("o_log_data", *outbound_field).alias("bsns_cd"), "trx_cd", "resp_cd")
        parts.append(calls.groupBy(*used, "resp_cd").agg(n_rows().alias("n")))

    split = F.col("switch_id").isin(list(split_channels))
    facts = (reduce(DataFrame.unionByName, parts)
             .withColumn("bsns_cd", F.when(split, F.col("bsns_cd")).otherwise(F.lit(single_bsns)))
             .groupBy(*used, "resp_cd").agg(F.sum("n").alias("n")))
    every_day = listed.withColumn("trx_dt", F.explode(F.sequence(*[F.lit(d) for d in days])))
    return every_day.join(facts, ["trx_dt", "switch_id", "trx_cd"], "left").select(
        "trx_dt", "switch_id",
        F.when(split, F.col("bsns_cd")).otherwise(F.lit(single_bsns)).alias("bsns_cd"),
        "trx_cd", "resp_cd",
        F.when(F.col("resp_cd").isNull(), F.lit(0)).otherwise(F.col("n")).alias("n"))


CODE = ("trx_dt", "switch_id", "bsns_cd", "trx_cd")


def catalog_coverage(counts: DataFrame) -> DataFrame:
    """Volume, success percent and error digest of every catalogued code; no rate for unused codes."""
    ranked = with_digest_rank(counts, CODE)
    sums = ranked.groupBy(*CODE).agg(*_code_sums(), digest().alias("error_codes"))
    return sums.withColumn("success_rate", floor_pct(F.col("volume") - F.col("errors"), F.col("volume")))


def catalog_two_rate(counts: DataFrame,
                     customer_codes: Sequence[str] = config.CUSTOMER_CODES) -> DataFrame:
    wrong = F.col("resp_cd").isNotNull() & is_service_error(customer_codes=customer_codes)
    return with_two_rates(counts.groupBy(*CODE).agg(
        *_code_sums(), F.coalesce(F.sum(F.when(wrong, F.col("n"))), F.lit(0)).alias("service_errors")))


def _code_sums() -> tuple[Column, Column]:
    wrong = F.col("resp_cd").isNotNull() & is_error()
    return (F.sum("n").alias("volume"),
            F.coalesce(F.sum(F.when(wrong, F.col("n"))), F.lit(0)).alias("errors"))


@dataclass(frozen=True)
class Segment:
    """A part of one channel's requests, by message prefix or by a payload country."""

    name: str
    switch_id: str
    prefix: str | None = None
    home: bool | None = None


# Card report segments.
CARD_SEGMENTS = (
    Segment("RNTS", "RNTS", prefix=config.CARD_PREFIX),
    Segment("BRSM", "BRSM", prefix=config.CARD_PREFIX),
    Segment("VISA LOCAL", "ARON", home=True),
    Segment("VISA OVERSEAS", "ARON", home=False),
)


def with_segment(legs: DataFrame, segments: Sequence[Segment],
                 country_field: tuple[int, int] = config.COUNTRY_FIELD,
                 home_country: str = config.HOME_COUNTRY) -> DataFrame:
    """Requests that fall into a segment, with its name; one pass for all segments.

    A request outside every segment, or too short to hold a country, is left out.
    """
    country = field("log_data", *country_field)
    name: Column = F.lit(None).cast("string")
    for s in reversed(segments):
        test = F.col("switch_id") == s.switch_id
        if s.prefix is not None:
            test = test & F.col("trx_cd").startswith(s.prefix)
        if s.home is not None:
            test = test & ((country == home_country) if s.home else (country != home_country))
        name = F.when(test, F.lit(s.name)).otherwise(name)
    switches = sorted({s.switch_id for s in segments})
    return (legs.where(F.col("switch_id").isin(switches)).withColumn("segment", name)
            .where(F.col("segment").isNotNull()))


def card_segments(inbound: DataFrame, segments: Sequence[Segment] = CARD_SEGMENTS,
                  country_field: tuple[int, int] = config.COUNTRY_FIELD,
                  customer_codes: Sequence[str] = config.CUSTOMER_CODES) -> DataFrame:
    asked = with_segment(requests(inbound), segments, country_field)
    return with_two_rates(pair_sums(asked, responses(inbound), KEYS_5, ["trx_dt", "segment", "bsns_cd"],
                                    error_measures(customer_codes=customer_codes)))


def segment_hours(inbound: DataFrame, segments: Sequence[Segment] = CARD_SEGMENTS,
                  country_field: tuple[int, int] = config.COUNTRY_FIELD) -> DataFrame:
    """Pairs per segment, hour and response; put it on an hour spine for the chart."""
    asked = with_segment(requests(inbound), segments, country_field).withColumn("hour", hour_label())
    return pair_counts(asked, responses(inbound), KEYS_5, ["trx_dt", "hour", "segment", "bsns_cd"])
