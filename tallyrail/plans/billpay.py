"""Bill-payment reports by catalogued product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrail import config
from tallyrail.functions.codes import is_error, is_service_error
from tallyrail.functions.rates import n_rows, round_pct
from tallyrail.functions.text import field
from tallyrail.functions.timeaxis import hour_label
from tallyrail.operators.dims import catalog_rows
from tallyrail.operators.digest import digest, with_digest_rank
from tallyrail.operators.legs import (
    KEYS_4, approval_measures, pair_counts, pair_sums, requests, responses)
from tallyrail.plans.channels import with_two_rates


def products(catalog: DataFrame, name: str = config.BILLPAY_CATALOG) -> DataFrame:
    return catalog_rows(catalog, name).select(
        F.col("cnts_2").alias("product_cd"), F.col("cnts_4").alias("product"))


def _bill_requests(inbound: DataFrame, channels: Sequence[str], codes: Sequence[str]) -> DataFrame:
    return requests(inbound).where(
        F.col("switch_id").isin(list(channels)) & F.col("trx_cd").isin(list(codes)))


def billpay_monitor(inbound: DataFrame, catalog: DataFrame,
                    channels: Sequence[str] = config.BILLPAY_CHANNELS,
                    codes: Sequence[str] = config.BILLPAY_PAYMENTS,
                    product_field: tuple[int, int] = config.PRODUCT_FIELD) -> DataFrame:
    """Payments of every product and day, with the rounded approval percent.

    Requests are counted per payload field first; the catalog joins the counts, not the log.
    """
    asked = _bill_requests(inbound, channels, codes).withColumn(
        "product_cd", field("log_data", *product_field))
    sums = pair_sums(asked, responses(inbound), KEYS_4, ["trx_dt", "product_cd"], approval_measures())
    named = sums.join(products(catalog), ["product_cd"]).groupBy("trx_dt", "product").agg(
        F.sum("approve").alias("approve"), F.sum("tot").alias("tot"))
    return (named.withColumn("rate", round_pct(F.col("approve"), F.col("tot")))
            .orderBy("trx_dt", F.desc("tot"), "product"))


def payment_type(inquiries: Sequence[str]) -> Column:
    return F.when(F.col("trx_cd").isin(list(inquiries)), "Inquiry").otherwise("Payment/Purchase")


def payload_counts(inbound: DataFrame, catalog: DataFrame,
                   channels: Sequence[str] = config.BILLPAY_CHANNELS,
                   payments: Sequence[str] = config.BILLPAY_PAYMENTS,
                   inquiries: Sequence[str] = config.BILLPAY_INQUIRIES,
                   product_field: tuple[int, int] = config.PRODUCT_FIELD) -> DataFrame:
    """Distinct payloads per day, channel, message code, product and response.

    Payloads are compared by SHA-256, which keeps long texts out of the shuffles. A request meets each
    response code of its key once. Both sides of the join sit directly on their exchange, so AQE can
    split a hot key's requests over tasks.
    """
    group = ["trx_dt", "switch_id", "bsns_cd", "trx_cd", "product_cd"]
    asked = (_bill_requests(inbound, channels, [*payments, *inquiries])
             .withColumn("product_cd", field("log_data", *product_field))
             .withColumn("_payload", F.unhex(F.sha2("log_data", 256)))
             .select(*KEYS_4, "bsns_cd", "trx_cd", "product_cd", "_payload"))
    answered = responses(inbound).select(*KEYS_4, "resp_cd").distinct()
    found = (asked.join(answered, list(KEYS_4)).select(*group, "resp_cd", "_payload").distinct()
             .groupBy(*group, "resp_cd").agg(n_rows().alias("n")))
    return found.join(products(catalog), ["product_cd"])


def billpay_report(counts: DataFrame, inquiries: Sequence[str] = config.BILLPAY_INQUIRIES,
                   customer_codes: Sequence[str] = config.CUSTOMER_CODES) -> DataFrame:
    """Distinct-payload volume, both rates and error digest per channel, type and product."""
    by = ["trx_dt", "switch_id", "bsns_cd", "trx_type", "product"]
    per_code = counts.withColumn("trx_type", payment_type(inquiries)).groupBy(*by, "resp_cd").agg(
        F.sum("n").alias("n"))
    n = F.col("n")
    sums = with_digest_rank(per_code, by).groupBy(*by).agg(
        F.sum("n").alias("volume"),
        F.coalesce(F.sum(F.when(is_error(), n)), F.lit(0)).alias("errors"),
        F.coalesce(F.sum(F.when(is_service_error(customer_codes=customer_codes), n)), F.lit(0))
        .alias("service_errors"),
        digest().alias("error_codes"))
    return with_two_rates(sums)


def product_hours(inbound: DataFrame, catalog: DataFrame, product_cd: str,
                  channels: Sequence[str] = config.BILLPAY_CHANNELS,
                  payments: Sequence[str] = config.BILLPAY_PAYMENTS,
                  inquiries: Sequence[str] = config.BILLPAY_INQUIRIES,
                  product_field: tuple[int, int] = config.PRODUCT_FIELD) -> DataFrame:
    """Pairs of one product per hour, type and response; put it on an hour spine for the chart."""
    asked = (_bill_requests(inbound, channels, [*payments, *inquiries])
             .withColumn("product_cd", field("log_data", *product_field))
             .where(F.col("product_cd") == product_cd)
             .withColumn("trx_type", payment_type(inquiries))
             .withColumn("hour", hour_label()))
    counts = pair_counts(asked, responses(inbound), KEYS_4, ["trx_dt", "hour", "trx_type", "product_cd"])
    return counts.join(products(catalog), ["product_cd"])
