"""Request/response pairing, unanswered requests and the unified activity view.

A report never needs the pairs themselves, only counts over them. So both legs are first collapsed per
correlation key (with map-side combine): a key with `n` requests and `m` responses costs one row instead
of `n * m` pairs, and the products of the counts add up to what the plain self-join would count.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrail import config
from tallyrail.functions.codes import is_approved, is_error, is_service_error
from tallyrail.functions.rates import n_rows, n_where
from tallyrail.operators.dims import broadcast_if_small
from tallyrail.sources.bucketed import BucketedLog

KEYS_3 = ("trx_dt", "switch_id", "trc_ad_no")
KEYS_4 = (*KEYS_3, "ret_ref_no")
KEYS_5 = (*KEYS_4, "bsns_cd")


def requests(log: DataFrame) -> DataFrame:
    return log.where(F.col("io_cd") == "I")


def responses(log: DataFrame) -> DataFrame:
    return log.where(F.col("io_cd") == "O")


def approval_measures(code: str | Column = "resp_cd") -> dict[str, Column]:
    """Conditions a response is counted under, by result column."""
    return {"approve": is_approved(code), "tot": F.lit(True)}


def error_measures(code: str | Column = "resp_cd",
                   customer_codes: Sequence[str] = config.CUSTOMER_CODES) -> dict[str, Column]:
    return {
        "volume": F.lit(True),
        "errors": is_error(code),
        "service_errors": is_service_error(code, customer_codes),
    }


def counted(measures: Mapping[str, Column]) -> list[Column]:
    return [n_where(condition).alias(name) for name, condition in measures.items()]


def pair_sums(request_legs: DataFrame, response_legs: DataFrame, keys: Sequence[str], by: Sequence[str],
              measures: Mapping[str, Column], by_response: Sequence[str] = ()) -> DataFrame:
    """Count request/response pairs with equal keys, one column per response condition.

    `by` are request columns, `by_response` response columns; names must differ. With no grouping, one
    row always results.
    """
    extra = [c for c in by if c not in keys]
    left = request_legs.groupBy(*keys, *extra).agg(n_rows().alias("_requests"))
    right = response_legs.groupBy(*keys, *by_response).agg(
        *[n_where(condition).alias(f"_{name}") for name, condition in measures.items()])
    return left.join(right, list(keys)).groupBy(*by, *by_response).agg(*_products(measures))


def pair_sums_by_key(log: DataFrame, keys: Sequence[str], by: Sequence[str], measures: Mapping[str, Column],
                     asked: Column | None = None, answered: Column | None = None) -> DataFrame:
    """`pair_sums` for groupings that are part of the key: one scan, one shuffle on the key, no join.

    `asked` and `answered` narrow the request and the response legs.
    """
    if not set(by) <= set(keys):
        raise ValueError("group by key columns only")
    is_request, is_response = F.col("io_cd") == "I", F.col("io_cd") == "O"
    is_request = is_request if asked is None else is_request & asked
    is_response = is_response if answered is None else is_response & answered
    keyed = [F.col(k).isNotNull() for k in keys]
    per_key = log.where(reduce(and_, keyed, is_request | is_response)).groupBy(*keys).agg(
        n_where(is_request).alias("_requests"), n_where(is_response).alias("_responses"),
        *[n_where(is_response & condition).alias(f"_{name}") for name, condition in measures.items()])
    paired = per_key.where((F.col("_requests") > 0) & (F.col("_responses") > 0))
    return paired.groupBy(*by).agg(*_products(measures))


def pair_sums_in_place(log: DataFrame, keys: Sequence[str], by: Sequence[str], measures: Mapping[str, Column],
                       by_response: Sequence[str] = (), asked: Column | None = None, answered: Column | None = None) -> DataFrame:
    """`pair_sums` in one scan and without a join, for a log that lies in buckets of (some of) its keys.

    Both legs are collapsed per key and group; a window over the key, which the buckets already hold together, hands a key's few response
    counts to its request counts. Only the groups' sums are shuffled. `asked` and `answered` narrow the legs.
    """
    is_request, is_response = F.col("io_cd") == "I", F.col("io_cd") == "O"
    is_request = is_request if asked is None else is_request & asked
    is_response = is_response if answered is None else is_response & answered
    extra = [c for c in by if c not in keys]
    keyed = [F.col(k).isNotNull() for k in keys]
    legs = log.where(reduce(and_, keyed, is_request | is_response)).withColumn("_asked", F.coalesce(is_request, F.lit(False)))
    own = {**{c: F.when(F.col("_asked"), F.col(c)) for c in extra}, **{c: F.when(~F.col("_asked"), F.col(c)) for c in by_response}}
    counts = legs.groupBy(*keys, "_asked", *[c.alias(f"_{name}") for name, c in own.items()]).agg(
        n_rows().alias("_requests"), *[n_where(condition).alias(f"_m_{name}") for name, condition in measures.items()])
    answer = F.struct(*[F.col(f"_{c}") for c in by_response], *[F.col(f"_m_{name}") for name in measures])
    answers = F.collect_list(F.when(~F.col("_asked"), answer)).over(Window.partitionBy(*keys))
    paired = counts.withColumn("_answers", answers).where("_asked").select(
        *[c for c in by if c in keys], *[F.col(f"_{c}").alias(c) for c in extra], "_requests", F.explode("_answers").alias("_answer"))
    return paired.groupBy(*by, *[F.col(f"_answer._{c}").alias(c) for c in by_response]).agg(
        *[F.coalesce(F.sum(F.col("_requests") * F.col(f"_answer._m_{name}")), F.lit(0)).alias(name) for name in measures])


def pair_sums_stored(stored: BucketedLog, keys: Sequence[str], by: Sequence[str], measures: Mapping[str, Column],
                     by_response: Sequence[str] = (), asked: Column | None = None, answered: Column | None = None) -> DataFrame:
    """`pair_sums` over a bucketed log: in place where keys are even, by a shuffle of counts where they are heavy."""
    even = pair_sums_in_place(stored.even, keys, by, measures, by_response, asked, answered)
    heavy_asked, heavy_answered = requests(stored.heavy), responses(stored.heavy)
    heavy = pair_sums(heavy_asked if asked is None else heavy_asked.where(asked),
                      heavy_answered if answered is None else heavy_answered.where(answered), keys, by, measures, by_response)
    return even.unionByName(heavy).groupBy(*by, *by_response).agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures])


def _products(measures: Mapping[str, Column]) -> list[Column]:
    return [F.coalesce(F.sum(F.col("_requests") * F.col(f"_{name}")), F.lit(0)).alias(name)
            for name in measures]


def pair_counts(request_legs: DataFrame, response_legs: DataFrame, keys: Sequence[str],
                by: Sequence[str], by_response: Sequence[str] = ("resp_cd",)) -> DataFrame:
    """Number of pairs per request and response column values."""
    return pair_sums(request_legs, response_legs, keys, by, {"n": F.lit(True)}, by_response)


def answers_to(request_legs: DataFrame, response_legs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The responses with a key of the given requests, before anything is counted or shuffled.

    For live readings: their few requests are counted when the query is built, and their keys are broadcast if they are
    as few as expected; else the responses are joined by a shuffle. The paired result is the same.
    """
    wanted = request_legs.select(*keys).distinct()
    return response_legs.join(broadcast_if_small(wanted), list(keys), "left_semi")


def unanswered_requests(request_legs: DataFrame, response_legs: DataFrame,
                        keys: Sequence[str] = KEYS_4, by: Sequence[str] = ("trx_cd",)) -> DataFrame:
    """Correlation keys with requests but no response, with the number of such requests."""
    extra = [c for c in by if c not in keys]
    asked = request_legs.groupBy(*keys, *extra).agg(n_rows().alias("n_requests"))
    return asked.join(response_legs.select(*keys).distinct(), list(keys), "left_anti")


def unified_activity(inbound: DataFrame, outbound: DataFrame,
                     outbound_bsns: str = config.OUTBOUND_BSNS) -> DataFrame:
    """Inbound request legs and outbound calls as rows of one shape."""
    columns = ["trx_dt", "event_ts", "trc_ad_no", "ret_ref_no", "switch_id", "bsns_cd", "trx_cd", "resp_cd"]
    inc = requests(inbound).select(F.lit("INC").alias("direction"), *columns)
    out = outbound.withColumn("bsns_cd", F.lit(outbound_bsns)).select(
        F.lit("OUT").alias("direction"), *columns)
    return inc.unionByName(out)
