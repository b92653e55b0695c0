"""Response-code and channel predicates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyrail import config
from tallyrail.config import ChannelRule


def is_approved(code: str | Column = "resp_cd") -> Column:
    return _col(code).eqNullSafe(F.lit(config.APPROVED))


def is_error(code: str | Column = "resp_cd") -> Column:
    """Anything but the approved code; a missing response is an error."""
    return ~is_approved(code)


def is_service_error(code: str | Column = "resp_cd",
                     customer_codes: Iterable[str] = config.CUSTOMER_CODES) -> Column:
    """An error the customer did not cause."""
    return is_error(code) & ~F.coalesce(_col(code).isin(list(customer_codes)), F.lit(False))


def effective_resp_code(resp_cd: str = "resp_cd", resp_val: str = "resp_val") -> Column:
    """Code of an outbound call: an approved call may carry the host's own code as `[xx]` in its text."""
    host = F.regexp_extract(resp_val, r"\[(.{2})\]", 1)
    missing = F.lit(config.NO_RESPONSE)
    return (
        F.when(F.col(resp_cd).isNull(), missing)
        .when(F.col(resp_cd) != config.APPROVED, F.col(resp_cd))
        .when(F.col(resp_val).isNull(), F.col(resp_cd))
        .when(host == "", missing)
        .otherwise(host))


def binary_resp_code(resp_cd: str = "resp_cd", failed: str = "05") -> Column:
    return F.when(is_approved(resp_cd), F.lit(config.APPROVED)).otherwise(F.lit(failed))


def decode_values(value: str | Column, labels: Mapping[str, str], default: Column | None = None,
                  missing: str | None = None) -> Column:
    """Value -> label, with a label for NULL and a default (the value itself if none is given)."""
    value = _col(value)
    out = F.when(value.isNull(), F.lit(missing))
    for key, label in labels.items():
        out = out.when(value == key, F.lit(label))
    return out.otherwise(value if default is None else default)


def in_channels(rules: Iterable[ChannelRule]) -> Column:
    """Rows the rules admit, as a conjunction that can be pushed into the scan.

    As in SQL, a NULL code meets no `IN` and no `NOT IN` list.
    """
    rules = list(rules)
    switch, trx, bsns = F.col("switch_id"), F.col("trx_cd"), F.col("bsns_cd")
    parts = [switch.isin([r.switch_id for r in rules])]
    for r in rules:
        limits = []
        if r.only_trx:
            limits.append(trx.isin(list(r.only_trx)))
        if r.exclude_trx:
            limits.append(~trx.isin(list(r.exclude_trx)))
        if r.exclude_bsns:
            limits.append(~bsns.isin(list(r.exclude_bsns)))
        if limits:
            parts.append((switch != r.switch_id) | reduce(and_, limits))
    return reduce(and_, parts)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
