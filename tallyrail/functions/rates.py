"""Counting and rate expressions; a zero volume gives a NULL rate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def n_rows() -> Column:
    return F.count(F.lit(1))


def n_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def floor_pct(part: Column, whole: Column) -> Column:
    return _floor_div(_wide(part) * 100, _wide(whole))


def round_pct(part: Column, whole: Column) -> Column:
    """Half up, as the dashboards round."""
    return _floor_div(_wide(part) * 200 + _wide(whole), _wide(whole) * 2)


def _wide(count: Column) -> Column:
    return count.cast("decimal(20,0)")


def _floor_div(number: Column, by: Column) -> Column:
    """Exact whole-number division rounded down; doubles would drop a percent on very large counts."""
    by = F.nullif(by, F.lit(0))
    return ((number - F.pmod(number, by)) / by).cast("bigint")
