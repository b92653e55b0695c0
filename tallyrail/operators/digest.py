"""Comma list of a group's rarest error codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrail.functions.codes import is_error

FIRST = 5


def with_digest_rank(counts: DataFrame, by: Sequence[str], order: Sequence[str] = ("n", "resp_cd"),
                     code: str = "resp_cd", only: Column | None = None) -> DataFrame:
    """Rank the error codes of each group in ascending count order; other rows get no rank.

    `counts` has one row per group and code, so a group holds at most the code domain.
    """
    listed = F.col(code).isNotNull() & is_error(code)
    listed = listed if only is None else listed & only
    flagged = counts.withColumn("_listed", listed)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_listed"), *order))
    return flagged.withColumn("_rank", F.when(F.col("_listed"), place)).drop("_listed")


def digest(code: str = "resp_cd", first: int = FIRST) -> Column:
    """Aggregate of a ranked group: its first codes as a comma list, NULL if it has none."""
    item = F.when(F.col("_rank") <= first, F.struct("_rank", F.col(code).alias("code")))
    codes = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["code"])
    return F.nullif(F.array_join(codes, ","), F.lit(""))


def error_code_digest(counts: DataFrame, by: Sequence[str], order: Sequence[str] = ("n", "resp_cd"),
                      code: str = "resp_cd", only: Column | None = None, first: int = FIRST) -> DataFrame:
    """The first error codes of each group that has any."""
    ranked = with_digest_rank(counts, by, order, code, only)
    return ranked.groupBy(*by).agg(digest(code, first).alias("error_codes")).where("error_codes is not null")
