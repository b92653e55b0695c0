"""Card-transaction reports by authentication, merchant, category and region."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrail import config
from tallyrail.functions.codes import decode_values
from tallyrail.functions.rates import n_rows
from tallyrail.functions.text import category_code
from tallyrail.operators.dims import contains_join, with_parent, with_title


def _totals():
    return n_rows().alias("freq_trx"), F.sum("trx_amount").alias("total_trx")


def by_auth_flag(cards: DataFrame) -> DataFrame:
    """Transactions by authentication outcome, all of them, most frequent first."""
    counts = cards.groupBy("onoff").agg(n_rows().alias("n"))
    name = decode_values("onoff", config.AUTH_LABELS, missing=config.AUTH_MISSING)
    return counts.select(name.alias("name"), "onoff", "n").orderBy(F.desc("n"), "name")


def top_merchants(cards: DataFrame, top: int = 10) -> DataFrame:
    """Most frequent merchants; equal counts in order of merchant and location."""
    return (cards.where(F.col("merchant_name").isNotNull())
            .groupBy("merchant_name", "location").agg(*_totals())
            .orderBy(F.desc("freq_trx"), "merchant_name", "location").limit(top))


def top_categories(cards: DataFrame, titles: DataFrame, top: int = 10) -> DataFrame:
    """Most frequent merchant categories with their titles; titles join the counts, not the log."""
    listed = titles.select(category_code("code").alias("code"), "title")
    counts = (cards.where(F.col("merchant_tp").isNotNull())
              .groupBy(category_code("merchant_tp").alias("mcc")).agg(*_totals()))
    return (with_title(counts, listed, "mcc").select("mcc", "title", "freq_trx", "total_trx")
            .orderBy(F.desc("freq_trx"), "mcc").limit(top))


def place(location: str, overrides: Mapping[str, str] = config.LOCATION_OVERRIDES, length: int = 8):
    """City part of a merchant location: its first characters in upper case, or a listed override."""
    out = F.trim(F.upper(F.substring(location, 1, length)))
    for text, name in overrides.items():
        out = F.when(F.col(location).contains(text), F.lit(name)).otherwise(out)
    return out


def region_rollup(cards: DataFrame, codes: DataFrame, city_type: str = config.CITY_TYPE,
                  province_type: str = config.PROVINCE_TYPE, dedupe: bool = True,
                  province_keys: Mapping[str, str] = config.PROVINCE_KEYS) -> DataFrame:
    """Count, sum and average per province, by cities whose name contains the merchant's place.

    Equal purchases (merchant, place, amount) count once with `dedupe`. A place found in several cities
    counts once for each of their provinces. The log is reduced to one row per place before any lookup.
    """
    located = (cards.where((F.trim("location") != "") & ~F.col("location").contains("-"))
               .select("merchant_name", place("location").alias("loc"), "trx_amount"))
    if dedupe:
        located = located.distinct()
    places = located.groupBy("loc").agg(n_rows().alias("n"), F.sum("trx_amount").alias("amount"))
    cities = codes.where(F.col("type") == city_type).select("code1", "code_nm")
    parents = contains_join(places, cities, "loc", "code_nm").select(
        "loc", "n", "amount", "code1")
    parents = parents.distinct() if dedupe else parents
    rolled = (with_parent(parents, codes, province_type).where(F.col("parent_nm").isNotNull())
              .groupBy("parent_nm").agg(F.sum("n").alias("total_trx"),
                                        F.sum("amount").alias("trx_amt_total")))
    return rolled.select(
        decode_values("parent_nm", province_keys).alias("name"), "total_trx", "trx_amt_total",
        F.try_divide(F.col("trx_amt_total"), F.col("total_trx")).alias("trx_amt_avg"))
