"""Dimension lookups.

Reports join dimensions to counts, not to logs, and leave the strategy to Catalyst and AQE, which broadcast
below `spark.sql.autoBroadcastJoinThreshold`. `broadcast_if_small` is for live readings, whose few request keys are
counted first.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrail import config, schemas


BROADCAST_ROWS = 100_000


def broadcast_if_small(dimension: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Ask for a broadcast if the dimension has at most `rows` rows, else leave the join as it is.

    The count runs when the query is built, so give it a table, or a narrow and pruned part of a log.
    """
    small = dimension.limit(rows + 1).count() <= rows
    return F.broadcast(dimension) if small else dimension


def channel_ranks(spark: SparkSession, ranks: Iterable[tuple] = config.CHANNEL_RANKS) -> DataFrame:
    return schemas.literal_table(spark, ranks, schemas.CHANNEL_RANK)


def channel_labels(spark: SparkSession, labels: Iterable[tuple] = config.CHANNEL_LABELS) -> DataFrame:
    return schemas.literal_table(spark, labels, schemas.CHANNEL_LABEL)


def message_families(spark: SparkSession,
                     families: Mapping[str, str] = config.MESSAGE_FAMILIES) -> DataFrame:
    return schemas.literal_table(spark, families.items(), schemas.MESSAGE_FAMILY)


def label_channels(df: DataFrame, labels: DataFrame, default: str = config.OTHER_LABEL,
                   channel: str = "switch_id") -> DataFrame:
    """Display name per channel: the exact business code first, then the channel's general name.

    `channel` names the column to label, such as the `segment` of the card report.
    """
    names = labels.withColumnRenamed("switch_id", channel)
    exact = names.where(F.col("bsns_cd").isNotNull()).withColumnRenamed("label", "_exact")
    general = names.where(F.col("bsns_cd").isNull()).select(channel, F.col("label").alias("_general"))
    joined = df.join(exact, [channel, "bsns_cd"], "left").join(general, [channel], "left")
    label = F.coalesce("_exact", "_general", F.lit(default))
    return joined.withColumn("label", label).drop("_exact", "_general")


def with_priority(df: DataFrame, ranks: DataFrame, last: int = config.LAST_RANK) -> DataFrame:
    """Report order of each (channel, business code); unlisted ones come last."""
    joined = df.join(ranks.withColumnRenamed("rank", "_rank"), ["switch_id", "bsns_cd"], "left")
    return joined.withColumn("priority", F.coalesce("_rank", F.lit(last))).drop("_rank")


def map_message_family(df: DataFrame, families: DataFrame,
                       default: str = config.DEFAULT_FAMILY) -> DataFrame:
    joined = df.join(families.withColumnRenamed("family", "_family"), ["trx_cd"], "left")
    return joined.withColumn("family", F.coalesce("_family", F.lit(default))).drop("_family")


def catalog_rows(catalog: DataFrame, name: str, channel: str | None = None,
                 not_prefix: str | None = None) -> DataFrame:
    """Rows of one named catalog, of one channel, without codes that start with `not_prefix`."""
    rows = catalog.where(F.col("cnts_nm") == name)
    if channel is not None:
        rows = rows.where(F.col("cnts_5") == channel)
    if not_prefix is not None:
        rows = rows.where(~F.col("cnts_1").startswith(not_prefix))
    return rows


def extend_catalog(catalog: DataFrame, rows: Sequence[Mapping[str, str]]) -> DataFrame:
    """Add literal rows to a catalog; columns not given are NULL."""
    names = schemas.CATALOG.fieldNames()
    extra = schemas.literal_table(
        catalog.sparkSession, [tuple(row.get(c) for c in names) for row in rows], schemas.CATALOG)
    return catalog.unionByName(extra, allowMissingColumns=True)


def contains_join(needles: DataFrame, haystacks: DataFrame, needle: str, haystack: str,
                  gram: int = 8, how: str = "inner") -> DataFrame:
    """Join rows where the needle text occurs inside the haystack text, without a nested loop.

    Each haystack is listed under all its substrings of up to `gram` characters and met by equality with
    the needle's first `gram` characters; longer needles are then checked whole. The result is exact for
    every needle length. Callers give distinct needles. Blank needles meet nothing.
    """
    text = F.col(haystack)
    grams = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))),
        lambda at: F.transform(
            F.sequence(F.lit(1), F.lit(gram)), lambda size: F.substr(text, at, size)))
    index = (haystacks.where(F.length(text) > 0)
             .withColumn("_gram", F.explode(F.array_distinct(F.flatten(grams)))))
    word = F.col(needle)
    keyed = needles.withColumn("_word", F.nullif(F.substring(needle, 1, gram), F.lit("")))
    found = (F.col("_word") == F.col("_gram")) & text.contains(word)
    return keyed.join(index, found, how).drop("_word", "_gram")


def with_parent(df: DataFrame, codes: DataFrame, parent_type: str, child: str = "code1") -> DataFrame:
    """Name of the parent code (`parent_nm`); NULL if the code table does not list it."""
    parents = codes.where(F.col("type") == parent_type).select(
        F.col("code").alias(child), F.col("code_nm").alias("parent_nm"))
    return df.join(parents, [child], "left")


def with_title(df: DataFrame, titles: DataFrame, code: str) -> DataFrame:
    """Title of a code from a (code, title) dimension, else the code itself."""
    named = titles.select(F.col("code").alias(code), F.col("title").alias("_title"))
    return df.join(named, [code], "left").withColumn("title", F.coalesce("_title", code)).drop("_title")
