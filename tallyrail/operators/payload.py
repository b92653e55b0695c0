"""Layout-driven payload decoding and payload search."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrail import config
from tallyrail.functions.text import field_at, has_keywords
from tallyrail.operators.dims import map_message_family
from tallyrail.schemas import literal_table


UNLISTED = "*"


def message_layout(layout: DataFrame, families: DataFrame, side: str = "I", common_side: str = "C",
                   default_family: str = config.DEFAULT_FAMILY) -> DataFrame:
    """All fields of each message code: its own body fields and its family's common header fields.

    A layout belongs to the code its id starts with. The code `*` stands for every message without an
    entry; it has the default family's header only.
    """
    keyed = layout.withColumn("_map", F.substring("map_id", 1, 7))
    body = keyed.where(F.col("inout_cd") == side).withColumn("trx_cd", F.col("_map"))
    codes = (body.select("trx_cd").union(families.select("trx_cd")).distinct()
             .union(layout.sparkSession.range(1).select(F.lit(UNLISTED).alias("trx_cd"))))
    common = map_message_family(codes, families, default_family).join(
        keyed.where(F.col("inout_cd") == common_side), F.col("family") == F.col("_map"))
    fields = ["trx_cd", "inout_cd", "seq_no", "field_nm", "field_len"]
    return body.select(fields).unionByName(common.select(fields))


def with_layout_code(df: DataFrame, codes: DataFrame) -> DataFrame:
    """Add `layout_cd`: the message code if `codes` lists it, else `*`."""
    listed = codes.select(F.col("layout_cd").alias("_listed"))
    joined = df.join(listed, F.col("trx_cd") == F.col("_listed"), "left")
    return joined.withColumn("layout_cd", F.coalesce("_listed", F.lit(UNLISTED))).drop("_listed")


def layout_offsets(fields: DataFrame, by: Sequence[str] = ("trx_cd",),
                   base: int = config.LAYOUT_BASE) -> DataFrame:
    """Start position of every field: base plus the lengths of all fields with a lower number."""
    before = (Window.partitionBy(*by).orderBy("seq_no")
              .rangeBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(F.sum("field_len").over(before), F.lit(0)) + base
    return fields.withColumn("position", start.cast("int"))


def field_places(offsets: DataFrame) -> DataFrame:
    """One row per message code with the places of its currency and amount.

    A field is found by a part of its name; the first one counts.
    """
    def first(names: Sequence[str]) -> Column:
        match = reduce(or_, [F.col("field_nm").contains(name) for name in names])
        return F.min_by(F.struct("position", "field_len"), F.when(match, F.col("seq_no")))

    found = offsets.groupBy(F.col("trx_cd").alias("layout_cd")).agg(
        first(config.CURRENCY_NAMES).alias("_ccy"), first(config.AMOUNT_NAMES).alias("_amt"))
    return found.select(
        "layout_cd", F.col("_ccy.position").alias("ccy_pos"), F.col("_ccy.field_len").alias("ccy_len"),
        F.col("_amt.position").alias("amt_pos"), F.col("_amt.field_len").alias("amt_len"))


class Places(NamedTuple):
    """Where currency and amount stand: a small table of the listed codes, and the place of every other message."""

    listed: DataFrame
    other: Column


PLACE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("ccy_pos", "ccy_len", "amt_pos", "amt_len")])


def known_places(places: DataFrame) -> Places:
    """`field_places` worked out once, as literals: any number of logs joins them without working out the layout again.

    One row per message code of the layout dictionary comes to the driver.
    """
    rows = {r["layout_cd"]: tuple(r[n] for n in PLACE.fieldNames()) for r in places.collect()}
    other = rows.pop(UNLISTED, (None,) * len(PLACE))
    listed = literal_table(places.sparkSession, [(code, *row) for code, row in rows.items()],
                           T.StructType([T.StructField("_listed", T.StringType()), *PLACE.fields]))
    return Places(listed.select("_listed", F.struct(*PLACE.fieldNames()).alias("_own")),
                  F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(other, PLACE)]))


def layout_extract(log: DataFrame, places: DataFrame | Places, payload: str = "log_data", scale: int = 0) -> DataFrame:
    """Currency and amount of every message, each by the layout of its own message code.

    `places` comes from `field_places` or, for several logs, from `known_places`; `scale` is the number of implied decimals in the amount text. One
    broadcast join finds a listed code; the place of every other message is a literal.
    """
    known = places if isinstance(places, Places) else known_places(places)
    placed = log.join(known.listed, F.col("trx_cd") == F.col("_listed"), "left").withColumn(
        "_place", F.when(F.col("_listed").isNotNull(), F.col("_own")).otherwise(known.other))
    amount = F.expr("try_cast(trim(_amt) as decimal(18,2))") / F.lit(10 ** scale)
    return (placed.withColumn("ccy", field_at(payload, "_place.ccy_pos", "_place.ccy_len"))
            .withColumn("_amt", field_at(payload, "_place.amt_pos", "_place.amt_len"))
            .withColumn("amt", amount.cast("decimal(18,2)"))
            .drop("_listed", "_own", "_place", "_amt"))


def search_payload(inbound: DataFrame, outbound: DataFrame, channel: str, keywords: Sequence[str],
                   exclude_outbound: Sequence[str] = config.NON_FINANCIAL,
                   outbound_bsns: str = config.OUTBOUND_BSNS, like: bool = False) -> DataFrame:
    """Request legs and outbound calls of one channel whose payload holds all keywords.

    An outbound call is found by its request payload or by its response payload. Newest rows come first;
    the rebalance keeps the sort's sampling pass off the payload scan.
    """
    columns = ["trx_dt", "event_ts", "trc_ad_no", "ret_ref_no", "switch_id", "bsns_cd", "trx_cd",
               "svc_cd", "resp_cd"]
    on_channel: Column = F.col("switch_id") == channel
    inc = inbound.where(on_channel & (F.col("io_cd") == "I") & has_keywords("log_data", keywords, like))
    either = has_keywords("i_log_data", keywords, like) | has_keywords("o_log_data", keywords, like)
    out = (outbound.where(on_channel & ~F.col("trx_cd").isin(list(exclude_outbound)) & either)
           .withColumn("bsns_cd", F.lit(outbound_bsns))
           .withColumn("svc_cd", F.lit(None).cast("string")))
    found = inc.select(columns).unionByName(out.select(columns))
    return found.hint("rebalance").orderBy(F.desc("event_ts"))
