"""Reports over logs in their stored layouts; each must equal the same report over the log as it came."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyrail import config
from tallyrail.operators import payload
from tallyrail.operators.legs import KEYS_3, KEYS_5, approval_measures, pair_sums_stored, requests
from tallyrail.plans import drilldown
from tallyrail.registry import views as v
from tallyrail.registry.basic_queries import DAY
from tallyrail.registry.core import ORACLES, register
from tallyrail.registry.sql_views import VIEWS
from tallyrail.session import work_dir
from tallyrail.sources import bucketed, readers, search_index, sinks

BUCKETS = 16  # for these tables; a real log is sized by its volume


def _bucketed(spark, sf):
    name = f"log_{uuid.uuid4().hex}"
    return bucketed.write_bucketed(v.inbound_log(spark, sf), name, work_dir(spark, "bucketed"), BUCKETS)


def _written(spark, sf):
    path = work_dir(spark, "log")
    log = v.inbound_log(spark, sf)
    sinks.write_log(log, path, ("trx_dt", "io_cd"))
    return readers.read_parquet(spark, path, log.schema)


@register("pair_legs_stored", f"""
SELECT {DAY}, switch_id, bsns_cd, trx_cd, rc AS resp_cd, count(*) AS n FROM pair5
WHERE bsns_cd <> 'ODS' GROUP BY ALL""")
def pair_legs_stored(spark, sf):
    return pair_sums_stored(_bucketed(spark, sf), KEYS_5, ["trx_dt", "switch_id", "bsns_cd", "trx_cd"], {"n": F.lit(True)},
                            ["resp_cd"], asked=F.col("bsns_cd") != config.ODS)


@register("approval_stored", f"""
SELECT {DAY}, switch_id, trx_cd, count(*) FILTER (WHERE rc = '00') AS approve, count(*) AS tot
FROM pair3 GROUP BY ALL""")
def approval_stored(spark, sf):
    """By three keys: a trace number is used again within a day, so its messages pair many times over."""
    return pair_sums_stored(_bucketed(spark, sf), KEYS_3, ["trx_dt", "switch_id", "trx_cd"], approval_measures())


@register("lookback_stored", """
SELECT event_id, switch_id, strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS event_ts FROM a
WHERE event_ts BETWEEN TIMESTAMP '2024-01-15 11:00:00' AND TIMESTAMP '2024-01-15 12:00:00'""")
def lookback_stored(spark, sf):
    return readers.lookback(requests(_written(spark, sf)), v.AS_OF, 60).select("event_id", "switch_id", "event_ts")


@register("transaction_stored", f"""
SELECT {DAY}, strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS event_ts, io_cd, trx_cd, resp_cd FROM inbound_log
WHERE (switch_id, trc_ad_no, ret_ref_no) IN (
  SELECT DISTINCT last(switch_id ORDER BY event_ts, event_id), last(trc_ad_no ORDER BY event_ts, event_id),
         last(ret_ref_no ORDER BY event_ts, event_id) FROM inbound_log)""")
def transaction_stored(spark, sf):
    log = _written(spark, sf)
    last = log.agg(*[F.max_by(c, F.struct("event_ts", "event_id")).alias(c) for c in ("switch_id", "trc_ad_no", "ret_ref_no")]).first()
    return drilldown.correlated(log, last.switch_id, last.trc_ad_no, last.ret_ref_no).select(
        "trx_dt", "event_ts", "io_cd", "trx_cd", "resp_cd")


@register("search_indexed", ORACLES["search_payload"].removeprefix(VIEWS))
def search_indexed(spark, sf):
    """The payload search over stored logs, on the files that the index leaves."""
    keywords, found = ["P0003", "IDR", ""], []
    for log, columns in ((v.inbound_log(spark, sf), ["log_data"]), (v.outbound_log(spark, sf), ["i_log_data", "o_log_data"])):
        path, index = work_dir(spark, "log"), work_dir(spark, "search-index")
        sinks.write_log(log, path, ("trx_dt",))
        search_index.index_files(spark, path, index, columns, log.schema)
        found.append(search_index.narrowed(spark, path, index, columns, log.schema, "PURC", keywords).log)
    return payload.search_payload(*found, "PURC", keywords, exclude_outbound=v.ADMIN_CALLS)
