"""Streaming jobs replayed over the whole log; each must equal the batch measure's SQL.

The one difference is stated in the SQL: a stream pairs a response that comes within the settle time.
"""

from __future__ import annotations

from datetime import timedelta
from functools import partial

from pyspark.sql import functions as F

from tallyrail.config import ODS
from tallyrail.functions.timeaxis import slot_label
from tallyrail.operators.legs import KEYS_3, KEYS_4, KEYS_5
from tallyrail.plans import dashboards
from tallyrail.registry import views as v
from tallyrail.registry.core import register
from tallyrail.registry.dashboard_queries import ALL, POLL, STRICT_FACTS
from tallyrail.registry.sql_views import SLOT_COLUMNS, slots
from tallyrail.session import settings, work_dir
from tallyrail.sources.readers import log_with_times
from tallyrail.streaming import alerts, counts, jobs, pairing, progress, upserts, windows

# The closing marker passes the views' filters (an outbound channel, an answered request, no administrative message).
MARKER = {"event_id": 1, "event_type": "purchase", "user_id": 0, "props": '{"k": 1}'}
STATE_PARTITIONS = 8  # of a replay of these tables; a live job is sized for its own volume
replay = partial(jobs.replay, state_partitions=STATE_PARTITIONS)


def _coded(spark, sf, marker=MARKER):
    table = v.raw_table(spark, sf, "events")
    turn_rows = jobs.TURN_ROWS * STATE_PARTITIONS
    return v.coded_log(log_with_times(jobs.read_replay(spark, f"{sf}/events.parquet", table, "ts", marker, turn_rows)))


def _paired(coded, by=(), keys=KEYS_4):
    return pairing.pair_stream(v.request_legs(coded), v.response_legs(coded), keys, by)


RATE = "CAST(floor(100 * approve / nullif(tot, 0)) AS BIGINT) AS rate"


@register("stream_throughput", f"""
SELECT direction, strftime(h, '%Y-%m-%d %H:%M:%S') AS window_start, approve, tot, {RATE} FROM (
  SELECT 'INC' AS direction, date_trunc('hour', event_ts) AS h, count(*) FILTER (WHERE rc = '00') AS approve,
         count(*) AS tot FROM pair5 WHERE bsns_cd <> 'ODS' GROUP BY ALL
  UNION ALL
  SELECT 'OUT', date_trunc('hour', event_ts), count(*) FILTER (WHERE resp_cd = '00'), count(*)
  FROM outbound_log GROUP BY ALL)""")
def stream_throughput(spark, sf):
    coded = _coded(spark, sf)
    asked = v.request_legs(coded).where(F.col("bsns_cd") != ODS)
    paired = pairing.pair_stream(asked, v.response_legs(coded), KEYS_5)
    return replay(windows.throughput_stream(paired, v.outbound_calls(coded), "1 hour"), "throughput").select(
        "direction", "window_start", "approve", "tot", "rate")


SLOTS_SQL = f"""
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, switch_id, approve, tot, {RATE} FROM (
  SELECT time_bucket(INTERVAL 5 MINUTES, a.event_ts) AS w, a.switch_id,
         count(*) FILTER (WHERE b.resp_cd = '00') AS approve, count(*) AS tot
  FROM a JOIN b ON a.trx_dt = b.trx_dt AND a.switch_id = b.switch_id AND a.trc_ad_no = b.trc_ad_no
   AND b.event_ts BETWEEN a.event_ts AND a.event_ts + INTERVAL 210 SECONDS
  WHERE a.trx_cd NOT IN ('ECHOMSG') GROUP BY ALL)"""


def _slots(spark, sf):
    coded = _coded(spark, sf)
    asked = v.request_legs(coded).where(~F.col("trx_cd").isin(list(v.ADMIN_MESSAGES)))
    return windows.window_paired(pairing.pair_stream(asked, v.response_legs(coded), KEYS_3), "5 minutes", ["switch_id"])


@register("stream_slots", SLOTS_SQL)
def stream_slots(spark, sf):
    return replay(_slots(spark, sf), "slots")


@register("stream_pair_legs", """
SELECT strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS request_ts, CAST(trx_dt AS VARCHAR) AS trx_dt, switch_id,
       trc_ad_no, ret_ref_no, trx_cd, count(*) FILTER (WHERE rc = '00') AS approve, count(*) AS tot
FROM pair4 GROUP BY ALL""")
def stream_pair_legs(spark, sf):
    return replay(_paired(_coded(spark, sf), ["trx_cd"]), "pairs")


@register("stream_alerts", f"""
SELECT window_start, switch_id, approve, tot, {RATE} FROM (
  SELECT g.window_start, g.switch_id, coalesce(s.approve, 0) AS approve, coalesce(s.tot, 0) AS tot FROM (
    SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS window_start, switch_id FROM (
      SELECT unnest(generate_series(min(CAST(window_start AS TIMESTAMP)), max(CAST(window_start AS TIMESTAMP)),
                                    INTERVAL 5 MINUTES)) AS t FROM ({SLOTS_SQL})),
      (SELECT unnest(['CLIC', 'PURC', 'VIEW', 'REFD']) AS switch_id)) g
  LEFT JOIN ({SLOTS_SQL}) s USING (window_start, switch_id))
WHERE coalesce(floor(100 * approve / nullif(tot, 0)), 0) <= 0
  AND substr(window_start, 12, 5) > '08:30:00' AND substr(window_start, 12, 5) < '20:00:00'""")
def stream_alerts(spark, sf):
    rules = alerts.zero_approval_rules(spark, ["CLIC", "PURC", "VIEW", v.SILENT_CHANNEL])
    return alerts.replay_alerts(_slots(spark, sf), "alerts", rules, "5 minutes", STATE_PARTITIONS)


@register("stream_unanswered", """
SELECT strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS request_ts, CAST(trx_dt AS VARCHAR) AS trx_dt, switch_id,
       trc_ad_no, ret_ref_no, trx_cd, count(*) AS n_requests
FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.trx_dt = a.trx_dt AND b.switch_id = a.switch_id
  AND b.trc_ad_no = a.trc_ad_no AND b.ret_ref_no = a.ret_ref_no) GROUP BY ALL""")
def stream_unanswered(spark, sf):
    coded = _coded(spark, sf)
    return replay(pairing.unanswered_stream(v.request_legs(coded), v.response_legs(coded), by=["trx_cd"]), "unanswered")


def _asked():
    return ~F.col("trx_cd").isin(list(v.ADMIN_MESSAGES)) & (F.col("bsns_cd") != ODS)


def _kept(spark, sf, width):
    """Counts kept by a stream over the log; without a closing marker, so its last windows stay open."""
    coded = _coded(spark, sf, marker=None)
    folder = work_dir(spark, "counts")
    with settings(spark, jobs.REPLAY):
        query = counts.run_counts(v.request_legs(coded).where(_asked()), v.response_legs(coded), folder, width, state_partitions=STATE_PARTITIONS)
    query.awaitTermination()
    return folder


@register("slots_maintained", slots(STRICT_FACTS, ALL) + f"SELECT {SLOT_COLUMNS} FROM rated")
def slots_maintained(spark, sf):
    """The strict slot series from maintained counts, and from the log where they are open."""
    facts = counts.all_slots(spark, _kept(spark, sf, 300), v.inbound_log(spark, sf), v.LOG_END + timedelta(days=366), 300, asked=_asked())
    series = dashboards.replayed_series(facts, v.polls(spark, sf, POLL), POLL, [*v.CHANNELS, v.SILENT_CHANNEL])
    return series.select("poll_ts", "slot_no", slot_label("slot_ts").alias("slot"), "switch_id", "approve", "tot", "rate")


HOURLY_CALLS_SQL = f"""
SELECT strftime(date_trunc('hour', event_ts), '%Y-%m-%d %H:%M:%S') AS window_start, switch_id,
       count(*) FILTER (WHERE resp_cd = '00') AS approve, count(*) AS tot,
       CAST(floor(100 * count(*) FILTER (WHERE resp_cd = '00') / count(*)) AS BIGINT) AS rate
FROM outbound_log"""


def _quarters(spark, sf):
    """The outbound log, the number of each row's quarter of the log's days, and the first day."""
    first, last = v.day_bounds(spark, sf)
    part = F.least(F.floor(F.datediff("trx_dt", F.lit(first)) * 4 / F.lit((last - first).days + 1)), F.lit(3))
    return v.outbound_log(spark, sf), part, first


def _late_parts(spark, sf):
    """Four quarters in time order; then the first day once more, now too late to count; then the marker."""
    calls, part, first = _quarters(spark, sf)
    again = calls.where(F.col("trx_dt") == F.lit(first))
    return calls, [*[calls.where(part == n) for n in range(4)], again, jobs.marker_row(calls, "event_ts", {"switch_id": "PURC"})]


def _in_turn(spark, schema, parts, run):
    """Add each part to a folder with all its partitions, and let `run(stream)` read what is new: a micro-batch per part."""
    path = work_dir(spark, "turns")
    for part in parts:
        part.write.mode("append").parquet(path)
        run(jobs.read_log_stream(spark, path, schema))


@register("stream_late_rows", f"{HOURLY_CALLS_SQL} GROUP BY ALL")
def stream_late_rows(spark, sf):
    calls, parts = _late_parts(spark, sf)
    folder, counted = work_dir(spark, "late"), partial(windows.window_calls, width="1 hour", by=["switch_id"])
    _in_turn(spark, calls.schema, parts, lambda stream: jobs.run_to_parquet(
        counted(stream), folder, state_partitions=STATE_PARTITIONS).awaitTermination())
    return jobs.results(spark, folder, counted(calls).schema)


@register("stream_late_counts", f"""
SELECT {{day}} AS trx_dt, switch_id, count(*) AS n_late FROM outbound_log
WHERE trx_dt = (SELECT min(trx_dt) FROM inbound_log) GROUP BY ALL""".format(day="CAST(trx_dt AS VARCHAR)"))
def stream_late_counts(spark, sf):
    """The rows that `stream_late_rows` leaves out, counted as they come."""
    calls, parts = _late_parts(spark, sf)
    folder = work_dir(spark, "late-counts")
    _in_turn(spark, calls.schema, parts, lambda stream: progress.run_late_rows(
        stream, folder, "1 hour", by=["trx_dt", "switch_id"]).awaitTermination())
    return spark.read.parquet(f"{folder}/late_by").select("trx_dt", "switch_id", "n_late")


def _corrected(spark, sf, until):
    """Hourly windows in update mode after `until` parts, where every ninth call comes a part late but within the watermark's delay."""
    calls, part, _ = _quarters(spark, sf)
    came = F.least(part + F.when(F.col("event_id") % 9 == 0, 1).otherwise(0), F.lit(3))
    folder, width, keys = work_dir(spark, "updates"), "1 hour", ["window_start", "switch_id"]
    counted = partial(windows.window_calls, width=width, by=["switch_id"], delay="60 days")
    _in_turn(spark, calls.schema, [calls.where(came == n) for n in range(until)], lambda stream: upserts.run_upserts(
        counted(stream), folder, state_partitions=STATE_PARTITIONS).awaitTermination())
    schema = counted(calls).schema
    if until > 2:
        upserts.compact(spark, folder, schema, keys)
    return upserts.latest(spark, folder, schema, keys)


@register("stream_update_before", f"""{HOURLY_CALLS_SQL}, (SELECT min(trx_dt) AS lo, max(trx_dt) AS hi FROM inbound_log)
WHERE least(floor((trx_dt - lo) * 4 / (hi - lo + 1)), 3) = 0 AND event_id % 9 <> 0 GROUP BY ALL""")
def stream_update_before(spark, sf):
    return _corrected(spark, sf, 1)


@register("stream_update_after", f"{HOURLY_CALLS_SQL} GROUP BY ALL")
def stream_update_after(spark, sf):
    return _corrected(spark, sf, 4)
