"""Dashboard series, health, throughput and alerts, replayed with hourly polls over the whole log."""

from __future__ import annotations

from datetime import datetime, time, timedelta

from pyspark.sql import functions as F

from tallyrail import config
from tallyrail.functions.timeaxis import slot_label
from tallyrail.operators import spine
from tallyrail.operators.legs import KEYS_5
from tallyrail.operators.throughput import rolling_strip, throughput
from tallyrail.plans import alerts, dashboards
from tallyrail.registry import views as v
from tallyrail.registry.basic_queries import DAY
from tallyrail.registry.core import register
from tallyrail.registry.sql_views import SLOT_COLUMNS, slots

POLL = 60
ALL = " ".join(v.CHANNELS) + f" {v.SILENT_CHANNEL}"

INBOUND_FACTS = "SELECT switch_id, event_ts, rc FROM pair3 WHERE trx_cd NOT IN ('ECHOMSG')"
STRICT_FACTS = "SELECT switch_id, event_ts, rc FROM pair5 WHERE trx_cd NOT IN ('ECHOMSG') AND bsns_cd <> 'ODS'"
OUTBOUND_FACTS = "SELECT switch_id, event_ts, CASE WHEN resp_cd = '00' THEN '00' ELSE '05' END AS rc FROM outbound_log"


def _shown(series):
    return series.select("poll_ts", "slot_no", slot_label("slot_ts").alias("slot"), "switch_id", "approve",
                         "tot", "rate")


def _polls(spark, sf):
    return v.polls(spark, sf, POLL)


def _inbound_series(spark, sf, exclude_resp=(), channels=(*v.CHANNELS, v.SILENT_CHANNEL)):
    log = v.inbound_log(spark, sf)
    facts = dashboards.inbound_slots(log, exclude_trx=v.ADMIN_MESSAGES, exclude_resp=exclude_resp)
    return dashboards.replayed_series(facts, _polls(spark, sf), POLL, channels)


@register("slots_inbound", slots(INBOUND_FACTS, ALL) + f"SELECT {SLOT_COLUMNS} FROM rated")
def slots_inbound(spark, sf):
    return _shown(_inbound_series(spark, sf))


@register("slots_inbound_filtered",
          slots(INBOUND_FACTS + " AND rc NOT IN ('05', '91')", "VIEW SIGN") + f"SELECT {SLOT_COLUMNS} FROM rated")
def slots_inbound_filtered(spark, sf):
    return _shown(_inbound_series(spark, sf, ("05", "91"), ("VIEW", "SIGN")))


@register("slots_inbound_strict", slots(STRICT_FACTS, ALL) + f"SELECT {SLOT_COLUMNS} FROM rated")
def slots_inbound_strict(spark, sf):
    log = v.inbound_log(spark, sf)
    facts = dashboards.inbound_slots(log, KEYS_5, v.ADMIN_MESSAGES, exclude_bsns=(config.ODS,))
    return _shown(dashboards.replayed_series(facts, _polls(spark, sf), POLL, [*v.CHANNELS, v.SILENT_CHANNEL]))


@register("slots_both", slots(f"""{INBOUND_FACTS} UNION ALL
SELECT switch_id, event_ts, resp_cd FROM outbound_log WHERE trx_cd NOT IN ('#LOG_ON')""", "PURC SIGN")
    + f"SELECT {SLOT_COLUMNS} FROM rated")
def slots_both(spark, sf):
    log = v.inbound_log(spark, sf)
    inc = dashboards.inbound_slots(log, exclude_trx=v.ADMIN_MESSAGES)
    out = dashboards.outbound_slots(v.outbound_log(spark, sf), v.ADMIN_CALLS)
    return _shown(dashboards.replayed_series(dashboards.both_slots(inc, out), _polls(spark, sf), POLL, ["PURC", "SIGN"]))


@register("slots_outbound", slots(OUTBOUND_FACTS + " WHERE trx_cd = 'OPAYMNT'", "PURC SIGN")
          + f"SELECT {SLOT_COLUMNS} FROM rated")
def slots_outbound(spark, sf):
    facts = dashboards.outbound_slots(v.outbound_log(spark, sf), only_trx=("OPAYMNT",))
    polls = _polls(spark, sf)
    return _shown(dashboards.replayed_series(facts, polls, POLL, ["PURC", "SIGN"]))


@register("spine_trim", slots(INBOUND_FACTS, "CLIC VIEW")
          + f"SELECT {SLOT_COLUMNS} FROM rated WHERE slot_no BETWEEN 1 AND 10")
def spine_trim(spark, sf):
    return _shown(spine.trim_spine(_inbound_series(spark, sf, (), ("CLIC", "VIEW")), head=1, tail=2))


@register("slot_alert", slots(INBOUND_FACTS, ALL) + f"""
SELECT {SLOT_COLUMNS} FROM rated
WHERE slot_no = 10 AND strftime(slot_ts, '%H:%M') > '08:30:00' AND strftime(slot_ts, '%H:%M') < '20:00:00'
  AND coalesce(rate, 0) <= 0 AND switch_id IN ('CLIC', 'VIEW', 'REFD')""")
def slot_alert(spark, sf):
    return _shown(alerts.zero_approval(_inbound_series(spark, sf), ["CLIC", "VIEW", v.SILENT_CHANNEL]))


FEED_SQL = """, beat AS (
  SELECT s.poll_ts, s.slot_no, s.slot_ts, count(f.ric) AS tot FROM spine s
  LEFT JOIN price_feed f ON time_bucket(INTERVAL 5 MINUTES, f.event_ts) = s.slot_ts
   AND f.event_ts BETWEEN s.poll_ts - INTERVAL 60 MINUTES AND s.poll_ts GROUP BY ALL)
SELECT strftime(poll_ts, '%Y-%m-%d %H:%M:%S') AS poll_ts, CAST(slot_no AS BIGINT) AS slot_no,
       strftime(slot_ts, '%H:%M:%S') AS slot, tot FROM beat"""


def _heartbeat(spark, sf):
    facts = dashboards.feed_slots(v.price_feed(spark, sf))
    return dashboards.replayed_heartbeat(facts, _polls(spark, sf), POLL)


def _beat(rows):
    return rows.select("poll_ts", "slot_no", slot_label("slot_ts", True).alias("slot"), "tot")


@register("feed_heartbeat", FEED_SQL)
def feed_heartbeat(spark, sf):
    return _beat(_heartbeat(spark, sf))


@register("alert_feed_silent", FEED_SQL + """
WHERE slot_no = 10 AND strftime(slot_ts, '%H:%M:%S') > '07:45:00' AND strftime(slot_ts, '%H:%M:%S') < '15:00:00'
  AND tot = 0 AND isodow(poll_ts) < 6""")
def alert_feed_silent(spark, sf):
    return _beat(alerts.feed_silent(_heartbeat(spark, sf)))


HEALTH = """CAST(floor(100 * (tot - approve) / nullif(tot, 0) + 0.5) AS BIGINT) AS failure_rate,
CAST(floor(100 * approve / nullif(tot, 0) + 0.5) AS BIGINT) AS approval_rate"""
OUTBOUND_HEALTH_SQL = f"""
SELECT {DAY}, switch_id, approve, tot, {HEALTH} FROM (
  SELECT d.trx_dt, c.switch_id, count(*) FILTER (WHERE o.resp_cd = '00') AS approve, count(o.event_id) AS tot
  FROM days d CROSS JOIN (SELECT unnest(['PURC', 'SIGN', 'REFD']) AS switch_id) c
  LEFT JOIN outbound_log o ON o.trx_dt = d.trx_dt AND o.switch_id = c.switch_id
   AND (o.switch_id = 'PURC' OR o.trx_cd NOT IN ('#LOG_ON')) GROUP BY ALL)"""
OUTBOUND_HEALTH_RULES = (*v.OUTBOUND_RULES, *config.rules(v.SILENT_CHANNEL))


def _outbound_health(spark, sf):
    days = v.days(spark, sf)
    return dashboards.outbound_health(v.outbound_log(spark, sf), days, OUTBOUND_HEALTH_RULES)


@register("outbound_health", OUTBOUND_HEALTH_SQL)
def outbound_health(spark, sf):
    return _outbound_health(spark, sf)


@register("alert_outbound_failing", f"SELECT * FROM ({OUTBOUND_HEALTH_SQL}) WHERE failure_rate >= 25")
def alert_outbound_failing(spark, sf):
    return alerts.failing(_outbound_health(spark, sf), 25)


@register("inbound_health", f"""
SELECT {DAY}, switch_id, approve, tot, {HEALTH} FROM (
  SELECT d.trx_dt, c.switch_id, count(*) FILTER (WHERE p.rc = '00') AS approve, count(p.event_id) AS tot
  FROM days d CROSS JOIN (SELECT switch_id FROM channels UNION ALL SELECT 'REFD') c
  LEFT JOIN (SELECT * FROM pair5 WHERE bsns_cd <> 'ODS' AND trx_cd NOT IN ('ECHOMSG') AND rc NOT IN ('05')) p
  ON p.trx_dt = d.trx_dt AND p.switch_id = c.switch_id GROUP BY ALL)""")
def inbound_health(spark, sf):
    log = v.inbound_log(spark, sf)
    return dashboards.inbound_health(log, v.days(spark, sf), v.HEALTH_RULES, ("05",))


def _strip(spark, sf, windows_an_hour):
    """Windows over all days of the log: one, or one per hour."""
    first, last = v.day_bounds(spark, sf)
    end = datetime.combine(last, time()) + timedelta(days=1)
    hours = ((last - first).days + 1) * 24
    windows, width = (hours, 3600) if windows_an_hour else (1, hours * 3600)
    return throughput(v.inbound_log(spark, sf), v.outbound_log(spark, sf), end + timedelta(seconds=220), 220, width, windows)


LABEL = "(SELECT hi FROM strip_end) + INTERVAL 220 SECONDS"


@register("throughput_now", f"""
SELECT direction, strftime({LABEL}, '%Y-%m-%d %H:%M:%S') AS label, CAST(sum(approve) AS BIGINT) AS approve,
       CAST(sum(tot) AS BIGINT) AS tot FROM strip_hours GROUP BY ALL""")
def throughput_now(spark, sf):
    return _strip(spark, sf, 0).select(
        "direction", F.col("label_ts").alias("label"), "approve", "tot")


@register("throughput_strip", f"""
SELECT direction, CAST(window_no AS BIGINT) AS window_no,
       strftime({LABEL} - window_no * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS label,
       approve, tot, CAST(floor(100 * approve / nullif(tot, 0)) AS BIGINT) AS rate FROM strip_hours""")
def throughput_strip(spark, sf):
    return _strip(spark, sf, 1).select(
        "direction", "window_no", F.col("label_ts").alias("label"), "approve", "tot", "rate")


@register("rolling_strip", f"""
SELECT direction, CAST(window_no AS BIGINT) AS strip_no,
       strftime({LABEL} - window_no * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS label,
       CAST(sum(approve) OVER w AS BIGINT) AS approve, CAST(sum(tot) OVER w AS BIGINT) AS tot,
       array_to_string(list(tot) OVER w, ',') AS samples
FROM strip_hours
WINDOW w AS (PARTITION BY direction ORDER BY window_no DESC ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)""")
def rolling(spark, sf):
    return rolling_strip(_strip(spark, sf, 1)).select(
        "direction", "strip_no", F.col("label_ts").alias("label"), "approve", "tot", "samples")


ACTIVITY_SQL = """
SELECT trx_dt, substr(log_data, 7, 8) AS terminal, CASE WHEN trx_cd LIKE 'NPAY%' THEN 'WDL' ELSE 'TRF' END AS family,
       rc AS resp_cd, count(*) AS n
FROM pair4 WHERE switch_id = 'CLIC' AND trx_cd <> 'ECHOMSG' GROUP BY ALL"""


def _activity(spark, sf):
    return dashboards.terminal_activity(v.inbound_log(spark, sf), "CLIC", v.FAMILIES, v.ADMIN_MESSAGES,
                                        v.TERMINAL)


@register("terminal_activity", f"SELECT {DAY}, terminal, family, resp_cd, n FROM ({ACTIVITY_SQL})")
def terminal_activity(spark, sf):
    return _activity(spark, sf)


@register("terminal_score", f"""
SELECT {DAY}, terminal, CAST(least(100, floor(100 * px / tot)) AS BIGINT) AS x,
       CAST(least(100, floor(100 * py / tot)) AS BIGINT) AS y, tot FROM (
  SELECT trx_dt, terminal, CAST(sum(n) AS BIGINT) AS tot,
         coalesce(sum(CASE WHEN resp_cd = '00' THEN n ELSE -n END) FILTER (WHERE family = 'WDL'), 0) AS px,
         coalesce(sum(CASE WHEN resp_cd = '00' THEN n ELSE -n END) FILTER (WHERE family = 'TRF'), 0) AS py
  FROM ({ACTIVITY_SQL}) GROUP BY ALL)""")
def terminal_score(spark, sf):
    return dashboards.terminal_score(_activity(spark, sf))
