"""The derived tables of `views.py` as SQL, put in front of every comparison query."""

VIEWS = """
WITH base_log AS (
  SELECT event_id, ts AS event_ts, CAST(ts AS DATE) AS trx_dt, upper(substr(event_type, 1, 4)) AS switch_id,
         CASE WHEN user_id % 3 = 0 THEN 'PBK' WHEN user_id % 3 = 1 THEN 'MBK' ELSE 'ODS' END AS bsns_cd,
         lpad(CAST(event_id % 50 AS VARCHAR), 6, '0') AS trc_ad_no,
         lpad(CAST(event_id AS VARCHAR), 12, '0') AS ret_ref_no,
         CAST(substr(props, 7, length(props) - 7) AS INT) AS k,
         concat(lpad(CAST(event_id % 50 AS VARCHAR), 6, '0'), lpad(CAST(user_id AS VARCHAR), 8, '0'),
                concat('P000', CAST(user_id % 6 AS VARCHAR)),
                CASE WHEN user_id % 4 = 0 THEN 'SG' ELSE 'ID' END,
                lpad(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), 12, '0'), 'IDR') AS log_data
  FROM events),
coded_log AS (
  SELECT *, CASE WHEN k < 80 THEN '00' WHEN k < 84 THEN '51' WHEN k < 88 THEN '05' WHEN k < 91 THEN '91'
                 WHEN k < 98 THEN (['12', '13', '14', '54', '61', '68', '75'])[k - 90] END AS code,
         CASE WHEN k % 5 = 0 THEN 'ECHOMSG' WHEN k % 2 = 0 THEN 'NPAYMNT' ELSE 'NINQURY' END AS msg
  FROM base_log),
a AS (
  SELECT event_id, trx_dt, event_ts, switch_id, bsns_cd, 'I' AS io_cd, msg AS trx_cd,
         CAST(NULL AS VARCHAR) AS resp_cd, trc_ad_no, ret_ref_no, log_data FROM coded_log),
b AS (
  SELECT event_id, trx_dt, event_ts + INTERVAL 2 SECONDS AS event_ts, switch_id,
         CASE WHEN event_id % 13 = 0 THEN 'ODS' ELSE bsns_cd END AS bsns_cd, 'O' AS io_cd, msg AS trx_cd,
         code AS resp_cd, trc_ad_no, ret_ref_no, log_data FROM coded_log WHERE event_id % 20 <> 0),
inbound_log AS (SELECT * FROM a UNION ALL SELECT * FROM b),
outbound_log AS (
  SELECT event_id, trx_dt, event_ts, switch_id, bsns_cd,
         CASE WHEN k % 5 = 0 THEN '#LOG_ON' ELSE 'OPAYMNT' END AS trx_cd, code AS resp_cd,
         CASE WHEN k % 3 = 0 THEN NULL
              WHEN k % 3 = 1 THEN concat('host [', CASE WHEN k % 2 = 0 THEN '00' ELSE '68' END, ']')
              ELSE 'host ok' END AS resp_val,
         trc_ad_no, ret_ref_no, log_data AS i_log_data, reverse(log_data) AS o_log_data
  FROM coded_log WHERE switch_id IN ('PURC', 'SIGN')),
outbound_eff AS (
  SELECT *, CASE WHEN resp_cd IS NULL THEN '93' WHEN resp_cd <> '00' THEN resp_cd
                 WHEN resp_val IS NULL THEN '00'
                 WHEN regexp_matches(resp_val, '\\[..\\]') THEN regexp_extract(resp_val, '\\[(..)\\]', 1)
                 ELSE '93' END AS eff_cd
  FROM outbound_log),
pair3 AS (
  SELECT a.*, b.resp_cd AS rc FROM a JOIN b ON a.trx_dt = b.trx_dt AND a.switch_id = b.switch_id
     AND a.trc_ad_no = b.trc_ad_no),
pair4 AS (
  SELECT a.*, b.resp_cd AS rc, b.bsns_cd AS resp_bsns FROM a JOIN b ON a.trx_dt = b.trx_dt
     AND a.switch_id = b.switch_id AND a.trc_ad_no = b.trc_ad_no AND a.ret_ref_no = b.ret_ref_no),
pair5 AS (SELECT * FROM pair4 WHERE resp_bsns = bsns_cd),
price_feed AS (
  SELECT trx_dt AS feed_dt, event_ts, substr(trc_ad_no, 4, 3) AS ric FROM base_log WHERE switch_id = 'VIEW'),
card_txn AS (
  SELECT CAST(o.o_orderdate AS DATE) AS trx_dt, c.c_name AS merchant_name,
         concat('NATION_', CAST(c.c_nationkey % 10 AS VARCHAR)) AS location,
         CASE c.c_mktsegment WHEN 'FURNITURE' THEN ' 5712' WHEN 'BUILDING' THEN '763'
              WHEN 'MACHINERY' THEN '5300' ELSE c.c_mktsegment END AS merchant_tp,
         CAST(o.o_totalprice AS DECIMAL(18, 2)) AS trx_amount,
         CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN '05' WHEN '2' THEN '06' WHEN '3' THEN '07'
              WHEN '5' THEN '09' END AS onoff
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
code_table AS (
  SELECT 'CITY' AS type, CAST(n_nationkey AS VARCHAR) AS code, n_name AS code_nm,
         CAST(n_regionkey AS VARCHAR) AS code1 FROM nation
  UNION ALL
  SELECT 'PROV', CAST(r_regionkey AS VARCHAR), r_name, NULL FROM region),
products AS (
  SELECT concat('P000', CAST(i AS VARCHAR)) AS product_cd, concat('Product ', CAST(i AS VARCHAR)) AS product
  FROM range(7) r(i)),
channels AS (SELECT unnest(['CLIC', 'ERRO', 'VIEW', 'PURC', 'SIGN']) AS switch_id),
messages AS (
  SELECT switch_id, trx_cd FROM channels, (SELECT unnest(['NPAYMNT', 'NINQURY', 'NREFUND']) AS trx_cd)),
ranks AS (
  SELECT * FROM (VALUES ('CLIC', 'MBK', 1), ('CLIC', 'PBK', 2), ('ERRO', 'MBK', 3), ('ERRO', 'PBK', 4),
    ('VIEW', 'PBK', 5), ('PURC', 'EB1', 6), ('SIGN', 'EB1', 7)) r(switch_id, bsns_cd, rank)),
days AS (
  SELECT CAST(unnest(generate_series(min(trx_dt), max(trx_dt), INTERVAL 1 DAY)) AS DATE) AS trx_dt
  FROM inbound_log),
hours AS (SELECT trx_dt, lpad(CAST(h AS VARCHAR), 2, '0') AS hour FROM days, range(24) r(h)),
polls AS (
  SELECT unnest(generate_series(
    date_trunc('hour', min(event_ts) + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND),
    date_trunc('hour', max(event_ts) + INTERVAL 1 HOUR), INTERVAL 1 HOUR)) AS poll_ts
  FROM inbound_log),
spine AS (
  SELECT poll_ts, i AS slot_no,
         time_bucket(INTERVAL 10 MINUTES, poll_ts - INTERVAL 60 MINUTES) + i * INTERVAL 5 MINUTES AS slot_ts
  FROM polls, range(13) r(i)),
summary_rows AS (
  SELECT trx_dt, switch_id, bsns_cd, rc FROM pair5
  WHERE switch_id IN ('VIEW', 'PURC', 'SIGN') OR (switch_id = 'CLIC' AND bsns_cd <> 'ODS')
     OR (switch_id = 'ERRO' AND trx_cd <> 'ECHOMSG')
  UNION ALL
  SELECT trx_dt, switch_id, 'EB1', eff_cd FROM outbound_eff
  WHERE switch_id = 'PURC' OR (switch_id = 'SIGN' AND trx_cd <> '#LOG_ON')),
two_rate AS (
  SELECT trx_dt, switch_id, bsns_cd, count(*) AS volume,
         count(*) FILTER (WHERE rc IS DISTINCT FROM '00') AS errors,
         count(*) FILTER (WHERE rc IS NULL OR rc NOT IN ('00', '51', '91')) AS service_errors
  FROM summary_rows GROUP BY ALL),
leg_rows AS (
  SELECT trx_dt, switch_id, bsns_cd, io_cd, resp_cd, count(*) AS n FROM (
    SELECT trx_dt, switch_id, bsns_cd, io_cd, resp_cd FROM inbound_log
    WHERE switch_id IN ('VIEW', 'PURC', 'SIGN') OR (switch_id = 'CLIC' AND bsns_cd <> 'ODS')
       OR (switch_id = 'ERRO' AND trx_cd <> 'ECHOMSG')
    UNION ALL
    SELECT trx_dt, switch_id, 'EB1', 'A', resp_cd FROM outbound_log
    WHERE switch_id = 'PURC' OR (switch_id = 'SIGN' AND trx_cd <> '#LOG_ON')) GROUP BY ALL),
leg_digest AS (
  SELECT trx_dt, switch_id, bsns_cd, string_agg(resp_cd, ',' ORDER BY rn) AS error_codes FROM (
    SELECT *, row_number() OVER (PARTITION BY trx_dt, switch_id, bsns_cd ORDER BY io_cd, n, resp_cd) AS rn
    FROM leg_rows WHERE io_cd IN ('O', 'A') AND resp_cd <> '00') WHERE rn <= 5 GROUP BY ALL),
strip_end AS (SELECT CAST(max(trx_dt) + 1 AS TIMESTAMP) AS hi, count(*) * 24 AS n FROM days),
strip_hours AS (
  SELECT direction, window_no, count(rc) FILTER (WHERE rc = '00') AS approve, count(eid) AS tot
  FROM (SELECT i AS window_no, d AS direction, hi - (i + 1) * INTERVAL 1 HOUR AS lo
        FROM (SELECT unnest(range(0, n)) AS i, hi FROM strip_end), (SELECT unnest(['INC', 'OUT']) AS d)) w
  LEFT JOIN (
    SELECT 'INC' AS dir, date_trunc('hour', event_ts) AS h, rc, event_id AS eid FROM pair5 WHERE bsns_cd <> 'ODS'
    UNION ALL
    SELECT 'OUT', date_trunc('hour', event_ts), resp_cd, event_id FROM outbound_log) e
  ON e.h = w.lo AND e.dir = w.direction GROUP BY ALL)
"""


def slots(facts: str, channels: str) -> str:
    """Slot series of hourly polls over `facts` (switch_id, event_ts, rc)."""
    listed = ", ".join(f"'{c}'" for c in channels.split())
    return f""", facts AS ({facts}),
grid AS (SELECT s.*, c.switch_id FROM spine s, (SELECT unnest([{listed}]) AS switch_id) c),
series AS (
  SELECT g.poll_ts, g.slot_no, g.slot_ts, g.switch_id, count(*) FILTER (WHERE f.rc = '00') AS approve,
         count(f.event_ts) AS tot
  FROM grid g LEFT JOIN facts f ON f.switch_id = g.switch_id
   AND time_bucket(INTERVAL 5 MINUTES, f.event_ts) = g.slot_ts
   AND f.event_ts BETWEEN g.poll_ts - INTERVAL 60 MINUTES AND g.poll_ts
  GROUP BY ALL),
rated AS (
  SELECT *, CAST(floor(100 * approve / nullif(tot, 0)) AS BIGINT) AS rate FROM series)
"""


SLOT_COLUMNS = """strftime(poll_ts, '%Y-%m-%d %H:%M:%S') AS poll_ts, CAST(slot_no AS BIGINT) AS slot_no,
strftime(slot_ts, '%H:%M') AS slot, switch_id, approve, tot, rate"""
