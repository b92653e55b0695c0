"""Channel, product, merchant and drill-down reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrail import config
from tallyrail.operators import dims, spine
from tallyrail.plans import billpay, channels, drilldown, merchants
from tallyrail.plans.channels import Segment
from tallyrail.registry import views as v
from tallyrail.registry.basic_queries import DAY, LAYOUT_SQL, layout_of
from tallyrail.registry.core import register
from tallyrail.session import work_dir
from tallyrail.sources.sinks import write_json_objects

RATES = """volume, errors, service_errors,
CAST(floor(100 * (volume - errors) / nullif(volume, 0)) AS BIGINT) AS cae,
CAST(floor(100 * (volume - service_errors) / nullif(volume, 0)) AS BIGINT) AS sar"""


def summary(spark, sf):
    return channels.two_rate_summary(v.inbound_log(spark, sf), v.outbound_log(spark, sf), v.INBOUND_RULES,
                                     v.OUTBOUND_RULES, v.CUSTOMER_CODES)


@register("two_rate_summary", f"SELECT {DAY}, switch_id, bsns_cd, {RATES} FROM two_rate")
def two_rate_summary(spark, sf):
    return summary(spark, sf)


@register("priority_order", f"""
SELECT {DAY}, switch_id, bsns_cd, {RATES}, CAST(coalesce(rank, 19) AS BIGINT) AS priority
FROM two_rate LEFT JOIN ranks USING (switch_id, bsns_cd)""")
def priority_order(spark, sf):
    ranked = dims.with_priority(summary(spark, sf), dims.channel_ranks(spark, v.RANKS))
    return ranked.orderBy("trx_dt", "priority", "switch_id", "bsns_cd")


def _counts(spark, sf):
    return channels.leg_counts(v.inbound_log(spark, sf), v.outbound_log(spark, sf), v.INBOUND_RULES,
                               v.OUTBOUND_RULES)


@register("leg_mix_summary", """
SELECT CAST(s.trx_dt AS VARCHAR) AS trx_dt, s.switch_id, s.bsns_cd, volume, errors,
       CAST(floor(100 * (volume - errors) / nullif(volume, 0)) AS BIGINT) AS success_rate, error_codes
FROM (SELECT trx_dt, switch_id, bsns_cd,
        CAST(coalesce(sum(n) FILTER (WHERE io_cd IN ('I', 'A')), 0) AS BIGINT) AS volume,
        CAST(coalesce(sum(n) FILTER (WHERE io_cd IN ('O', 'A') AND resp_cd IS DISTINCT FROM '00'), 0) AS BIGINT) AS errors
      FROM leg_rows GROUP BY ALL) s
LEFT JOIN leg_digest USING (trx_dt, switch_id, bsns_cd)""")
def leg_mix_summary(spark, sf):
    return channels.leg_mix_summary(_counts(spark, sf))


@register("error_code_digest", f"SELECT {DAY}, switch_id, bsns_cd, error_codes FROM leg_digest")
def digest(spark, sf):
    return channels.leg_digest(_counts(spark, sf))


@register("active_channels", f"""
SELECT {DAY}, switch_id, bsns_cd, CAST(coalesce(rank, 18) AS BIGINT) AS priority FROM (
  SELECT DISTINCT trx_dt, switch_id, bsns_cd FROM inbound_log
  WHERE switch_id IN ('VIEW', 'PURC', 'SIGN') OR (switch_id = 'CLIC' AND bsns_cd <> 'ODS')
     OR (switch_id = 'ERRO' AND trx_cd <> 'ECHOMSG')
  UNION
  SELECT DISTINCT trx_dt, switch_id, 'EB1' FROM outbound_log
  WHERE switch_id = 'PURC' OR (switch_id = 'SIGN' AND trx_cd <> '#LOG_ON'))
LEFT JOIN ranks USING (switch_id, bsns_cd)""")
def active_channels(spark, sf):
    active = channels.active_channels(v.inbound_log(spark, sf), v.outbound_log(spark, sf), v.INBOUND_RULES,
                                      v.OUTBOUND_RULES)
    return dims.with_priority(active, dims.channel_ranks(spark, v.RANKS), last=18).select(
        "trx_dt", "switch_id", "bsns_cd", "priority")


# Message catalog report: CLIC shows its business codes apart and also takes the calls of PURC and SIGN,
# whose codes start with 'O'; their business code is read from the response payload.
FACTS_SQL = """, code_rows AS (
  SELECT trx_dt, switch_id, CASE WHEN switch_id = 'CLIC' THEN bsns_cd ELSE 'EB1' END AS bsns_cd, trx_cd, resp_cd FROM (
    {pairs}
    UNION ALL
    SELECT trx_dt, 'CLIC', substr(o_log_data, 1, 3), trx_cd, resp_cd FROM outbound_log
    WHERE switch_id IN ('PURC', 'SIGN') AND trx_cd LIKE 'O%')),
coverage AS (
  SELECT days.trx_dt, m.switch_id, CASE WHEN m.switch_id = 'CLIC' THEN r.bsns_cd ELSE 'EB1' END AS bsns_cd, m.trx_cd,
         r.resp_cd, count(r.resp_cd) AS n
  FROM ({codes}) m CROSS JOIN days LEFT JOIN code_rows r
  ON r.switch_id = m.switch_id AND r.trx_cd = m.trx_cd AND r.trx_dt = days.trx_dt GROUP BY ALL),
code_sums AS (
  SELECT trx_dt, switch_id, bsns_cd, trx_cd, CAST(sum(n) AS BIGINT) AS volume,
         CAST(coalesce(sum(n) FILTER (WHERE resp_cd <> '00'), 0) AS BIGINT) AS errors,
         CAST(coalesce(sum(n) FILTER (WHERE resp_cd NOT IN ('00', '51', '91')), 0) AS BIGINT) AS service_errors
  FROM coverage GROUP BY ALL)
"""
CODES_SQL = "SELECT switch_id, trx_cd FROM messages UNION ALL SELECT 'CLIC', 'OPAYMNT'"


def _catalog(spark, extra):
    rows = dims.catalog_rows(v.catalog(spark), config.MESSAGE_CATALOG, not_prefix=config.INACTIVE_PREFIX)
    return dims.extend_catalog(rows, [
        {"cnts_nm": config.MESSAGE_CATALOG, "cnts_1": code, "cnts_5": "CLIC"} for code in extra])


@register("catalog_coverage", FACTS_SQL.format(
    pairs="SELECT trx_dt, switch_id, bsns_cd, trx_cd, rc AS resp_cd FROM pair4", codes=CODES_SQL) + """
SELECT CAST(s.trx_dt AS VARCHAR) AS trx_dt, s.switch_id, s.bsns_cd, s.trx_cd, volume, errors,
       CAST(floor(100 * (volume - errors) / nullif(volume, 0)) AS BIGINT) AS success_rate, d.error_codes
FROM code_sums s LEFT JOIN (
  SELECT trx_dt, switch_id, bsns_cd, trx_cd, string_agg(resp_cd, ',' ORDER BY n, resp_cd) AS error_codes FROM (
    SELECT *, row_number() OVER (PARTITION BY trx_dt, switch_id, bsns_cd, trx_cd ORDER BY n, resp_cd) AS rn
    FROM coverage WHERE resp_cd <> '00' AND n > 0) WHERE rn <= 5 GROUP BY ALL) d
ON d.trx_dt = s.trx_dt AND d.switch_id = s.switch_id AND d.bsns_cd IS NOT DISTINCT FROM s.bsns_cd AND d.trx_cd = s.trx_cd""")
def catalog_coverage(spark, sf):
    return channels.catalog_coverage(channels.catalog_counts(
        v.inbound_log(spark, sf), v.outbound_log(spark, sf), _catalog(spark, ["OPAYMNT"]),
        split_channels=("CLIC",), outbound_feeds={"CLIC": ("PURC", "SIGN")}, outbound_field=(1, 3),
        outbound_prefix="O", days=v.day_bounds(spark, sf)))


@register("catalog_two_rate", FACTS_SQL.format(
    pairs="""SELECT trx_dt, switch_id, bsns_cd, trx_cd, rc AS resp_cd FROM pair4
    WHERE switch_id <> 'CLIC' AND NOT (switch_id = 'ERRO' AND trx_cd = 'NPAYMNT')
    UNION ALL SELECT trx_dt, switch_id, bsns_cd, trx_cd, rc FROM pair5 WHERE switch_id = 'CLIC' AND bsns_cd <> 'ODS'
    UNION ALL SELECT trx_dt, switch_id, bsns_cd, trx_cd, resp_cd FROM pair3 WHERE switch_id = 'ERRO' AND trx_cd = 'NPAYMNT'""",
    codes=CODES_SQL + " UNION ALL SELECT 'CLIC', 'NINWARD'") + f"""
SELECT {DAY}, switch_id, bsns_cd, trx_cd, {RATES} FROM code_sums""")
def catalog_two_rate(spark, sf):
    return channels.catalog_two_rate(channels.catalog_counts(
        v.inbound_log(spark, sf), v.outbound_log(spark, sf), _catalog(spark, ["OPAYMNT", "NINWARD"]),
        split_channels=("CLIC",), outbound_feeds={"CLIC": ("PURC", "SIGN")}, outbound_field=(1, 3),
        outbound_prefix="O", days=v.day_bounds(spark, sf), request_coded={"ERRO": v.PAYMENTS}, strict_channels=("CLIC",)),
        v.CUSTOMER_CODES)


SEGMENTS = (
    Segment("PAY VIEW", "VIEW", prefix="NPAY"),
    Segment("PAY SIGN", "SIGN", prefix="NPAY"),
    Segment("LOCAL", "ERRO", home=True),
    Segment("OVERSEAS", "ERRO", home=False),
)
SEGMENT_SQL = """, segmented AS (
  SELECT 'PAY VIEW' AS segment, * FROM pair5 WHERE switch_id = 'VIEW' AND trx_cd LIKE 'NPAY%'
  UNION ALL SELECT 'PAY SIGN', * FROM pair5 WHERE switch_id = 'SIGN' AND trx_cd LIKE 'NPAY%'
  UNION ALL SELECT 'LOCAL', * FROM pair5 WHERE switch_id = 'ERRO' AND substr(log_data, 20, 2) = 'ID'
  UNION ALL SELECT 'OVERSEAS', * FROM pair5 WHERE switch_id = 'ERRO' AND substr(log_data, 20, 2) <> 'ID')
"""


@register("card_segments", SEGMENT_SQL + f"""
SELECT {DAY}, segment, bsns_cd, {RATES} FROM (
  SELECT trx_dt, segment, bsns_cd, count(*) AS volume,
         count(*) FILTER (WHERE rc IS DISTINCT FROM '00') AS errors,
         count(*) FILTER (WHERE rc IS NULL OR rc NOT IN ('00', '51', '91')) AS service_errors
  FROM segmented GROUP BY ALL)""")
def card_segments(spark, sf):
    return channels.card_segments(v.inbound_log(spark, sf), SEGMENTS, v.COUNTRY, v.CUSTOMER_CODES)


@register("hourly_segment", SEGMENT_SQL + """
SELECT CAST(h.trx_dt AS VARCHAR) AS trx_dt, h.hour, segment, bsns_cd, resp_cd, n
FROM hours h LEFT JOIN (
  SELECT trx_dt, strftime(event_ts, '%H') AS hour, segment, bsns_cd, rc AS resp_cd, count(*) AS n
  FROM segmented GROUP BY ALL) s ON s.trx_dt = h.trx_dt AND s.hour = h.hour""")
def hourly_segment(spark, sf):
    log = v.inbound_log(spark, sf)
    axis = spine.hour_spine(v.days(spark, sf))
    return spine.on_spine(axis, channels.segment_hours(log, SEGMENTS, v.COUNTRY), ["trx_dt", "hour"])


@register("hourly_detail", """
SELECT CAST(h.trx_dt AS VARCHAR) AS trx_dt, h.hour, trx_cd, resp_cd, n
FROM hours h LEFT JOIN (
  SELECT trx_dt, strftime(event_ts, '%H') AS hour, trx_cd, rc AS resp_cd, count(*) AS n FROM pair5
  WHERE switch_id = 'CLIC' AND bsns_cd <> 'ODS' AND trx_cd = 'NPAYMNT' GROUP BY ALL) s
ON s.trx_dt = h.trx_dt AND s.hour = h.hour""")
def hourly_detail(spark, sf):
    log = v.inbound_log(spark, sf)
    return drilldown.hourly_detail(log, v.days(spark, sf), "CLIC", "NPAYMNT")


@register("hourly_pivot", """
SELECT CAST(h.trx_dt AS VARCHAR) AS trx_dt, h.hour, "00", "51", "05", "91"
FROM hours h LEFT JOIN (
  SELECT trx_dt, strftime(event_ts, '%H') AS hour,
         nullif(count(*) FILTER (WHERE rc = '00'), 0) AS "00", nullif(count(*) FILTER (WHERE rc = '51'), 0) AS "51",
         nullif(count(*) FILTER (WHERE rc = '05'), 0) AS "05", nullif(count(*) FILTER (WHERE rc = '91'), 0) AS "91"
  FROM pair5 WHERE switch_id = 'CLIC' AND bsns_cd <> 'ODS' GROUP BY ALL) s
ON s.trx_dt = h.trx_dt AND s.hour = h.hour""")
def hourly_pivot(spark, sf):
    log = v.inbound_log(spark, sf)
    wide = drilldown.hourly_pivot(drilldown.hourly_codes(log, "CLIC"), ["00", "51", "05", "91"])
    return spine.on_spine(spine.hour_spine(v.days(spark, sf)), wide, ["trx_dt", "hour"])


@register("hourly_channel", """
SELECT CAST(h.trx_dt AS VARCHAR) AS trx_dt, h.hour, direction, trx_cd, resp_cd, n
FROM hours h LEFT JOIN (
  SELECT trx_dt, strftime(event_ts, '%H') AS hour, 'INC' AS direction, trx_cd, rc AS resp_cd, count(*) AS n
  FROM pair5 WHERE switch_id = 'PURC' AND bsns_cd <> 'ODS' AND trx_cd <> 'ECHOMSG' AND trx_cd NOT LIKE '%LOG%'
  GROUP BY ALL
  UNION ALL
  SELECT trx_dt, strftime(event_ts, '%H'), 'OUT', trx_cd, resp_cd, count(*) FROM outbound_log
  WHERE switch_id = 'PURC' AND trx_cd <> 'ECHOMSG' AND trx_cd NOT LIKE '%LOG%' GROUP BY ALL) s
ON s.trx_dt = h.trx_dt AND s.hour = h.hour""")
def hourly_channel(spark, sf):
    log = v.inbound_log(spark, sf)
    return drilldown.hourly_channel(log, v.outbound_log(spark, sf), v.days(spark, sf), "PURC",
                                    exclude=v.ADMIN_MESSAGES)


@register("hourly_product", """
SELECT CAST(h.trx_dt AS VARCHAR) AS trx_dt, h.hour, trx_type, product_cd, product, resp_cd, n
FROM hours h LEFT JOIN (
  SELECT trx_dt, strftime(event_ts, '%H') AS hour,
         CASE WHEN trx_cd = 'NINQURY' THEN 'Inquiry' ELSE 'Payment/Purchase' END AS trx_type,
         product_cd, product, rc AS resp_cd, count(*) AS n
  FROM pair4 JOIN products ON product_cd = substr(log_data, 15, 5)
  WHERE switch_id IN ('CLIC', 'ERRO', 'VIEW') AND trx_cd IN ('NPAYMNT', 'NINQURY') AND product_cd = 'P0003'
  GROUP BY ALL) s ON s.trx_dt = h.trx_dt AND s.hour = h.hour""")
def hourly_product(spark, sf):
    log = v.inbound_log(spark, sf)
    facts = billpay.product_hours(log, v.catalog(spark), "P0003", v.BILL_CHANNELS, v.PAYMENTS, v.INQUIRIES,
                                  v.PRODUCT)
    return spine.on_spine(spine.hour_spine(v.days(spark, sf)), facts, ["trx_dt", "hour"])


@register("billpay_monitor", f"""
SELECT {DAY}, product, count(*) FILTER (WHERE rc = '00') AS approve, count(*) AS tot,
       CAST(floor(100 * count(*) FILTER (WHERE rc = '00') / count(*) + 0.5) AS BIGINT) AS rate
FROM pair4 JOIN products ON product_cd = substr(log_data, 15, 5)
WHERE switch_id IN ('CLIC', 'ERRO', 'VIEW') AND trx_cd = 'NPAYMNT'
GROUP BY trx_dt, product""")
def billpay_monitor(spark, sf):
    return billpay.billpay_monitor(v.inbound_log(spark, sf), v.catalog(spark), v.BILL_CHANNELS, v.PAYMENTS,
                                   v.PRODUCT)


@register("billpay_report", f""", payloads AS (
  SELECT DISTINCT trx_dt, switch_id, bsns_cd, trx_cd, product, rc, log_data
  FROM pair4 JOIN products ON product_cd = substr(log_data, 15, 5)
  WHERE switch_id IN ('CLIC', 'ERRO', 'VIEW') AND trx_cd IN ('NPAYMNT', 'NINQURY')),
typed AS (
  SELECT trx_dt, switch_id, bsns_cd, product, rc, count(*) AS n,
         CASE WHEN trx_cd = 'NINQURY' THEN 'Inquiry' ELSE 'Payment/Purchase' END AS trx_type
  FROM payloads GROUP BY ALL),
sums AS (
  SELECT trx_dt, switch_id, bsns_cd, trx_type, product, CAST(sum(n) AS BIGINT) AS volume,
         CAST(coalesce(sum(n) FILTER (WHERE rc IS DISTINCT FROM '00'), 0) AS BIGINT) AS errors,
         CAST(coalesce(sum(n) FILTER (WHERE rc IS NULL OR rc NOT IN ('00', '51', '91')), 0) AS BIGINT) AS service_errors,
         string_agg(rc, ',' ORDER BY n, rc) FILTER (WHERE rc <> '00' AND rn <= 5) AS error_codes
  FROM (SELECT *, row_number() OVER (PARTITION BY trx_dt, switch_id, bsns_cd, trx_type, product, coalesce(rc, '00') = '00'
                                     ORDER BY n, rc) AS rn FROM typed) GROUP BY ALL)
SELECT {DAY}, switch_id, bsns_cd, trx_type, product, {RATES}, error_codes FROM sums""")
def billpay_report(spark, sf):
    counts = billpay.payload_counts(v.inbound_log(spark, sf), v.catalog(spark), v.BILL_CHANNELS, v.PAYMENTS,
                                    v.INQUIRIES, v.PRODUCT)
    return billpay.billpay_report(counts, v.INQUIRIES, v.CUSTOMER_CODES)


@register("layout_extract", LAYOUT_SQL + f""", places AS (
  SELECT trx_cd, max(position) FILTER (WHERE field_nm = 'CCY_CD') AS cp,
         max(position) FILTER (WHERE field_nm = 'TRX_AMT') AS ap FROM offsets GROUP BY ALL)
SELECT switch_id, ccy, CAST(amt AS DOUBLE) AS amt, {DAY}, strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS event_ts,
       ret_ref_no, trx_cd, bsns_cd, resp_cd FROM (
  SELECT a.*, substr(log_data, CAST(cp AS BIGINT), 3) AS ccy,
         CAST(CAST(substr(log_data, CAST(ap AS BIGINT), 12) AS BIGINT) / 100 AS DECIMAL(18, 2)) AS amt
  FROM a LEFT JOIN places USING (trx_cd)
  UNION ALL
  SELECT event_id, trx_dt, event_ts, switch_id, bsns_cd, 'A', trx_cd, resp_cd, trc_ad_no, ret_ref_no, i_log_data,
         coalesce(substr(i_log_data, CAST(cp AS BIGINT), 3), ' '),
         coalesce(CAST(CAST(substr(i_log_data, CAST(ap AS BIGINT), 12) AS BIGINT) / 100 AS DECIMAL(18, 2)), 0)
  FROM outbound_log LEFT JOIN places USING (trx_cd))""")
def layout_extract(spark, sf):
    return drilldown.transaction_detail(v.inbound_log(spark, sf), v.outbound_log(spark, sf),
                                        layout_of(spark), scale=2)


@register("transaction_rows", f"""
SELECT {DAY}, strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS event_ts, io_cd, trx_cd, resp_cd FROM inbound_log
WHERE (switch_id, trc_ad_no, ret_ref_no) IN (
  SELECT DISTINCT last(switch_id ORDER BY event_ts, event_id), last(trc_ad_no ORDER BY event_ts, event_id),
         last(ret_ref_no ORDER BY event_ts, event_id) FROM inbound_log)""")
def transaction_rows(spark, sf):
    """All rows of the transaction that the log's last row belongs to."""
    log = v.inbound_log(spark, sf)
    key = F.struct("event_ts", "event_id")
    last = log.agg(*[F.max_by(c, key).alias(c) for c in ("switch_id", "trc_ad_no", "ret_ref_no")]).first()
    return drilldown.correlated(log, last.switch_id, last.trc_ad_no, last.ret_ref_no).select(
        "trx_dt", "event_ts", "io_cd", "trx_cd", "resp_cd")


@register("by_auth_flag", """
SELECT CASE onoff WHEN '05' THEN 'Success 3DS' WHEN '06' THEN 'Trying 3DS' WHEN '07' THEN 'Failed 3DS'
       ELSE coalesce(onoff, 'OFFLINE') END AS name, onoff, count(*) AS n FROM card_txn GROUP BY ALL""")
def by_auth_flag(spark, sf):
    return merchants.by_auth_flag(v.card_txn(spark, sf))


@register("top_merchants", """
SELECT merchant_name, location, count(*) AS freq_trx, CAST(sum(trx_amount) AS DOUBLE) AS total_trx
FROM card_txn WHERE merchant_name IS NOT NULL GROUP BY ALL
ORDER BY freq_trx DESC, merchant_name, location LIMIT 10""")
def top_merchants(spark, sf):
    return merchants.top_merchants(v.card_txn(spark, sf))


@register("top_categories", """
SELECT mcc, CASE mcc WHEN '5712' THEN 'Furniture' WHEN '0763' THEN 'Agricultural Cooperatives'
       WHEN '5300' THEN 'Wholesale Clubs' ELSE mcc END AS title, count(*) AS freq_trx,
       CAST(sum(trx_amount) AS DOUBLE) AS total_trx
FROM (SELECT CASE WHEN length(trim(merchant_tp)) < 4 THEN lpad(trim(merchant_tp), 4, '0')
             ELSE trim(merchant_tp) END AS mcc, trx_amount FROM card_txn WHERE merchant_tp IS NOT NULL)
GROUP BY ALL ORDER BY freq_trx DESC, mcc LIMIT 10""")
def top_categories(spark, sf):
    return merchants.top_categories(v.card_txn(spark, sf), v.titles(spark))


REGION_SQL = """
SELECT name, total_trx, CAST(trx_amt_total AS DOUBLE) AS trx_amt_total,
       round(CAST(trx_amt_total AS DOUBLE) / total_trx, 2) AS trx_amt_avg FROM (
  SELECT p.code_nm AS name, count(*) AS total_trx, sum(trx_amount) AS trx_amt_total
  FROM (SELECT {distinct} merchant_name, loc, trx_amount, code1
        FROM (SELECT merchant_name, trim(upper(substr(location, 1, 8))) AS loc, trx_amount FROM card_txn) t
        LEFT JOIN code_table c ON c.type = 'CITY' AND contains(c.code_nm, t.loc)) h
  JOIN code_table p ON p.type = 'PROV' AND p.code = h.code1 GROUP BY ALL)"""


def _regions(spark, sf, dedupe):
    rolled = merchants.region_rollup(v.card_txn(spark, sf), v.code_table(spark, sf), "CITY", "PROV", dedupe)
    return rolled.withColumn("trx_amt_avg", F.round(F.col("trx_amt_avg").cast("double"), 2))


@register("region_rollup", REGION_SQL.format(distinct="DISTINCT"))
def region_rollup(spark, sf):
    return _regions(spark, sf, True)


@register("region_rollup_all", REGION_SQL.format(distinct=""))
def region_rollup_all(spark, sf):
    return _regions(spark, sf, False)


@register("region_json", """
SELECT name, total_trx AS "value", format('{:,.2f}', CAST(trx_amt_total AS DOUBLE)) AS trx_amt_total,
       format('{:,.2f}', trx_amt_avg) AS trx_amt_avg
FROM (""" + REGION_SQL.format(distinct="DISTINCT") + ")")
def region_json(spark, sf):
    path = work_dir(spark, "region_json")
    write_json_objects(
        merchants.region_rollup(v.card_txn(spark, sf), v.code_table(spark, sf), "CITY", "PROV"), path,
        {"name": "name", "total_trx": "value", "trx_amt_total": "trx_amt_total", "trx_amt_avg": "trx_amt_avg"},
        ["trx_amt_total", "trx_amt_avg"])
    return spark.read.schema("name string, value long, trx_amt_total string, trx_amt_avg string").json(path)
