"""Scans, filters, lookups, pairing and spines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrail import config, schemas
from tallyrail.functions.codes import decode_values, effective_resp_code
from tallyrail.functions.rates import n_rows
from tallyrail.functions.text import field
from tallyrail.functions.timeaxis import hour_label, slot_label
from tallyrail.operators import dims, legs, payload, spine
from tallyrail.operators.legs import KEYS_3, KEYS_4, KEYS_5, approval_measures, requests, responses
from tallyrail.plans.billpay import products
from tallyrail.registry import views as v
from tallyrail.registry.core import register
from tallyrail.session import work_dir
from tallyrail.sources import ingest, readers, sinks

DAY = "CAST(trx_dt AS VARCHAR) AS trx_dt"


@register("ingest_log", f"""
SELECT {DAY}, concat(CAST(trx_dt AS VARCHAR), ' ', strftime(event_ts, '%H:%M:%S')) AS event_ts, io_cd, switch_id,
       bsns_cd, trx_cd, resp_cd, ret_ref_no, log_data FROM inbound_log""")
def ingest_log(spark, sf):
    raw = v.raw_inbound(spark, sf)
    return ingest.to_table(raw, schemas.INBOUND_LOG, ingest.LOG_TIMES, {"TRACE_AD_NO": "trc_ad_no"}).select(
        "trx_dt", "event_ts", "io_cd", "switch_id", "bsns_cd", "trx_cd", "resp_cd", "ret_ref_no", "log_data")


@register("ingest_rejects", f"""
SELECT {DAY}, count(*) FILTER (WHERE ret_ref_no LIKE '%7') AS event_ts, CAST(0 AS BIGINT) AS reg_ts
FROM inbound_log GROUP BY ALL""")
def ingest_rejects(spark, sf):
    """Rows per day without a usable time, of a log in which every tenth time text is none."""
    raw = v.raw_inbound(spark, sf)
    spoilt = F.when(F.col("RET_REF_NO").endswith("7"), "25:61:00").otherwise(F.col("TRX_TM"))
    return ingest.rejected_times(raw.withColumn("TRX_TM", spoilt), ingest.LOG_TIMES)


@register("scan_today", f"SELECT event_id, io_cd, {DAY}, switch_id, trx_cd FROM inbound_log "
                        "WHERE trx_dt = DATE '2024-01-15'")
def scan_today(spark, sf):
    return readers.scan_day(v.inbound_log(spark, sf), v.AS_OF).select(
        "event_id", "io_cd", "trx_dt", "switch_id", "trx_cd")


@register("scan_trailing_days", f"""
SELECT {DAY}, merchant_name, location, CAST(trx_amount AS DOUBLE) AS trx_amount FROM card_txn
WHERE trx_dt >= DATE '2001-07-02'""")
def scan_trailing_days(spark, sf):
    return readers.scan_trailing_days(v.card_txn(spark, sf), v.CARD_AS_OF, 30).select(
        "trx_dt", "merchant_name", "location", "trx_amount")


@register("catalog_lookup", """
SELECT switch_id, trx_cd, count(*) AS n FROM a JOIN messages USING (switch_id, trx_cd) GROUP BY ALL""")
def catalog_lookup(spark, sf):
    codes = dims.catalog_rows(v.catalog(spark), config.MESSAGE_CATALOG, not_prefix=config.INACTIVE_PREFIX)
    listed = codes.select(F.col("cnts_5").alias("switch_id"), F.col("cnts_1").alias("trx_cd"))
    counts = requests(v.inbound_log(spark, sf)).groupBy("switch_id", "trx_cd").agg(n_rows().alias("n"))
    return counts.join(listed, ["switch_id", "trx_cd"])


@register("catalog_extend", """
SELECT m.switch_id, m.trx_cd, m.kind, count(a.event_id) AS n FROM (
  SELECT switch_id, trx_cd, NULL AS kind FROM messages UNION ALL
  SELECT 'CLIC', 'ECHOMSG', 'Inward' UNION ALL SELECT 'REFD', 'ECHOMSG', 'Inward') m
LEFT JOIN a USING (switch_id, trx_cd) GROUP BY ALL""")
def catalog_extend(spark, sf):
    codes = dims.catalog_rows(v.catalog(spark), config.MESSAGE_CATALOG, not_prefix=config.INACTIVE_PREFIX)
    codes = dims.extend_catalog(codes, [
        {"cnts_nm": config.MESSAGE_CATALOG, "cnts_1": "ECHOMSG", "cnts_4": "Inward", "cnts_5": channel}
        for channel in ("CLIC", v.SILENT_CHANNEL)])
    listed = codes.select(F.col("cnts_5").alias("switch_id"), F.col("cnts_1").alias("trx_cd"),
                          F.col("cnts_4").alias("kind"))
    counts = requests(v.inbound_log(spark, sf)).groupBy("switch_id", "trx_cd").agg(n_rows().alias("n"))
    return spine.on_spine(listed, counts, ["switch_id", "trx_cd"], ["n"]).select(
        "switch_id", "trx_cd", "kind", "n")


@register("zero_fill_keys", f"""
SELECT CAST(d.trx_dt AS VARCHAR) AS trx_dt, c.switch_id, count(a.event_id) AS n
FROM days d CROSS JOIN (SELECT switch_id FROM channels UNION ALL SELECT 'REFD') c
LEFT JOIN a ON a.trx_dt = d.trx_dt AND a.switch_id = c.switch_id GROUP BY ALL""")
def zero_fill_keys(spark, sf):
    log = v.inbound_log(spark, sf)
    keys = spine.with_keys(spine.day_spine(log), "switch_id", [*v.CHANNELS, v.SILENT_CHANNEL])
    counts = requests(log).groupBy("trx_dt", "switch_id").agg(n_rows().alias("n"))
    return spine.on_spine(keys, counts, ["trx_dt", "switch_id"], ["n"]).select("trx_dt", "switch_id", "n")


@register("minute_spine", """
SELECT strftime(poll_ts, '%Y-%m-%d %H:%M:%S') AS poll_ts, CAST(slot_no AS BIGINT) AS slot_no,
       strftime(slot_ts, '%H:%M') AS slot FROM spine""")
def minute_spine(spark, sf):
    polls = spine.polls_every(v.inbound_log(spark, sf), every=60)
    return spine.minute_spine(polls).select("poll_ts", "slot_no", slot_label("slot_ts").alias("slot"))


@register("hour_spine", f"SELECT {DAY}, hour FROM hours")
def hour_spine(spark, sf):
    return spine.hour_spine(spine.day_spine(v.inbound_log(spark, sf))).select("trx_dt", "hour")


@register("filter_eq", "SELECT event_id, switch_id, trx_cd FROM outbound_log WHERE trx_cd = 'OPAYMNT'")
def filter_eq(spark, sf):
    return v.outbound_log(spark, sf).where(F.col("trx_cd") == "OPAYMNT").select(
        "event_id", "switch_id", "trx_cd")


@register("filter_in", "SELECT event_id, io_cd, resp_cd FROM inbound_log WHERE resp_cd IN ('51', '91')")
def filter_in(spark, sf):
    return v.inbound_log(spark, sf).where(F.col("resp_cd").isin(list(v.CUSTOMER_CODES))).select(
        "event_id", "io_cd", "resp_cd")


@register("filter_exclude_admin", """
SELECT event_id, io_cd, trx_cd, resp_cd FROM inbound_log
WHERE trx_cd NOT IN ('ECHOMSG') AND resp_cd NOT IN ('05')""")
def filter_exclude_admin(spark, sf):
    return v.inbound_log(spark, sf).where(
        ~F.col("trx_cd").isin(list(v.ADMIN_MESSAGES)) & ~F.col("resp_cd").isin(["05"])).select(
        "event_id", "io_cd", "trx_cd", "resp_cd")


@register("filter_ne", "SELECT event_id, trx_cd, resp_cd FROM outbound_log WHERE resp_cd <> '00'")
def filter_ne(spark, sf):
    return v.outbound_log(spark, sf).where(F.col("resp_cd") != config.APPROVED).select(
        "event_id", "trx_cd", "resp_cd")


@register("filter_prefix", """
SELECT event_id, io_cd, trx_cd FROM inbound_log WHERE trx_cd LIKE 'N%' AND trx_cd NOT LIKE 'NI%'""")
def filter_prefix(spark, sf):
    code = F.col("trx_cd")
    return v.inbound_log(spark, sf).where(code.startswith("N") & ~code.startswith("NI")).select(
        "event_id", "io_cd", "trx_cd")


@register("filter_contains", """
SELECT event_id, trx_cd FROM outbound_log WHERE trx_cd NOT LIKE '%LOG%' AND i_log_data LIKE '%P0003%'""")
def filter_contains(spark, sf):
    return v.outbound_log(spark, sf).where(
        ~F.col("trx_cd").contains("LOG") & F.col("i_log_data").contains("P0003")).select(
        "event_id", "trx_cd")


@register("filter_lagged_window", """
SELECT event_id, switch_id, strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS event_ts FROM a
WHERE event_ts >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 210 SECONDS - INTERVAL 6 HOURS
  AND event_ts < TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 210 SECONDS""")
def filter_lagged_window(spark, sf):
    return readers.lagged_window(requests(v.inbound_log(spark, sf)), v.AS_OF, 210, 6 * 3600).select(
        "event_id", "switch_id", "event_ts")


@register("filter_lookback", """
SELECT event_id, switch_id, strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS event_ts FROM a
WHERE event_ts BETWEEN TIMESTAMP '2024-01-15 11:00:00' AND TIMESTAMP '2024-01-15 12:00:00'""")
def filter_lookback(spark, sf):
    return readers.lookback(requests(v.inbound_log(spark, sf)), v.AS_OF, 60).select(
        "event_id", "switch_id", "event_ts")


@register("filter_not_blank", f"""
SELECT {DAY}, merchant_name, location, onoff FROM card_txn
WHERE onoff IS NOT NULL AND location <> ' ' AND location NOT LIKE '%-%'""")
def filter_not_blank(spark, sf):
    return v.card_txn(spark, sf).where(
        F.col("onoff").isNotNull() & (F.trim("location") != "") & ~F.col("location").contains("-")).select(
        "trx_dt", "merchant_name", "location", "onoff")


@register("search_payload", f"""
SELECT {DAY}, strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS event_ts, trc_ad_no, ret_ref_no, switch_id,
       bsns_cd, trx_cd, CAST(NULL AS VARCHAR) AS svc_cd, resp_cd FROM (
  SELECT trx_dt, event_ts, trc_ad_no, ret_ref_no, switch_id, bsns_cd, trx_cd, resp_cd FROM a
  WHERE switch_id = 'PURC' AND log_data LIKE '%P0003%' AND log_data LIKE '%IDR%'
  UNION ALL
  SELECT trx_dt, event_ts, trc_ad_no, ret_ref_no, switch_id, 'EB1', trx_cd, resp_cd FROM outbound_log
  WHERE switch_id = 'PURC' AND trx_cd NOT IN ('#LOG_ON')
    AND ((i_log_data LIKE '%P0003%' AND i_log_data LIKE '%IDR%')
      OR (o_log_data LIKE '%P0003%' AND o_log_data LIKE '%IDR%')))""")
def search_payload(spark, sf):
    return payload.search_payload(v.inbound_log(spark, sf), v.outbound_log(spark, sf), "PURC",
                                  ["P0003", "IDR", ""], exclude_outbound=v.ADMIN_CALLS)


@register("project_label", """
SELECT event_id, 'OUT' AS direction, switch_id, 'EB1' AS bsns_cd, trx_cd AS message FROM outbound_log""")
def project_label(spark, sf):
    return v.outbound_log(spark, sf).select(
        "event_id", F.lit("OUT").alias("direction"), "switch_id",
        F.lit(config.OUTBOUND_BSNS).alias("bsns_cd"), F.col("trx_cd").alias("message"))


@register("label_channels", """
SELECT switch_id, bsns_cd, count(*) AS n,
       CASE WHEN switch_id = 'CLIC' AND bsns_cd = 'PBK' THEN 'Personal Banking'
            WHEN switch_id = 'CLIC' AND bsns_cd = 'MBK' THEN 'Mobile Banking'
            WHEN switch_id = 'ERRO' THEN 'Card Terminal' WHEN switch_id = 'PURC' THEN 'Purchase Network'
            ELSE 'Other' END AS label
FROM inbound_log GROUP BY switch_id, bsns_cd""")
def label_channels(spark, sf):
    counts = v.inbound_log(spark, sf).groupBy("switch_id", "bsns_cd").agg(n_rows().alias("n"))
    return dims.label_channels(counts, dims.channel_labels(spark, v.LABELS)).select(
        "switch_id", "bsns_cd", "n", "label")


@register("map_message_family", """
SELECT direction, trx_cd, count(*) AS n, CASE trx_cd WHEN 'OPAYMNT' THEN 'EIOVCOM' WHEN 'REVMSAL' THEN 'EIOZCOM'
       ELSE 'EIO_COM' END AS family
FROM (SELECT 'INC' AS direction, trx_cd FROM a UNION ALL SELECT 'OUT', trx_cd FROM outbound_log)
GROUP BY ALL""")
def map_message_family(spark, sf):
    counts = legs.unified_activity(v.inbound_log(spark, sf), v.outbound_log(spark, sf)).groupBy(
        "direction", "trx_cd").agg(n_rows().alias("n"))
    families = dims.message_families(spark, {"OPAYMNT": "EIOVCOM", "REVMSAL": "EIOZCOM"})
    return dims.map_message_family(counts, families).select("direction", "trx_cd", "n", "family")


@register("pair_legs_3key", f"""
SELECT {DAY}, switch_id, trx_cd, rc AS resp_cd, count(*) AS n FROM pair3 GROUP BY ALL""")
def pair_legs_3key(spark, sf):
    log = v.inbound_log(spark, sf)
    return legs.pair_counts(requests(log), responses(log), KEYS_3, ["trx_dt", "switch_id", "trx_cd"])


@register("pair_legs_4key", f"""
SELECT {DAY}, switch_id, trx_cd, rc AS resp_cd, count(*) AS n FROM pair4 GROUP BY ALL""")
def pair_legs_4key(spark, sf):
    log = v.inbound_log(spark, sf)
    return legs.pair_counts(requests(log), responses(log), KEYS_4, ["trx_dt", "switch_id", "trx_cd"])


@register("pair_legs_5key", f"""
SELECT {DAY}, switch_id, bsns_cd, trx_cd, rc AS resp_cd, count(*) AS n FROM pair5
WHERE bsns_cd <> 'ODS' GROUP BY ALL""")
def pair_legs_5key(spark, sf):
    log = v.inbound_log(spark, sf)
    return legs.pair_counts(requests(log).where(F.col("bsns_cd") != config.ODS), responses(log), KEYS_5,
                            ["trx_dt", "switch_id", "bsns_cd", "trx_cd"])


@register("unanswered_requests", f"""
SELECT {DAY}, switch_id, trc_ad_no, ret_ref_no, trx_cd, count(*) AS n_requests FROM a
WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.trx_dt = a.trx_dt AND b.switch_id = a.switch_id
  AND b.trc_ad_no = a.trc_ad_no AND b.ret_ref_no = a.ret_ref_no) GROUP BY ALL""")
def unanswered_requests(spark, sf):
    log = v.inbound_log(spark, sf)
    return legs.unanswered_requests(requests(log), responses(log))


@register("spine_left_join", """
SELECT CAST(h.trx_dt AS VARCHAR) AS trx_dt, h.hour, count(o.event_id) AS n, count(o.resp_cd) AS answered
FROM hours h LEFT JOIN outbound_log o ON o.trx_dt = h.trx_dt AND strftime(o.event_ts, '%H') = h.hour
GROUP BY ALL""")
def spine_left_join(spark, sf):
    calls = v.outbound_log(spark, sf).groupBy("trx_dt", hour_label().alias("hour")).agg(
        n_rows().alias("n"), F.count("resp_cd").alias("answered"))
    axis = spine.hour_spine(v.days(spark, sf))
    return spine.on_spine(axis, calls, ["trx_dt", "hour"], ["n", "answered"]).select(
        "trx_dt", "hour", "n", "answered")


@register("join_payload_field", f"""
SELECT {DAY}, product_cd, product, count(*) AS n FROM a JOIN products ON substr(log_data, 15, 5) = product_cd
GROUP BY ALL""")
def join_payload_field(spark, sf):
    counts = (requests(v.inbound_log(spark, sf))
              .groupBy("trx_dt", field("log_data", *v.PRODUCT).alias("product_cd")).agg(n_rows().alias("n")))
    return counts.join(products(v.catalog(spark)), ["product_cd"]).select("trx_dt", "product_cd", "product", "n")


@register("contains_join", """
SELECT l.location, l.n, c.code, c.code_nm
FROM (SELECT location, count(*) AS n FROM card_txn GROUP BY ALL) l
LEFT JOIN code_table c ON c.type = 'CITY' AND contains(c.code_nm, l.location)""")
def contains_join(spark, sf):
    places = v.card_txn(spark, sf).groupBy("location").agg(n_rows().alias("n"))
    cities = v.code_table(spark, sf).where(F.col("type") == "CITY").select("code", "code_nm")
    return dims.contains_join(places, cities, "location", "code_nm", how="left").select(
        "location", "n", "code", "code_nm")


@register("parent_code_join", """
SELECT t.code, t.code_nm, p.code_nm AS parent_nm, count(c.c_custkey) AS n_customers
FROM customer c JOIN code_table t ON t.type = 'CITY' AND t.code = CAST(c.c_nationkey AS VARCHAR)
LEFT JOIN code_table p ON p.type = 'PROV' AND p.code = t.code1 GROUP BY ALL""")
def parent_code_join(spark, sf):
    codes = v.code_table(spark, sf)
    customers = v.table(spark, sf, "customer").groupBy(
        F.col("c_nationkey").cast("string").alias("code")).agg(n_rows().alias("n_customers"))
    cities = codes.where(F.col("type") == "CITY").select("code", "code_nm", "code1")
    return dims.with_parent(customers.join(cities, ["code"]), codes, "PROV").select(
        "code", "code_nm", "parent_nm", "n_customers")


LAYOUT_SQL = """, layout AS (
  SELECT c.trx_cd, f.* FROM (SELECT unnest(['NPAYMNT', 'NINQURY', 'OPAYMNT', '*']) AS trx_cd) c
  JOIN (VALUES ('C', 1, 'TRACE_NO', 6), ('C', 2, 'TERMINAL_ID', 8), ('I', 3, 'PRODUCT_CD', 5),
    ('I', 4, 'COUNTRY_CD', 2), ('I', 5, 'TRX_AMT', 12), ('I', 6, 'CCY_CD', 3))
    f(inout_cd, seq_no, field_nm, field_len)
  ON f.inout_cd = 'C' OR c.trx_cd IN ('NPAYMNT', 'NINQURY')),
offsets AS (
  SELECT trx_cd, field_nm, field_len, CAST(1 + coalesce(sum(field_len) OVER (
    PARTITION BY trx_cd ORDER BY seq_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position
  FROM layout)
"""


def layout_of(spark):
    families = dims.message_families(spark, {"OPAYMNT": config.DEFAULT_FAMILY})
    return payload.layout_offsets(payload.message_layout(v.record_layout(spark), families), base=v.LAYOUT_BASE)


@register("layout_offsets", LAYOUT_SQL + """
SELECT o.trx_cd, field_nm, CAST(field_len AS BIGINT) AS field_len, position, count(m.trx_cd) AS n FROM offsets o
LEFT JOIN (SELECT CASE WHEN trx_cd IN ('NPAYMNT', 'NINQURY', 'OPAYMNT') THEN trx_cd ELSE '*' END AS trx_cd
           FROM (SELECT trx_cd FROM a UNION ALL SELECT trx_cd FROM outbound_log)) m USING (trx_cd) GROUP BY ALL""")
def layout_offsets(spark, sf):
    offsets = layout_of(spark)
    counts = legs.unified_activity(v.inbound_log(spark, sf), v.outbound_log(spark, sf)).groupBy(
        "trx_cd").agg(n_rows().alias("n"))
    codes = offsets.select(F.col("trx_cd").alias("layout_cd")).distinct()
    used = payload.with_layout_code(counts, codes).groupBy(F.col("layout_cd").alias("trx_cd")).agg(
        F.sum("n").alias("n"))
    return spine.on_spine(offsets, used, ["trx_cd"], ["n"]).select(
        "trx_cd", "field_nm", "field_len", "position", "n")


@register("agg_count", f"""
SELECT {DAY}, switch_id, io_cd, trx_cd, count(*) AS n FROM inbound_log GROUP BY ALL""")
def agg_count(spark, sf):
    return v.inbound_log(spark, sf).groupBy("trx_dt", "switch_id", "io_cd", "trx_cd").agg(
        n_rows().alias("n"))


@register("agg_approval", f"""
SELECT {DAY}, switch_id, trx_cd, count(*) FILTER (WHERE resp_cd = '00') AS approve, count(*) AS tot
FROM outbound_log GROUP BY ALL""")
def agg_approval(spark, sf):
    return v.outbound_log(spark, sf).groupBy("trx_dt", "switch_id", "trx_cd").agg(
        *legs.counted(approval_measures()))


@register("agg_by_expr", """
SELECT substr(trx_cd, 1, 4) AS prefix, strftime(event_ts, '%H') AS hour,
       CASE WHEN resp_cd IS NULL THEN 'NONE' WHEN resp_cd = '00' THEN 'OK' ELSE resp_cd END AS outcome,
       count(*) AS n FROM inbound_log GROUP BY ALL""")
def agg_by_expr(spark, sf):
    return v.inbound_log(spark, sf).groupBy(
        F.substring("trx_cd", 1, 4).alias("prefix"), hour_label().alias("hour"),
        decode_values("resp_cd", {"00": "OK"}, missing="NONE").alias("outcome")).agg(n_rows().alias("n"))


@register("unified_activity", f"""
SELECT direction, {DAY}, strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS event_ts, trc_ad_no, ret_ref_no,
       switch_id, bsns_cd, trx_cd, resp_cd FROM (
  SELECT 'INC' AS direction, trx_dt, event_ts, trc_ad_no, ret_ref_no, switch_id, bsns_cd, trx_cd, resp_cd FROM a
  UNION ALL
  SELECT 'OUT', trx_dt, event_ts, trc_ad_no, ret_ref_no, switch_id, 'EB1', trx_cd, resp_cd FROM outbound_log)""")
def unified_activity(spark, sf):
    return legs.unified_activity(v.inbound_log(spark, sf), v.outbound_log(spark, sf))


@register("effective_resp_code", "SELECT event_id, resp_cd, resp_val, eff_cd FROM outbound_eff")
def effective_code(spark, sf):
    return v.outbound_log(spark, sf).select(
        "event_id", "resp_cd", "resp_val", effective_resp_code().alias("eff_cd"))


SINK_SQL = f"""
SELECT {DAY}, switch_id, resp_cd, count(*) AS cntt FROM outbound_log GROUP BY ALL"""


def _sink_rows(spark, sf):
    return v.outbound_log(spark, sf).groupBy("trx_dt", "switch_id", "resp_cd").agg(n_rows().alias("cntt"))


@register("sink_json", SINK_SQL)
def sink_json(spark, sf):
    path = work_dir(spark, "sink_json")
    sinks.write_json_objects(_sink_rows(spark, sf), path, {
        "trx_dt": "day", "switch_id": "name", "resp_cd": "code", "cntt": "value"})
    return spark.read.schema("day date, name string, code string, value long").json(path).select(
        F.col("day").alias("trx_dt"), F.col("name").alias("switch_id"), F.col("code").alias("resp_cd"),
        F.col("value").alias("cntt"))


@register("sink_json_rows", SINK_SQL)
def sink_json_rows(spark, sf):
    path = work_dir(spark, "sink_json_rows")
    sinks.write_json_rows(_sink_rows(spark, sf), path)
    row = F.parse_json("value")
    return spark.read.text(f"{path}/rows").select(
        F.variant_get(row, "$[0]", "date").alias("trx_dt"),
        F.variant_get(row, "$[1]", "string").alias("switch_id"),
        F.variant_get(row, "$[2]", "string").alias("resp_cd"),
        F.variant_get(row, "$[3]", "long").alias("cntt"))


@register("sink_csv", SINK_SQL)
def sink_csv(spark, sf):
    path = work_dir(spark, "sink_csv")
    sinks.write_csv(_sink_rows(spark, sf), path, header=True)
    return spark.read.option("header", "true").schema(
        "trx_dt date, switch_id string, resp_cd string, cntt long").csv(path)
