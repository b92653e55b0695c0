"""Logs, catalogs and dimensions derived from the given tables."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrail import schemas
from tallyrail.config import ChannelRule, rules
from tallyrail.operators import spine
from tallyrail.sources.readers import log_with_times, read_parquet

AS_OF = datetime(2024, 1, 15, 12, 0, 0)
LOG_END = datetime(2024, 1, 31, 0, 0, 0)
ANSWER_TIME = timedelta(seconds=2)
CARD_AS_OF = datetime(2001, 8, 1)

CHANNELS = ("CLIC", "ERRO", "VIEW", "PURC", "SIGN")
SILENT_CHANNEL = "REFD"
CUSTOMER_CODES = ("51", "91")
ADMIN_MESSAGES = ("ECHOMSG",)
ADMIN_CALLS = ("#LOG_ON",)
BILL_CHANNELS = ("CLIC", "ERRO", "VIEW")
PAYMENTS = ("NPAYMNT",)
INQUIRIES = ("NINQURY",)
FAMILIES = {"NPAY": "WDL", "NINQ": "TRF"}
TERMINAL = (7, 8)
PRODUCT = (15, 5)
COUNTRY = (20, 2)
LAYOUT_BASE = 1

INBOUND_RULES = (
    ChannelRule("CLIC", exclude_bsns=("ODS",)),
    ChannelRule("ERRO", exclude_trx=ADMIN_MESSAGES),
    *rules("VIEW", "PURC", "SIGN"),
)
OUTBOUND_RULES = (ChannelRule("PURC"), ChannelRule("SIGN", exclude_trx=ADMIN_CALLS))
HEALTH_RULES = rules(*CHANNELS, SILENT_CHANNEL, exclude_trx=ADMIN_MESSAGES, exclude_bsns=("ODS",))

RANKS = (
    ("CLIC", "MBK", 1), ("CLIC", "PBK", 2), ("ERRO", "MBK", 3), ("ERRO", "PBK", 4), ("VIEW", "PBK", 5),
    ("PURC", "EB1", 6), ("SIGN", "EB1", 7),
)
LABELS = (
    ("CLIC", "PBK", "Personal Banking"), ("CLIC", "MBK", "Mobile Banking"), ("ERRO", None, "Card Terminal"),
    ("PURC", None, "Purchase Network"),
)
TITLES = (("5712", "Furniture"), ("0763", "Agricultural Cooperatives"), ("5300", "Wholesale Clubs"))
LAYOUT_FIELDS = (
    ("TRACE_NO", 6), ("TERMINAL_ID", 8), ("PRODUCT_CD", 5), ("COUNTRY_CD", 2), ("TRX_AMT", 12), ("CCY_CD", 3))


# Declared schemas spare a footer-reading job per read; only the columns used here are listed.
TABLES = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "orders": "o_custkey long, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def raw_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet", TABLES[name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return log_with_times(raw_table(spark, sf_dir, name))


def coded_log(events: DataFrame) -> DataFrame:
    """One row per event with its channel, business code, message, response code and payload."""
    base = events.selectExpr(
        "event_id", "ts as event_ts", "cast(ts as date) as trx_dt",
        "upper(substr(event_type, 1, 4)) as switch_id",
        "case when user_id % 3 = 0 then 'PBK' when user_id % 3 = 1 then 'MBK' else 'ODS' end as bsns_cd",
        "lpad(cast(event_id % 50 as string), 6, '0') as trc_ad_no",
        "lpad(cast(event_id as string), 12, '0') as ret_ref_no",
        "cast(substr(props, 7, length(props) - 7) as int) as k",
        "concat(lpad(cast(event_id % 50 as string), 6, '0'), lpad(cast(user_id as string), 8, '0'),"
        " 'P000', cast(user_id % 6 as string), case when user_id % 4 = 0 then 'SG' else 'ID' end,"
        " lpad(cast(cast(round(value * 100) as bigint) as string), 12, '0'), 'IDR') as log_data")
    return base.selectExpr(
        "*",
        "case when k < 80 then '00' when k < 84 then '51' when k < 88 then '05' when k < 91 then '91'"
        " when k < 98 then element_at(array('12', '13', '14', '54', '61', '68', '75'), k - 90) end as code",
        "case when k % 5 = 0 then 'ECHOMSG' when k % 2 = 0 then 'NPAYMNT' else 'NINQURY' end as msg")


def request_legs(coded: DataFrame) -> DataFrame:
    return coded.selectExpr(
        "event_id", "trx_dt", "event_ts", "event_ts as reg_ts", "switch_id", "bsns_cd", "'I' as io_cd",
        "msg as trx_cd", "cast(null as string) as svc_cd", "cast(null as string) as resp_cd",
        "trc_ad_no", "ret_ref_no", "log_data")


def response_legs(coded: DataFrame) -> DataFrame:
    """Every twentieth request stays unanswered, every thirteenth is answered under another business code."""
    return coded.where("event_id % 20 <> 0").selectExpr(
        "event_id", "trx_dt", "event_ts + interval 2 seconds as event_ts",
        "event_ts + interval 2 seconds as reg_ts", "switch_id",
        "case when event_id % 13 = 0 then 'ODS' else bsns_cd end as bsns_cd", "'O' as io_cd",
        "msg as trx_cd", "cast(null as string) as svc_cd", "code as resp_cd",
        "trc_ad_no", "ret_ref_no", "log_data")


def outbound_calls(coded: DataFrame) -> DataFrame:
    return coded.where("switch_id in ('PURC', 'SIGN')").selectExpr(
        "event_id", "trx_dt", "event_ts", "event_ts as reg_ts", "switch_id", "bsns_cd",
        "case when k % 5 = 0 then '#LOG_ON' else 'OPAYMNT' end as trx_cd", "code as resp_cd",
        "case when k % 3 = 0 then null"
        " when k % 3 = 1 then concat('host [', case when k % 2 = 0 then '00' else '68' end, ']')"
        " else 'host ok' end as resp_val",
        "trc_ad_no", "ret_ref_no", "log_data as i_log_data", "reverse(log_data) as o_log_data")


def inbound_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = coded_log(table(spark, sf_dir, "events"))
    return request_legs(coded).unionByName(response_legs(coded))


def raw_inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inbound log as a database hands it out: upper-case names, times as text, blanks for no code."""
    return inbound_log(spark, sf_dir).selectExpr(
        "trx_dt as TRX_DT", "date_format(event_ts, 'HH:mm:ss') as TRX_TM", "date_format(reg_ts, 'HH:mm:ss') as REG_TM",
        "switch_id as SWITCH_ID", "bsns_cd as BSNS_CD", "io_cd as IO_CD", "trx_cd as TRX_CD", "svc_cd as SVC_CD",
        "coalesce(resp_cd, '  ') as RESP_CD", "trc_ad_no as TRACE_AD_NO", "ret_ref_no as RET_REF_NO",
        "log_data as LOG_DATA")


def outbound_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbound_calls(coded_log(table(spark, sf_dir, "events")))


def _bounds(spark: SparkSession, sf_dir: str) -> tuple[datetime, datetime, datetime]:
    """First and last event and last time of the inbound log, from two columns of the events it is made of."""
    answered = F.when(F.expr("event_id % 20 <> 0"), F.col("ts") + F.lit(ANSWER_TIME))
    first, last, answer = table(spark, sf_dir, "events").agg(F.min("ts"), F.max("ts"), F.max(answered)).first()
    if first is None:
        return LOG_END, LOG_END, LOG_END
    return first, last, max(last, answer or last)


def day_bounds(spark: SparkSession, sf_dir: str) -> tuple[date, date]:
    first, last, _ = _bounds(spark, sf_dir)
    return first.date(), last.date()


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spine.days_between(spark, *day_bounds(spark, sf_dir))


def polls(spark: SparkSession, sf_dir: str, every: int) -> DataFrame:
    first, _, last = _bounds(spark, sf_dir)
    return spine.polls_between(spark, first, last, every)


def price_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded_log(table(spark, sf_dir, "events")).where("switch_id = 'VIEW'").selectExpr(
        "trx_dt as feed_dt", "event_ts", "substr(trc_ad_no, 4, 3) as ric")


def card_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).selectExpr(
        "cast(o_orderdate as date) as trx_dt", "c_name as merchant_name",
        "concat('NATION_', cast(c_nationkey % 10 as string)) as location",
        "case c_mktsegment when 'FURNITURE' then ' 5712' when 'BUILDING' then '763'"
        " when 'MACHINERY' then '5300' else c_mktsegment end as merchant_tp",
        "cast(o_totalprice as decimal(18,2)) as trx_amount",
        "case substr(o_orderpriority, 1, 1) when '1' then '05' when '2' then '06' when '3' then '07'"
        " when '5' then '09' end as onoff")


def code_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    cities = table(spark, sf_dir, "nation").selectExpr(
        "'CITY' as type", "cast(n_nationkey as string) as code", "n_name as code_nm",
        "cast(n_regionkey as string) as code1")
    provinces = table(spark, sf_dir, "region").selectExpr(
        "'PROV' as type", "cast(r_regionkey as string) as code", "r_name as code_nm",
        "cast(null as string) as code1")
    return cities.unionByName(provinces)


def catalog(spark: SparkSession) -> DataFrame:
    """Products P0000..P0006 (the last never used) and three message codes per channel (one never used)."""
    products = [("PART_CENT_ID", None, f"P000{i}", None, f"Product {i}", None) for i in range(7)]
    messages = [("INTER_ID", code, None, None, None, channel)
                for channel in CHANNELS for code in ("NPAYMNT", "NINQURY", "NREFUND", "XOLDMSG")]
    return schemas.literal_table(spark, products + messages, schemas.CATALOG)


def record_layout(spark: SparkSession) -> DataFrame:
    """Trace and terminal sit in the common header; the other fields belong to each message."""
    rows = [("EIO_COM", "C", i, name, size) for i, (name, size) in enumerate(LAYOUT_FIELDS[:2], 1)]
    for code in ("NPAYMNT", "NINQURY"):
        rows += [(code, "I", i, name, size) for i, (name, size) in enumerate(LAYOUT_FIELDS[2:], 3)]
    return schemas.literal_table(spark, rows, schemas.RECORD_LAYOUT)


def titles(spark: SparkSession) -> DataFrame:
    return schemas.literal_table(spark, TITLES, schemas.CODE_TITLE)
