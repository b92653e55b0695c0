from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from tables import DAY, call, inbound, leg, outbound, rows
from tallyrail import config, schemas
from tallyrail.operators import dims, payload, spine
from tallyrail.operators.digest import error_code_digest
from tallyrail.operators.legs import requests
from tallyrail.plans import alerts, billpay, channels, dashboards, drilldown, merchants


def pair(trace, resp, **kw):
    return [leg("I", "10:00:00", trace, **kw), leg("O", "10:00:01", trace, resp=resp, **kw)]


def test_two_rate_summary(spark):
    log = inbound(spark, [
        *pair("1", "00"), *pair("2", "51"), *pair("3", None), *pair("4", "00", trx="NGTLNAP"),
        *pair("5", "00", switch="GIBI", bsns="ODS"), *pair("6", "05", switch="GIBI", bsns="PBK"),
        leg("I", "10:00:00", "7", switch="GIBI", bsns="PBK"),
        leg("O", "10:00:01", "7", switch="GIBI", bsns="MBK", resp="00"),
        *pair("8", "00", switch="RNTS"), *pair("9", "00", switch="UNKNOWN")])
    calls = outbound(spark, [
        call("10:00:00", "RNTS", val="[51]"), call("10:00:00", "SWDK", "DUKCALL"), call("10:00:00", "SWDK", "PAY"),
        call("10:00:00", "FINN", resp=None), call("10:00:00", "QRIS")])
    got = channels.two_rate_summary(log, calls)
    assert rows(got, "switch_id", "bsns_cd", "volume", "cae", "sar") == [
        ("ATMD", "EB1", 3, 33, 66), ("FINN", "EB1", 1, 0, 100), ("GIBI", "PBK", 1, 0, 0),
        ("RNTS", "EB1", 2, 50, 100), ("SWDK", "EB1", 1, 100, 100)]
    assert got.where("cae > sar").count() == 0


def test_leg_mix_and_digest(spark):
    legs = [leg("I", "10:00:00", str(i)) for i in range(10)]
    codes = ["05"] * 3 + ["51"] * 2 + ["91", "14", "34", "61", None, "00"]
    legs += [leg("O", "10:00:01", str(i), resp=c) for i, c in enumerate(codes)]
    calls = [call("10:00:00", "SWDK", "HNCNINQ", "05"), call("10:00:00", "SWDK", "DUKCAPL", "05"),
             call("10:00:00", "FINN")]
    counts = channels.leg_counts(inbound(spark, legs), outbound(spark, calls))
    got = channels.leg_mix_summary(counts)
    assert rows(got, "switch_id", "volume", "errors", "success_rate", "error_codes") == [
        ("ATMD", 10, 10, 0, "14,34,61,91,51"), ("FINN", 1, 0, 100, None), ("SWDK", 1, 1, 0, "05")]
    assert rows(channels.leg_digest(counts), "switch_id", "error_codes") == [
        ("ATMD", "14,34,61,91,51"), ("SWDK", "05")]


def test_zero_volume_has_no_rate(spark):
    counts = channels.leg_counts(inbound(spark, [leg("O", "10:00:01", "1", resp="05")]), outbound(spark, []))
    assert rows(channels.leg_mix_summary(counts), "volume", "errors", "success_rate") == [(0, 1, None)]


def test_digest_breaks_ties_by_code(spark):
    df = spark.createDataFrame([("g", "05", 2), ("g", "91", 1), ("g", "14", 1), ("g", "00", 9), ("g", None, 1)],
                               "g string, resp_cd string, n long")
    assert rows(error_code_digest(df, ["g"], first=2)) == [("g", "14,91")]


def test_channel_order_and_labels(spark):
    log = inbound(spark, [leg("I", "10:00:00", "1", switch=s, bsns=b) for s, b in [
        ("ATMD", "EB1"), ("GIBI", "PBK"), ("GIBI", "ODS"), ("GIBI", "MBK"), ("BRSM", "XX1"), ("NONE", "EB1")]])
    active = channels.active_channels(log, outbound(spark, [call("10:00:00", "SWDK"), call("10:00:00", "SWDK")]))
    ordered = dims.with_priority(active, dims.channel_ranks(spark), last=18).orderBy("priority")
    assert [(r["switch_id"], r["bsns_cd"], r["priority"]) for r in ordered.collect()] == [
        ("GIBI", "MBK", 1), ("GIBI", "PBK", 2), ("ATMD", "EB1", 5), ("SWDK", "EB1", 17), ("BRSM", "XX1", 18)]
    labelled = dims.label_channels(requests(log), dims.channel_labels(spark))
    assert rows(labelled, "switch_id", "bsns_cd", "label") == [
        ("ATMD", "EB1", "ATM Driving"), ("BRSM", "XX1", "ATM Bersama"), ("GIBI", "MBK", "Mobile Banking(MBK)"),
        ("GIBI", "ODS", "1Q Pioneer"), ("GIBI", "PBK", "Personal Banking(PBK)"), ("NONE", "EB1", "Other")]


def catalog(spark):
    rows_ = [("INTER_ID", code, None, None, None, ch) for ch, code in [
        ("ATMD", "NWDLREG"), ("ATMD", "NWDLCRL"), ("ATMD", "NEVER"), ("ATMD", "XOLD"), ("GIBI", "0200A01"),
        ("GIBI", "UNUSED")]]
    rows_ += [("PART_CENT_ID", None, "P0001", None, "Water", None), ("PART_CENT_ID", None, "P0002", None, "Power", None)]
    return spark.createDataFrame(rows_, schemas.CATALOG)


def test_catalog_reports_keep_unused_codes(spark):
    codes = dims.catalog_rows(catalog(spark), config.MESSAGE_CATALOG, not_prefix=config.INACTIVE_PREFIX)
    log = inbound(spark, [
        *pair("1", "00", trx="NWDLREG"), *pair("2", "51", trx="NWDLREG"), *pair("3", None, trx="NWDLREG"),
        leg("I", "10:00:00", "4", "a", trx="NWDLCRL", resp="05"), leg("O", "10:00:01", "4", "b", trx="NWDLCRL"),
        *pair("5", "00", switch="GIBI", bsns="ODS", trx="0200A01"),
        leg("I", "10:00:00", "6", switch="GIBI", bsns="PBK", trx="0200A01"),
        leg("O", "10:00:01", "6", switch="GIBI", bsns="MBK", trx="0200A01", resp="05")])
    calls = outbound(spark, [call("10:00:00", "RNTS", "0200A01", "00", out="." * 311 + "CBS"),
                             call("10:00:00", "RNTS", "#LOG_ON", "00"), call("10:00:00", "FINN", "0200A01", "00")])
    plain = channels.catalog_coverage(channels.catalog_counts(
        log, calls, codes, config.SPLIT_CHANNELS, config.OUTBOUND_FEEDS, days=(DAY, DAY + timedelta(days=1))))
    assert plain.where(F.col("trx_dt") > DAY).agg(F.count("*"), F.sum("volume")).first() == (5, 0)
    plain = plain.where(F.col("trx_dt") == DAY)
    assert rows(plain, "switch_id", "bsns_cd", "trx_cd", "volume", "success_rate", "error_codes") == [
        ("ATMD", "EB1", "NEVER", 0, None, None), ("ATMD", "EB1", "NWDLCRL", 0, None, None),
        ("ATMD", "EB1", "NWDLREG", 2, 50, "51"), ("GIBI", "CBS", "0200A01", 1, 100, None),
        ("GIBI", "ODS", "0200A01", 1, 100, None), ("GIBI", "PBK", "0200A01", 1, 0, "05"),
        ("GIBI", None, "UNUSED", 0, None, None)]
    second = channels.catalog_two_rate(channels.catalog_counts(
        log, calls, dims.extend_catalog(codes, config.CATALOG_EXTRAS), config.SPLIT_CHANNELS, config.OUTBOUND_FEEDS,
        request_coded=config.REQUEST_CODED, strict_channels=config.SPLIT_CHANNELS, days=(DAY, DAY)))
    assert rows(second, "switch_id", "bsns_cd", "trx_cd", "volume", "cae", "sar") == [
        ("ATMD", "EB1", "NEVER", 0, None, None), ("ATMD", "EB1", "NWDLCRL", 1, 0, 0),
        ("ATMD", "EB1", "NWDLREG", 2, 50, 100), ("GIBI", "CBS", "0200A01", 1, 100, 100),
        ("GIBI", None, "NBLLPAY", 0, None, None), ("GIBI", None, "NBLLPOS", 0, None, None),
        ("GIBI", None, "UNUSED", 0, None, None)]


def test_health_keeps_silent_channels(spark):
    log = inbound(spark, [*pair("1", "00"), *pair("2", "EF"), *pair("3", "05"), *pair("4", "00", trx="NEW_KEY"),
                          *pair("5", None)])
    days = spine.day_spine(log)
    got = dashboards.inbound_health(log, days)
    assert got.count() == 8
    assert rows(got.where("tot > 0"), "switch_id", "approve", "tot", "failure_rate") == [("ATMD", 1, 2, 50)]
    calls = outbound(spark, [call("10:00:00", "SWDK", "PDFMAIL"), call("10:00:00", "SWDK", resp="05"),
                             call("10:00:00", "FINN")])
    ring = dashboards.outbound_health(calls, days)
    assert ring.count() == 8
    assert rows(alerts.failing(ring), "switch_id", "failure_rate") == [("SWDK", 100)]


def test_terminals_keep_the_last_one_and_cap_at_100(spark):
    def tx(trace, term, trx, resp):
        return pair(trace, resp, trx=trx, payload="x" * 14 + term)

    log = inbound(spark, [
        *tx("1", "TERM0001", "NWDLREG", "00"), *tx("2", "TERM0001", "NTRHREG", "05"),
        *tx("3", "TERM0001", "NTRHREG", None), *tx("4", "TERM0002", "XWDLREG", "00"),
        *tx("5", "TERM0002", "OTHER", "00"), *pair("6", "00", trx="NWDLREG", payload="short")])
    activity = dashboards.terminal_activity(log, "ATMD")
    assert rows(activity, "terminal", "family", "resp_cd", "n") == [
        ("TERM0001", "TRF", "05", 1), ("TERM0001", "TRF", None, 1), ("TERM0001", "WDL", "00", 1),
        ("TERM0002", "WDL", "00", 1), (None, "WDL", "00", 1)]
    score = dashboards.terminal_score(activity.where("terminal is not null"))
    assert rows(score, "terminal", "x", "y", "tot") == [("TERM0001", 33, -67, 3), ("TERM0002", 100, 0, 1)]


def bill(trace, resp, product, trx="NBLLPAY", tail="", **kw):
    return pair(trace, resp, trx=trx, payload="." * 85 + product + tail, **kw)


def test_billpay(spark):
    log = inbound(spark, [
        *bill("1", "00", "P0001", tail="a"), *bill("2", "00", "P0001", tail="a"), *bill("3", "51", "P0001", tail="b"),
        *bill("4", "05", "P0002", tail="c"), *bill("5", "00", "P0002", "NBLLINQ"), *bill("6", "00", "P9999"),
        *bill("7", "00", "P0001", switch="BRSM")])
    shown = billpay.billpay_monitor(log, catalog(spark))
    assert [(r["product"], r["approve"], r["tot"], r["rate"]) for r in shown.collect()] == [
        ("Water", 2, 3, 67), ("Power", 0, 1, 0)]
    report = billpay.billpay_report(billpay.payload_counts(log, catalog(spark)))
    assert rows(report, "trx_type", "product", "volume", "cae", "sar", "error_codes") == [
        ("Inquiry", "Power", 1, 100, 100, None), ("Payment/Purchase", "Power", 1, 0, 0, "05"),
        ("Payment/Purchase", "Water", 2, 50, 100, "51")]
    hours = billpay.product_hours(log, catalog(spark), "P0001")
    assert rows(hours, "hour", "trx_type", "product", "resp_cd", "n") == [
        ("10", "Payment/Purchase", "Water", "00", 2), ("10", "Payment/Purchase", "Water", "51", 1)]


def test_card_segments(spark):
    def visa(trace, country, resp):
        return pair(trace, resp, switch="ARON", bsns="V", trx="AUTH", payload="." * 710 + country)

    log = inbound(spark, [
        *visa("1", "ID", "00"), *visa("2", "US", "51"), *visa("3", "", "00"),
        *pair("4", "05", switch="RNTS", trx="DEBITPN"), *pair("5", "00", switch="RNTS", trx="CREDIT")])
    got = channels.card_segments(log)
    assert rows(got, "segment", "volume", "cae", "sar") == [
        ("RNTS", 1, 0, 0), ("VISA LOCAL", 1, 100, 100), ("VISA OVERSEAS", 1, 0, 100)]
    named = dims.label_channels(got, dims.channel_labels(spark, config.SEGMENT_LABELS), channel="segment")
    assert rows(named, "segment", "label") == [
        ("RNTS", "NPG Prima"), ("VISA LOCAL", "VISA Local"), ("VISA OVERSEAS", "VISA Overseas")]
    assert rows(channels.segment_hours(log), "hour", "segment", "resp_cd", "n") == [
        ("10", "RNTS", "05", 1), ("10", "VISA LOCAL", "00", 1), ("10", "VISA OVERSEAS", "51", 1)]


def cards(spark, rows_):
    return spark.createDataFrame(
        [(date(2024, 3, 1), m, loc, tp, Decimal(amount), on) for m, loc, tp, amount, on in rows_], schemas.CARD_TXN)


def test_merchants_and_categories(spark):
    df = cards(spark, [("b", "X", "763", "1.10", "05"), ("b", "X", " 0763", "2.20", None), ("a", "Y", " 5712", "5", "09"),
                       ("a", "Y", "5712", "5", "05"), (None, "Z", None, "9", None), ("c", "Z", "AIR", "1", "05")])
    top = merchants.top_merchants(df, 2)
    assert [tuple(r) for r in top.collect()] == [("a", "Y", 2, Decimal("10.00")), ("b", "X", 2, Decimal("3.30"))]
    titles = spark.createDataFrame([(" 0763", "Farm"), ("5712", "Furniture")], "code string, title string")
    kinds = merchants.top_categories(df, titles)
    assert [tuple(r)[:3] for r in kinds.collect()] == [("0763", "Farm", 2), ("5712", "Furniture", 2), ("AIR", "AIR", 1)]
    flags = merchants.by_auth_flag(df)
    assert [tuple(r) for r in flags.collect()] == [
        ("Success 3DS", "05", 3), ("OFFLINE", None, 2), ("09", "09", 1)]


def codes(spark):
    return spark.createDataFrame([
        ("F787", "1", "KOTA BANDUNG", "P1"), ("F787", "2", "KAB. BANDUNG BARAT", "P1"), ("F787", "3", "DEPOK", "P1"),
        ("F787", "4", "BANDUNGAN", "P2"), ("F795", "P1", "JAWA BARAT", None), ("F795", "P2", "ELSEWHERE", None),
        ("F787", "5", "LOST", "P9")], schemas.CODE_TABLE)


def test_region_rollup(spark):
    df = cards(spark, [
        ("m", "Bandung city", "1", "10", None), ("m", "Bandung city", "1", "10", None), ("n", "Kota Depok", "1", "4", None),
        ("n", "lost", "1", "7", None), ("n", " ", "1", "7", None), ("n", "A-B", "1", "7", None), ("n", "PARIS", "1", "7", None)])
    got = merchants.region_rollup(df, codes(spark))
    # BANDUNG is found in two cities of one province (counted once there) and in one of another.
    assert rows(got, "name", "total_trx", "trx_amt_total") == [
        ("ELSEWHERE", 1, Decimal("10.00")), ("id-jr", 2, Decimal("14.00"))]
    every = merchants.region_rollup(df, codes(spark), dedupe=False)
    assert rows(every, "name", "total_trx") == [("ELSEWHERE", 2), ("id-jr", 5)]
    assert got.where("name = 'id-jr'").first()["trx_amt_avg"] == Decimal("7")


def test_contains_join_equals_brute_force(spark):
    needles = ["A", "AB", "BANDUNG", "BANDUNG BARAT", "ANDUNG B", "XYZ", "KAB. BANDUNG BARAT!", "", None, "ÉÈ", "%"]
    stacks = ["KAB. BANDUNG BARAT", "AB", "A", "", None, "ÀÉÈ", "50% OFF", "BANDUNG"]
    left = spark.createDataFrame([(n,) for n in needles], "needle string")
    right = spark.createDataFrame([(s,) for s in stacks], "stack string")
    expected = sorted(((n, s) for n in needles for s in stacks if n and s and n in s), key=repr)
    for gram in (1, 3, 8):
        assert rows(dims.contains_join(left, right, "needle", "stack", gram)) == expected
    kept = dims.contains_join(left, right, "needle", "stack", how="left")
    assert {r["needle"] for r in kept.collect()} == set(needles)


def layout(spark):
    return spark.createDataFrame([
        ("EIO_COM001", "C", 1, "HDR_LEN", 4), ("NPAYMNT01", "I", 2, "ACCOUNT", 6), ("NPAYMNT01", "I", 3, "TRX_AMT", 8),
        ("NPAYMNT01", "I", 4, "TRX_CCY_CD", 3), ("NPAYMNT01", "O", 2, "TRX_AMT", 5), ("REVSALE01", "I", 2, "CURRENCY", 3)],
        schemas.RECORD_LAYOUT)


def test_layout_positions_and_extraction(spark):
    fields = payload.message_layout(layout(spark), dims.message_families(spark, {"REVMSAL": "EIO_COM"}))
    offsets = payload.layout_offsets(fields)
    assert rows(offsets, "trx_cd", "field_nm", "position") == [
        ("*", "HDR_LEN", 301), ("NPAYMNT", "ACCOUNT", 305), ("NPAYMNT", "HDR_LEN", 301), ("NPAYMNT", "TRX_AMT", 311),
        ("NPAYMNT", "TRX_CCY_CD", 319), ("REVMSAL", "HDR_LEN", 301), ("REVSALE", "CURRENCY", 305),
        ("REVSALE", "HDR_LEN", 301)]
    body = " " * 300 + "HDR." + "ACC123" + "00012345" + "IDR"
    log = inbound(spark, [leg("I", "10:00:00", "1", payload=body), leg("I", "10:00:00", "2", payload="short"),
                          leg("I", "10:00:00", "3", payload=body.replace("00012345", "bad-text")),
                          leg("I", "10:00:00", "4", trx="OTHER", payload=body),
                          leg("I", "10:00:00", "5", trx="REVSALE", payload=" " * 304 + "USD")])
    calls = outbound(spark, [call("10:00:00", "FINN", "NPAYMNT", request=body, ref="out"),
                             call("10:00:00", "FINN", "OTHER", request=body, ref="none")])
    got = drilldown.transaction_detail(log, calls, offsets, scale=2)
    assert rows(got, "ret_ref_no", "trx_cd", "ccy", "amt") == sorted([
        ("r1", "NPAYMNT", "IDR", Decimal("123.45")), ("r1", "NPAYMNT", None, None), ("r1", "NPAYMNT", "IDR", None),
        ("r1", "OTHER", None, None), ("r1", "REVSALE", "USD", None), ("out", "NPAYMNT", "IDR", Decimal("123.45")),
        ("none", "OTHER", " ", Decimal("0.00"))], key=repr)


def test_one_transaction(spark):
    offsets = payload.layout_offsets(payload.message_layout(layout(spark), dims.message_families(spark)))
    log = inbound(spark, [*pair("1", "00"), *pair("2", "00")])
    calls = outbound(spark, [call("10:00:00", "ATMD", trace="1", ref="r1"), call("10:00:00", "FINN", trace="1", ref="r1")])
    narrowed = [drilldown.correlated(df, "ATMD", "1", "r1") for df in (log, calls)]
    assert drilldown.transaction_detail(*narrowed, offsets).count() == 2


def test_message_family(spark):
    df = spark.createDataFrame([("DEBTVMC",), ("REVMSAL",), ("NPAYMNT",)], "trx_cd string")
    got = dims.map_message_family(df, dims.message_families(spark))
    assert rows(got, "trx_cd", "family") == [
        ("DEBTVMC", "EIOVCOM"), ("NPAYMNT", "EIO_COM"), ("REVMSAL", "EIOZCOM")]


def test_search(spark):
    log = inbound(spark, [leg("I", "10:00:00", "1", payload="card 4111 amt 50%"), leg("O", "10:00:01", "1", payload="card 4111"),
                          leg("I", "10:05:00", "2", payload="card 4222"), leg("I", "10:06:00", "3", payload=None)])
    calls = outbound(spark, [call("10:09:00", "ATMD", request="x", out="4111 card", trace="9"),
                             call("10:09:00", "ATMD", "PDFMAIL", request="card 4111")])
    got = payload.search_payload(log, calls, "ATMD", ["card", "4111", ""])
    assert [(r["trc_ad_no"], r["bsns_cd"]) for r in got.collect()] == [("9", "EB1"), ("1", "EB1")]
    assert payload.search_payload(log, calls, "ATMD", ["50%"]).count() == 1
    assert payload.search_payload(log, calls, "ATMD", ["c_rd"]).count() == 0
    assert payload.search_payload(log, calls, "ATMD", ["c_rd"], like=True).count() == 3
