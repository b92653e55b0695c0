from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tables import at, call, inbound, leg, outbound, rows
from tallyrail.functions.timeaxis import slot_label
from tallyrail.operators import spine
from tallyrail.operators.throughput import rolling_strip, throughput
from tallyrail.plans import alerts, dashboards, drilldown
from tallyrail.sources.readers import lagged_window, lookback, scan_day, scan_trailing_days


def test_live_spine_has_thirteen_slots_from_the_floored_start(spark):
    axis = spine.minute_spine(spine.polls_at(spark, at("12:07:30")))
    labels = [r["s"] for r in axis.orderBy("slot_no").select(slot_label("slot_ts").alias("s")).collect()]
    assert labels == ["11:00", "11:05", "11:10", "11:15", "11:20", "11:25", "11:30", "11:35", "11:40", "11:45",
                      "11:50", "11:55", "12:00"]


def test_spine_crosses_midnight(spark):
    axis = spine.minute_spine(spine.polls_at(spark, datetime(2024, 3, 6, 0, 20)))
    first, last = axis.agg(F.min("slot_ts"), F.max("slot_ts")).first()
    assert (str(first), str(last)) == ("2024-03-05 23:20:00", "2024-03-06 00:20:00")


def test_live_slots(spark):
    log = inbound(spark, [
        leg("I", "11:06:00", "0"), leg("O", "11:06:01", "0", resp="00"),  # before the lookback
        leg("I", "11:08:00", "1"), leg("O", "11:08:02", "1", resp="00"),
        leg("I", "11:09:00", "2"), leg("O", "11:09:02", "2", resp="05"),
        leg("I", "11:58:00", "3", trx="NEW_KEY"), leg("O", "11:58:01", "3", resp="00"),
        leg("I", "11:59:00", "4"), leg("O", "12:00:30", "4", resp=None),
        leg("I", "11:59:30", "5")])
    now = at("12:07:00")
    facts = dashboards.inbound_slots(log, exclude_trx=("NEW_KEY",), as_of=now)
    series = dashboards.live_series(facts, now, ["ATMD", "QUIET"]).cache()
    assert series.groupBy("switch_id").count().where("count != 13").count() == 0
    used = series.where("tot > 0").withColumn("slot", slot_label("slot_ts"))
    assert rows(used, "switch_id", "slot", "approve", "tot", "rate") == [
        ("ATMD", "11:05", 1, 2, 50), ("ATMD", "11:55", 0, 1, 0)]
    assert series.where("approve > tot").count() == 0
    other = dashboards.inbound_slots(log, exclude_trx=("NEW_KEY",), exclude_response_trx=("NPAYMNT",), as_of=now)
    assert other.count() == 0


def test_replayed_polls_equal_live_polls(spark):
    start = datetime(2024, 3, 5, 0, 0)
    data = []
    for i in range(200):
        when = start + timedelta(minutes=7 * i)
        data.append(leg("I", when, str(i), day=when.date()))
        data.append(leg("O", when, str(i), resp="00" if i % 3 else "05", day=when.date()))
    log = inbound(spark, data).cache()
    columns = ["slot_no", "slot_ts", "approve", "tot"]
    for every in (5, 30, 60):
        replay = dashboards.replayed_series(
            dashboards.inbound_slots(log), spine.polls_every(log, every), every, ["ATMD"]).cache()
        for poll in (start + timedelta(hours=1), start + timedelta(hours=7), start + timedelta(hours=23)):
            live = dashboards.live_series(dashboards.inbound_slots(log, as_of=poll), poll, ["ATMD"])
            assert live.where("tot > 0").count() > 0
            assert rows(live, *columns) == rows(
                replay.where(F.col("poll_ts") == F.lit(str(poll)).cast("timestamp")), *columns)
    odd = start + timedelta(hours=9, minutes=35)
    replay = dashboards.replayed_series(dashboards.inbound_slots(log), spine.polls_every(log, 5), 5, ["ATMD"])
    live = dashboards.live_series(dashboards.inbound_slots(log, as_of=odd), odd, ["ATMD"])
    assert rows(live, *columns) == rows(replay.where(F.col("poll_ts") == F.lit(str(odd)).cast("timestamp")), *columns)


def test_trim_spine(spark):
    axis = spine.minute_spine(spine.polls_at(spark, at("12:00:00")))
    assert [r["slot_no"] for r in spine.trim_spine(axis).orderBy("slot_no").collect()] == list(range(1, 12))
    assert spine.trim_spine(axis, 1, 2).count() == 10


def test_day_scans(spark):
    log = inbound(spark, [leg("I", "10:00:00", "1"),
                          leg("I", datetime(2024, 3, 4, 23, 59, 59), "2", day=datetime(2024, 3, 4).date()),
                          leg("I", datetime(2024, 2, 1, 9, 0), "3", day=datetime(2024, 2, 1).date())])
    assert rows(scan_day(log, at("12:00:00")), "trc_ad_no") == [("1",)]
    assert rows(scan_trailing_days(log, at("12:00:00"), 30), "trc_ad_no") == [("1",), ("2",)]
    assert rows(lookback(log, datetime(2024, 3, 5, 0, 30), 60), "trc_ad_no") == [("2",)]


def test_window_ends(spark):
    log = inbound(spark, [leg("I", "11:56:20", "lo"), leg("I", "11:56:25", "in"), leg("I", "11:56:30", "hi"),
                          leg("I", "11:56:31", "after")])
    half_open = lagged_window(log, at("12:00:00"), 210, 10)
    closed = lagged_window(log, at("12:00:00"), 210, 10, inclusive=True)
    assert rows(half_open, "trc_ad_no") == [("in",), ("lo",)]
    assert rows(closed, "trc_ad_no") == [("hi",), ("in",), ("lo",)]


def test_throughput_now_and_strip(spark):
    log = inbound(spark, [
        leg("I", "11:56:21", "1"), leg("O", "11:56:22", "1", resp="00"),
        leg("I", "11:56:20", "2"), leg("O", "11:56:22", "2", resp="05"),
        leg("I", "11:56:15", "3"), leg("O", "11:56:16", "3", resp="00"),
        leg("I", "11:56:22", "4", bsns="ODS"), leg("O", "11:56:23", "4", bsns="ODS", resp="00")])
    calls = outbound(spark, [call("11:56:20", "FINN"), call("11:56:10", "FINN", resp="05")])
    now = throughput(log, calls, at("12:00:00"))
    assert rows(now, "direction", "approve", "tot") == [("INC", 1, 2), ("OUT", 1, 1)]
    strip = throughput(log, calls, at("12:00:10"), lag=220, windows=11)
    assert strip.count() == 22
    assert rows(strip.where("tot > 0"), "direction", "window_no", "approve", "tot") == [
        ("INC", 0, 1, 2), ("INC", 1, 1, 1), ("OUT", 0, 1, 1), ("OUT", 1, 0, 1)]
    labels = strip.where("direction = 'INC' and window_no in (0, 6)").select(
        F.date_format("label_ts", "HH:mm:ss"))
    assert rows(labels) == [("11:59:10",), ("12:00:10",)]
    closed = throughput(log, calls, at("12:00:10"), lag=220, windows=11, inclusive=True)
    assert rows(closed.where("tot > 0 and direction = 'INC'"), "window_no", "tot") == [(0, 2), (1, 2)]


def test_empty_throughput_is_zero(spark):
    now = throughput(inbound(spark, []), outbound(spark, []), at("12:00:00"))
    assert rows(now, "direction", "approve", "tot", "rate") == [("INC", 0, 0, None), ("OUT", 0, 0, None)]


def test_rolling_strip(spark):
    samples = spark.createDataFrame(
        [("INC", i, at("12:00:00") - timedelta(seconds=10 * i), 0, i * 10) for i in range(15)],
        "direction string, window_no long, label_ts timestamp, approve long, tot long")
    strip = {r["strip_no"]: r for r in rolling_strip(samples).collect()}
    assert strip[0]["samples"] == "100,90,80,70,60,50,40,30,20,10,0"
    assert strip[0]["tot"] == 550 and str(strip[0]["label_ts"]) == "2024-03-05 12:00:00"
    assert strip[12]["samples"] == "140,130,120"


def test_hour_spine_and_details(spark):
    log = inbound(spark, [leg("I", "09:10:00", "1"), leg("O", "09:10:01", "1", resp="00"),
                          leg("I", "09:20:00", "2"), leg("O", "09:20:01", "2", resp="51"),
                          leg("I", "23:59:59", "3"), leg("O", "23:59:59", "3", resp="00")])
    days = spine.day_spine(log)
    detail = drilldown.hourly_detail(log, days, "ATMD", "NPAYMNT")
    assert detail.select("hour").distinct().count() == 24 and detail.count() == 25
    assert rows(detail.where("n > 0"), "hour", "resp_cd", "n") == [("09", "00", 1), ("09", "51", 1), ("23", "00", 1)]
    wide = drilldown.hourly_pivot(drilldown.hourly_codes(log, "ATMD"), ["00", "51", "05"])
    assert rows(wide, "hour", "00", "51", "05") == [("09", 1, 1, None), ("23", 1, None, None)]


def test_hourly_channel_takes_both_directions(spark):
    log = inbound(spark, [leg("I", "09:10:00", "1", switch="RNTS", bsns="PBK"),
                          leg("O", "09:10:01", "1", switch="RNTS", bsns="PBK", resp="00"),
                          leg("I", "09:11:00", "2", switch="RNTS", bsns="PBK", trx="LOG__ON"),
                          leg("O", "09:11:01", "2", switch="RNTS", bsns="PBK", trx="LOG__ON", resp="00")])
    calls = outbound(spark, [call("10:00:00", "RNTS", "0200A01", "05"), call("10:00:00", "RNTS", "#LOG_ON"),
                             call("10:00:00", "RNTS", "PDFMAIL")])
    detail = drilldown.hourly_channel(log, calls, spine.day_spine(log), "RNTS")
    assert rows(detail.where("n > 0"), "hour", "direction", "trx_cd", "resp_cd", "n") == [
        ("09", "INC", "NPAYMNT", "00", 1), ("10", "OUT", "0200A01", "05", 1)]


def test_slot_alert_hours(spark):
    def alerted(poll, channel="ATMD"):
        log = inbound(spark, [leg("I", "00:01:00", "1")])
        facts = dashboards.inbound_slots(log, as_of=poll)
        series = dashboards.live_series(facts, poll, ["ATMD", "LOCL"])
        return rows(alerts.zero_approval(series, [channel]), "switch_id")

    assert alerted(at("08:40:00")) == []            # slot 08:30 is not after 08:30:00
    assert alerted(at("08:50:00")) == [("ATMD",)]   # slot 08:40
    assert alerted(at("20:10:00")) == [("ATMD",)]   # slot 20:00 still lies before 20:00:00
    assert alerted(at("20:20:00")) == []


def test_feed_alert(spark):
    def beat(poll, rows_):
        feed = spark.createDataFrame(rows_, "feed_dt date, event_ts timestamp, ric string")
        return dashboards.live_heartbeat(dashboards.feed_slots(feed, as_of=poll), poll)

    tick = (at("00:00:00").date(), at("09:52:00"), "USD")
    assert alerts.feed_silent(beat(at("10:00:00"), [tick])).count() == 0
    assert alerts.feed_silent(beat(at("10:10:00"), [tick])).count() == 1
    saturday = datetime(2024, 3, 9, 10, 0)
    assert alerts.feed_silent(beat(saturday, [tick])).count() == 0
    blank = (at("00:00:00").date(), at("09:51:00"), None)
    assert rows(beat(at("10:00:00"), [tick, blank]).where("tot > 0"), "slot_no", "tot") == [(10, 1)]
