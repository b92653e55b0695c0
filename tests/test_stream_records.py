"""Maintained counts, corrected windows, late rows and silence, each against the batch reading."""

from datetime import timedelta

from pyspark.sql import functions as F

from tables import at, call, inbound, leg, outbound, rows
from tallyrail import schemas
from tallyrail.operators.legs import KEYS_5, requests, responses
from tallyrail.operators.throughput import throughput
from tallyrail.plans import dashboards
from tallyrail.session import settings, work_dir
from tallyrail.streaming import alerts, counts, jobs, pairing, progress, upserts, windows

START = at("10:00:00")


def minute_log(minutes, first=0):
    """Two channels; requests on slot and window starts too, some unanswered, every trace number used again and again."""
    data = []
    for i in range(first * 6, minutes * 6):
        when = START + timedelta(seconds=10 * i)
        switch = "ATMD" if i % 3 else "GIBI"
        data.append(leg("I", when, str(i % 7), f"r{i}", switch))
        if i % 4:
            data.append(leg("O", when + timedelta(seconds=3), str(i % 7), f"r{i}", switch, resp="00" if i % 5 else "05"))
    return data


def add(spark, path, df):
    df.repartition(3).write.mode("append").parquet(path)


def test_live_readings_equal_the_batch_reading_at_every_poll(spark):
    source, folder = work_dir(spark, "live-log"), work_dir(spark, "live-counts")
    channels = ["ATMD", "GIBI", "MUTE"]
    settled = []
    for part in range(3):
        add(spark, source, inbound(spark, minute_log(25 * part + 25, 25 * part)))
        stream = jobs.read_log_stream(spark, source, schemas.INBOUND_LOG)
        counts.run_counts(requests(stream), responses(stream), folder, state_partitions=3).awaitTermination()
        log = spark.read.schema(schemas.INBOUND_LOG).parquet(source).cache()
        settled.append(counts.kept_counts(spark, folder, 10)[1])
        if part == 1:  # readings go on over merged tables
            before = rows(counts.kept_counts(spark, folder, 10)[0])
            last = counts.compact(spark, folder)
            assert upserts.numbers(spark, f"{folder}/data", "batch_id") == [] and len(upserts.numbers(spark, f"{folder}/closed", "batch_id")) == 1
            assert rows(counts.kept_counts(spark, folder, 10)[0]) == before and len(before) > 50 and last >= 0
        for second in (0, 7, 295) if part == 2 else (130,):
            as_of = START + timedelta(minutes=25 * part + 19, seconds=second)
            seen = log.where(F.col("event_ts") <= F.lit(str(as_of)).cast("timestamp"))
            want = dashboards.live_series(dashboards.inbound_slots(seen, KEYS_5, as_of=as_of), as_of, channels)
            got = dashboards.live_series(counts.live_slots(spark, folder, seen, as_of), as_of, channels)
            assert rows(got, "slot_no", "switch_id", "approve", "tot", "rate") == rows(want, "slot_no", "switch_id", "approve", "tot", "rate")
    assert settled == sorted(settled) and settled[0] and settled[-1] >= START + timedelta(minutes=65)
    # No window is counted twice, and only the open end is read from the log.
    for lag, hit in ((600, True), (20, False)):
        as_of = START + timedelta(minutes=75)
        want = throughput(log, outbound(spark, []), as_of, lag, ts="event_ts").where("direction = 'INC'")
        got = counts.live_throughput(spark, folder, log, as_of, lag)
        assert rows(got) == rows(want, "approve", "tot")
        assert got.first().tot > 0 or not hit


def test_the_open_end_is_read_by_time_on_both_legs(spark):
    source, folder = work_dir(spark, "log"), work_dir(spark, "counts")
    inbound(spark, minute_log(60)).write.parquet(source)
    stream = jobs.read_log_stream(spark, source, schemas.INBOUND_LOG)
    counts.run_counts(requests(stream), responses(stream), folder, state_partitions=2).awaitTermination()
    facts = counts.live_slots(spark, folder, spark.read.schema(schemas.INBOUND_LOG).parquet(source), START + timedelta(minutes=59))
    with settings(spark, {"spark.sql.maxMetadataStringLength": "2000"}):
        scans = [s for s in facts._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan parquet" in s]
    legs = [s for s in scans if "io_cd" in s]
    assert legs and all("GreaterThanOrEqual(event_ts" in s and "LessThan" in s for s in legs)


def test_counts_before_the_first_closed_window(spark):
    source, folder = work_dir(spark, "log"), work_dir(spark, "counts")
    inbound(spark, minute_log(2)).write.parquet(source)
    stream = jobs.read_log_stream(spark, source, schemas.INBOUND_LOG)
    counts.run_counts(requests(stream), responses(stream), folder, state_partitions=2).awaitTermination()
    log = spark.read.schema(schemas.INBOUND_LOG).parquet(source)
    assert counts.kept_counts(spark, folder, 10)[1] is None
    as_of = START + timedelta(minutes=2)
    want = dashboards.live_series(dashboards.inbound_slots(log, KEYS_5, as_of=as_of), as_of, ["ATMD", "GIBI"])
    for facts in (counts.live_slots(spark, folder, log, as_of), counts.all_slots(spark, folder, log, as_of)):
        assert rows(dashboards.live_series(facts, as_of, ["ATMD", "GIBI"])) == rows(want)


def test_corrected_windows_are_versions_and_compact_to_one(spark):
    source, folder, keys = work_dir(spark, "calls"), work_dir(spark, "updates"), ["window_start", "switch_id"]
    sent = []
    schema = windows.window_calls(outbound(spark, []), "5 minutes", ["switch_id"]).schema

    def send(*calls):
        sent.extend(calls)
        add(spark, source, outbound(spark, list(calls)))
        stream = jobs.read_log_stream(spark, source, schemas.OUTBOUND_LOG)
        upserts.run_upserts(windows.window_calls(stream, "5 minutes", ["switch_id"], delay="10 minutes"), folder, state_partitions=2).awaitTermination()

    def check():
        want = windows.window_calls(outbound(spark, sent), "5 minutes", ["switch_id"])
        assert rows(upserts.latest(spark, folder, schema, keys)) == rows(want)
    send(call("10:00:03", "FINN"), call("10:04:09", "FINN", resp="05"), call("10:05:00", "SWDK"))
    check()
    send(call("10:01:00", "FINN"), call("10:09:00", "SWDK"))  # late, but within the delay
    check()
    before = upserts.latest(spark, folder, schema, keys).count()
    # A repeated batch overwrites its own version.
    last = max(upserts.numbers(spark, f"{folder}/data", "batch_id"))
    again = spark.read.schema(schema).parquet(f"{folder}/data/batch_id={last}")
    jobs.batch_writer(folder, lambda batch: batch)(spark.createDataFrame(again.collect(), schema), last)
    check()
    assert upserts.compact(spark, folder, schema, keys) == last and upserts.numbers(spark, f"{folder}/data", "batch_id") == []
    check()
    send(call("10:02:00", "FINN", resp="05"))
    check()
    assert upserts.compact(spark, folder, schema, keys) > last and upserts.numbers(spark, f"{folder}/base", "upto")[:-1] == []
    check()
    assert upserts.latest(spark, folder, schema, keys).count() == before == 2
    assert upserts.compact(spark, work_dir(spark, "nothing"), schema, keys) == -1


def test_late_rows_are_counted_by_the_watermarks_rule(spark):
    """Three late rows of different windows and one in time, after the watermark has moved."""
    source, folder = work_dir(spark, "calls"), work_dir(spark, "late")
    parts = [["10:00:00", "10:30:00"], ["10:31:00", "10:00:05", "10:01:00", "10:02:00", "10:27:30"], ["11:30:00"], ["11:29:00", "10:31:00"]]
    query_folder = f"{folder}/windows"
    for times in parts:
        add(spark, source, outbound(spark, [call(t, "FINN") for t in times]))
        stream = jobs.read_log_stream(spark, source, schemas.OUTBOUND_LOG)
        progress.run_late_rows(stream, folder, "10 seconds", by=["switch_id"]).awaitTermination()
        query = jobs.run_to_parquet(windows.window_calls(stream, "10 seconds"), query_folder, state_partitions=1)
        progress.finish(query, progress.keep_progress(query, query_folder), query_folder)
    got = progress.late_batches(spark, folder)
    assert rows(got.where("batch_id >= 0"), "batch_id", "n_rows", "n_late") == [(0, 2, 0), (1, 5, 3), (2, 1, 0), (3, 2, 1)]
    assert spark.read.parquet(f"{folder}/late_by").agg(F.sum("n_late")).first()[0] == 4
    kept = progress.progress(spark, query_folder)
    # Each late row lies in a window of its own, so what the operator drops after combining is as many.
    assert kept.groupBy("operator").agg(F.sum("rows_dropped")).collect() == [("stateStoreSave", 4)]
    assert kept.agg(F.sum("rows_read")).first()[0] >= 10 and kept.where("watermark is not null").count() > 0
    result = jobs.results(spark, query_folder, windows.window_calls(outbound(spark, []), "10 seconds").schema)
    assert result.agg(F.sum("tot")).first()[0] == 10 - 4 - 2  # the windows of 11:29 and 11:30 are open yet


def test_progress_names_each_operator_of_a_pairing(spark):
    source, folder = work_dir(spark, "log"), work_dir(spark, "pairs")
    for first, last in ((0, 10), (30, 40), (2, 4)):  # the last part is far behind the watermark
        add(spark, source, inbound(spark, minute_log(last, first)))
        stream = jobs.read_log_stream(spark, source, schemas.INBOUND_LOG)
        query = jobs.run_to_parquet(pairing.pair_stream(requests(stream), responses(stream), settle=30, delay="30 seconds"), folder, state_partitions=2)
        progress.finish(query, progress.keep_progress(query, folder), folder)
    kept = progress.progress(spark, folder)
    dropped = {(r.operator, r.operator_no): r["sum(rows_dropped)"] for r in kept.groupBy("operator", "operator_no").sum("rows_dropped").collect()}
    assert sorted(o for o, _ in dropped) == ["stateStoreSave", "stateStoreSave", "symmetricHashJoin"]
    late = minute_log(4, 2)
    assert sorted(n for (o, _), n in dropped.items() if o == "stateStoreSave") == sorted(sum(r[5] == io for r in late) for io in "IO")


def test_a_silent_log_alerts_before_traffic_returns(spark):
    source, folder = work_dir(spark, "log"), work_dir(spark, "alerts")
    rules = alerts.zero_approval_rules(spark, ["ATMD", "GIBI"], ("00:00", "23:59"))

    def run(data):
        add(spark, source, inbound(spark, data))
        stream = jobs.read_log_stream(spark, source, schemas.INBOUND_LOG)
        paired = pairing.pair_stream(requests(stream), responses(stream), by=[])
        slots = windows.window_paired(paired, "5 minutes", ["switch_id"])
        alerts.run_alerts(slots, folder, rules, "5 minutes", state_partitions=2).awaitTermination()
        return slots.select(alerts.ALERTS).schema

    def shown():
        found = alerts.alerts_so_far(spark, folder, schema)
        return rows(found.select("switch_id", F.date_format("window_start", "HH:mm"), "tot"))
    schema = run(minute_log(30))  # busy until 10:30
    assert shown() == []
    poll = at("11:33:00")
    for _ in (1, 2):  # a repeated poll overwrites itself
        alerts.watch_silence(spark, folder, rules, "5 minutes", poll)
    closed = spark.read.parquet(f"{folder}/closed").agg(F.max("last_window")).first()[0]
    first = closed + timedelta(minutes=5)
    quiet = [first + timedelta(minutes=5 * i) for i in range(40) if first + timedelta(minutes=5 * i) <= at("11:20:00")]
    assert len(quiet) >= 11  # an hour without rows
    assert {s for s, _, _ in shown()} == {"ATMD", "GIBI"} and len(shown()) == 2 * len(quiet)
    alerts.watch_silence(spark, folder, rules, "5 minutes", poll + timedelta(minutes=5))
    assert len(shown()) == 2 * len(quiet) + 2
    # Traffic returns: the stream closes the same windows itself, once, and those with rows are not alerts.
    run(minute_log(150, 90))
    got = shown()
    assert len(got) == len(set(got)) and {t for _, t, _ in got} == {f"{10 + m // 60}:{m % 60:02d}" for m in range(30, 90, 5)}


def test_silence_before_the_first_window(spark):
    folder = work_dir(spark, "alerts")
    rules = alerts.zero_approval_rules(spark, ["ATMD"], ("00:00", "23:59"))
    schemas.literal_table(spark, [], alerts.CLOSED).write.parquet(f"{folder}/closed/batch_id=-1")
    schemas.literal_table(spark, [], alerts.WINDOWS).write.parquet(f"{folder}/data")
    alerts.watch_silence(spark, folder, rules, "5 minutes", at("10:20:00"))
    schema = alerts.window_alerts(schemas.literal_table(spark, [], alerts.WINDOWS), rules.withColumn("window_start", F.lit(None).cast("timestamp"))).schema
    assert alerts.alerts_so_far(spark, folder, schema).count() == 0  # nobody said since when to watch
    alerts.watch_silence(spark, folder, rules, "5 minutes", at("10:20:00"), since=at("10:02:00"))
    got = alerts.alerts_so_far(spark, folder, schema)
    assert rows(got.select(F.date_format("window_start", "HH:mm"))) == [("10:00",), ("10:05",), ("10:10",)]
