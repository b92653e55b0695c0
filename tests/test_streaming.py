import itertools
import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tables import at, call, inbound, leg, outbound, rows
from tallyrail import schemas
from tallyrail.operators.legs import KEYS_3, requests, responses
from tallyrail.registry import QUERIES, stream_queries
from tallyrail.registry import views as v
from tallyrail.session import work_dir
from tallyrail.streaming import alerts, jobs, pairing, windows

START = at("10:00:00")


def legs():
    data = []
    for i in range(40):
        when = START + timedelta(seconds=7 * i)
        trace = str(i % 10)
        data.append(leg("I", when, trace, f"r{i}"))
        if i % 5:
            data.append(leg("O", when + timedelta(seconds=3), trace, f"r{i}", resp="00" if i % 2 else "05"))
    data += [leg("I", START, "hot", "same") for _ in range(30)]
    data += [leg("O", START + timedelta(seconds=1), "hot", "same", resp="00") for _ in range(20)]
    # Answered after the settle time, and a response that comes before its request.
    data += [leg("I", START, "late", "x"), leg("O", START + timedelta(seconds=211), "late", "x", resp="00")]
    data += [leg("I", START + timedelta(seconds=9), "odd", "x"), leg("O", START, "odd", "x", resp="00")]
    data += [leg(io, START + timedelta(days=1), "marker", resp="00") for io in "IO"]
    return data


def stream(spark, df):
    path = work_dir(spark, "source")
    df.coalesce(2).write.parquet(path)
    return jobs.read_log_stream(spark, path, df.schema)


def test_pairs_and_unanswered(spark):
    log = stream(spark, inbound(spark, legs()))
    paired = pairing.pair_stream(requests(log), responses(log), by=["trx_cd"])
    got = jobs.replay(paired, "pairs").cache()
    assert got.agg(F.sum("tot"), F.sum("approve")).first() == (32 + 600, 16 + 600)
    assert rows(got.where("trc_ad_no = 'hot'"), "approve", "tot") == [(600, 600)]
    assert got.where("trc_ad_no in ('late', 'odd', 'marker')").count() == 0
    missing = jobs.replay(pairing.unanswered_stream(requests(log), responses(log)), "missing")
    assert rows(missing, "trc_ad_no", "ret_ref_no", "n_requests") == sorted(
        [("0" if i % 10 == 0 else "5", f"r{i}", 1) for i in range(0, 40, 5)]
        + [("late", "x", 1), ("odd", "x", 1)], key=repr)


def reused_keys():
    """Trace numbers without a reference number: one that comes every second, and odd ones about the settle time."""
    asked = {"busy": range(0, 900), "edge": [0, 104, 105, 209, 210, 420], "alone": [5, 600], "back": [300]}
    answered = {"busy": range(0, 900, 2), "edge": [210, 315, 631], "alone": [216, 810], "back": [299]}
    return asked, answered


def test_reused_keys_are_not_paired_response_by_response(spark):
    asked, answered = reused_keys()
    end = START + timedelta(days=1)
    data = [leg("I", START + timedelta(seconds=s), k, f"q{s}") for k, v in asked.items() for s in v for _ in range(1 + (k == "edge"))]
    data += [leg("O", START + timedelta(seconds=s), k, f"r{s}", resp="00" if s % 4 else "05") for k, v in answered.items() for s in v]
    path = work_dir(spark, "reused")
    for part in range(4):  # a batch each, in time order: the state of the batch before counts
        some = [r for r in data if (r[1] - START).total_seconds() // 300 == part]
        some += [leg(io, end, "marker", resp="00") for io in "IO"] if part == 3 else []
        inbound(spark, some).coalesce(1).write.mode("append").parquet(path)
    whole = stream(spark, inbound(spark, data + [leg(io, end, "marker", resp="00") for io in "IO"]))
    parts = jobs.read_log_stream(spark, path, schemas.INBOUND_LOG, files_per_trigger=1)
    second = (F.unix_seconds("request_ts") - F.unix_seconds(F.lit(str(START)).cast("timestamp"))).alias("q")
    for log, name, settle in ((whole, "whole", 7), (whole, "same-second", 0), (parts, "parts", 210)):
        near = {(k, q): [r for r in answered[k] if 0 <= r - q <= settle] for k, v in asked.items() for q in v}
        want = {(k, q): (n * sum(r % 4 > 0 for r in found), n * len(found)) for (k, q), found in near.items() if found for n in [1 + (k == "edge")]}
        got = jobs.replay(pairing.pair_stream(requests(log), responses(log), KEYS_3, settle=settle), name, state_partitions=2).cache()
        sums = got.groupBy("trc_ad_no", second).agg(F.sum("approve"), F.sum("tot")).collect()
        assert {(k, q): (approve, tot) for k, q, approve, tot in sums} == want
        assert got.count() <= 3 * len(near)  # some rows per request second, not one for every response that it meets
    missing = jobs.replay(pairing.unanswered_stream(requests(log), responses(log), KEYS_3), "missing", state_partitions=2)
    assert rows(missing.select("trc_ad_no", second, "n_requests")) == sorted(
        [(k, q, 1 + (k == "edge")) for (k, q), found in near.items() if not found], key=repr)


def test_throughput_and_alerts(spark):
    log = stream(spark, inbound(spark, legs()))
    calls = stream(spark, outbound(spark, [call("10:00:03", "FINN"), call("10:00:09", "FINN", resp="05"),
                                           call("23:59:59", "FINN")]))
    paired = pairing.pair_stream(requests(log), responses(log), by=[])
    got = jobs.replay(windows.throughput_stream(paired, calls), "throughput").cache()
    first = got.where(F.col("window_start") == F.lit(str(START)).cast("timestamp"))
    assert rows(first, "direction", "approve", "tot", "rate") == [("INC", 601, 601, 100), ("OUT", 1, 2, 50)]
    assert got.where("direction = 'INC'").agg(F.sum("tot")).first()[0] == 632
    rules = alerts.zero_approval_rules(spark, ["ATMD", "MUTE"])
    slots = windows.window_paired(paired, "10 seconds", ["switch_id"])
    found = alerts.replay_alerts(slots, "alerts", rules, "10 seconds", state_partitions=2).cache()
    assert found.where("approve > 0").count() == 0
    closed = got.where("direction = 'INC'").agg(
        F.min("window_start"), F.max("window_start")).first()
    n_windows = (closed[1] - closed[0]).total_seconds() // 10 + 1
    # A channel without any row alerts in every closed window, and one whose requests go unanswered in its own.
    assert found.where("switch_id = 'MUTE' and tot = 0").count() == n_windows
    assert found.where("switch_id = 'ATMD' and tot = 0").count() > 0


def events(spark, folder):
    """Three days of events, of which a third come in one instant and some at no time, in files that are in no order of time."""
    hot = START + timedelta(days=1)
    times = [hot if i % 3 == 0 else None if i % 50 == 1 else START + timedelta(seconds=i * 7919 % 250_000, microseconds=i) for i in range(600)]
    kinds = ("click", "error", "view", "purchase", "signup")
    data = [(i, t, i % 4, kinds[i * 7 % 5], i / 2, f'{{"k": {i * 31 % 100}}}') for i, t in enumerate(times)]
    spark.createDataFrame(data, v.TABLES["events"]).repartition(3).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def offsets(folder, name):
    """The number and metadata of the last micro-batches of the job that ran in a folder of this name."""
    found = sorted(folder.glob(f"{name}-*/checkpoint/offsets/[0-9]*"), key=lambda f: int(f.name))
    return [(int(f.name), json.loads(f.read_text().split("\n")[1])) for f in found]


@pytest.mark.parametrize("name, folder", [("stream_slots", "slots"), ("slots_maintained", "counts")])
def test_a_long_log_is_replayed_in_turns(spark, monkeypatch, tmp_path, name, folder):
    sf, number = events(spark, tmp_path / "sf"), itertools.count()
    whole = rows(QUERIES[name](spark, sf))
    for module in (jobs, stream_queries):
        monkeypatch.setattr(module, "work_dir", lambda spark, name: f"{tmp_path}/{name}-{next(number)}")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.unset(provider)
    try:
        monkeypatch.setattr(jobs, "TURN_ROWS", 25)  # of 600 rows, for 8 state partitions: three turns
        assert rows(QUERIES[name](spark, sf)) == whole and whole
        assert spark.conf.get(provider, None) is None
    finally:
        spark.conf.set(provider, before)
    batches = offsets(tmp_path, folder)
    marks = [b["batchWatermarkMs"] for _, b in batches]
    # A turn's state is let go when the next comes, and is on disk until then.
    assert batches[-1][0] >= 3 and marks == sorted(marks) and 0 < marks[-3] < marks[-2] < marks[-1]
    assert all("RocksDB" in b["conf"][provider] for _, b in batches)


def test_a_store_without_times_of_files_gets_one_batch(spark, monkeypatch, tmp_path):
    sf = events(spark, tmp_path / "sf")
    whole = rows(QUERIES["stream_slots"](spark, sf))
    monkeypatch.setattr(jobs, "work_dir", lambda spark, name: f"{tmp_path}/{name}-0")
    monkeypatch.setattr(jobs, "_timed_by_name", lambda spark, folder: False)
    monkeypatch.setattr(jobs, "TURN_ROWS", 25)
    assert rows(QUERIES["stream_slots"](spark, sf)) == whole
    assert dict(offsets(tmp_path, "slots"))[1]["batchWatermarkMs"] > (START + timedelta(days=3)).timestamp() * 1000


def test_update_mode_ends_with_the_batch_counts(spark):
    calls = stream(spark, outbound(spark, [call("10:00:03", "FINN"), call("10:04:09", "FINN", resp="05"),
                                           call("10:05:00", "SWDK")]))
    counted = windows.window_calls(calls, "5 minutes", ["switch_id"])
    query = (counted.writeStream.outputMode("update").format("memory").queryName("slots_update")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    assert rows(spark.table("slots_update"), "switch_id", "approve", "tot") == [("FINN", 1, 2), ("SWDK", 1, 1)]


def test_late_rows_are_left_out(spark):
    path = work_dir(spark, "late")
    for time in ["10:00:00", "10:30:00", "10:31:00", "10:00:05", "11:30:00"]:
        outbound(spark, [call(time, "FINN")]).coalesce(1).write.mode("append").parquet(path)
    log = jobs.read_log_stream(spark, path, schemas.OUTBOUND_LOG, files_per_trigger=1)
    got = jobs.replay(windows.window_calls(log, "10 seconds"), "late")
    assert rows(got.select(F.date_format("window_start", "HH:mm:ss"), "tot")) == [
        ("10:00:00", 1), ("10:30:00", 1), ("10:31:00", 1)]


def test_a_restarted_query_goes_on_where_it_stopped(spark):
    source, folder = work_dir(spark, "live"), work_dir(spark, "live-out")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    for time in ("10:00:00", "10:30:00", "11:30:00"):
        outbound(spark, [call(time, "FINN")]).coalesce(1).write.mode("append").parquet(source)
        log = jobs.read_log_stream(spark, source, schemas.OUTBOUND_LOG)
        query = jobs.run_to_parquet(windows.window_calls(log, "10 seconds"), folder, every="1 second", state_partitions=3)
        query.processAllAvailable()
        query.stop()
    got = spark.read.parquet(f"{folder}/data")
    assert rows(got.select(F.date_format("window_start", "HH:mm:ss"), "tot")) == [("10:00:00", 1), ("10:30:00", 1)]
    assert spark.conf.get("spark.sql.shuffle.partitions") == partitions
    kept = spark.read.text(f"{folder}/checkpoint/offsets").where("value like '%shuffle.partitions%'")
    assert kept.count() > 0 and kept.where("value not like '%\"spark.sql.shuffle.partitions\":\"3\"%'").count() == 0


def test_alerts_go_on_where_the_batch_before_closed(spark):
    folder = work_dir(spark, "silence")
    rules = alerts.zero_approval_rules(spark, ["ATMD"], ("00:00", "23:59"))
    def batch(*times):
        return spark.createDataFrame([(at(t), "SWDK", 1, 1) for t in times], "window_start timestamp, switch_id string, approve long, tot long")
    schemas.literal_table(spark, [], alerts.CLOSED).write.parquet(f"{folder}/closed/batch_id=-1")
    write = alerts.alert_writer(folder, rules, "5 minutes")
    write(batch("10:00:00", "10:10:00"), 0)
    write(batch("10:25:00"), 1)
    write(batch("10:25:00"), 1)
    write(batch(), 2)
    got = spark.read.parquet(f"{folder}/data")
    assert rows(got.select("batch_id", F.date_format("window_start", "HH:mm"))) == [
        (0, "10:00"), (0, "10:05"), (0, "10:10"), (1, "10:15"), (1, "10:20"), (1, "10:25")]


def test_a_file_path_with_pattern_characters(spark):
    folder = work_dir(spark, "odd")
    outbound(spark, [call("10:00:00", "FINN"), call("11:30:00", "FINN")]).coalesce(1).write.parquet(folder)
    name = [f.rsplit("/", 1)[1] for f in spark.read.parquet(folder).inputFiles()][0]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.rename(path(f"{folder}/{name}"), path(f"{folder}/part?{{1}}.parquet"))
    log = jobs.read_log_stream(spark, f"{folder}/part?{{1}}.parquet", schemas.OUTBOUND_LOG)
    assert jobs.replay(windows.window_calls(log, "10 seconds"), "odd").count() == 1


def test_a_repeated_batch_overwrites_itself(spark):
    calls = outbound(spark, [call("10:00:00", "FINN"), call("11:00:00", "FINN")])
    folder = work_dir(spark, "batches")
    write = jobs.batch_writer(folder, lambda batch: batch.select("switch_id"))
    for batch_id in (0, 1, 1):
        write(calls, batch_id)
    assert spark.read.parquet(f"{folder}/data").groupBy("batch_id").count().orderBy("batch_id").collect() == [(0, 2), (1, 2)]
