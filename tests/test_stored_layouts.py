"""Stored layouts: what a report need not shuffle or read."""

import hashlib
import re
import uuid
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

import test_reports
from tables import at, call, inbound, leg, outbound, rows
from test_legs import sample
from tallyrail import schemas
from tallyrail.operators import dims, payload
from tallyrail.operators.legs import (
    KEYS_3, KEYS_4, KEYS_5, approval_measures, error_measures, pair_sums, pair_sums_in_place, pair_sums_stored, requests, responses)
from tallyrail.operators.throughput import throughput
from tallyrail.plans import dashboards, drilldown
from tallyrail.session import settings, work_dir
from tallyrail.sources import bucketed, readers, search_index, sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_read(df):
    """Rows that the scans of a plan without a shuffle hand on, after row groups and pages were pruned."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


@pytest.fixture(scope="module")
def data():
    rows_ = sample(600)
    rows_ += [leg("I" if i % 2 else "O", f"{i % 24:02d}:00:00", f"{i % 40:06d}", resp="00", day=date(2024, 3, 6 + i % 3)) for i in range(400)]
    return rows_


@pytest.fixture(scope="module")
def stored(spark, data):
    name, path = f"t_{uuid.uuid4().hex}", work_dir(spark, "bucketed")
    return name, path, bucketed.write_bucketed(inbound(spark, data), name, path, 32)


def test_buckets_hold_all_rows_and_heavy_keys_lie_apart(spark, data, stored):
    *_, log = stored
    columns = schemas.INBOUND_LOG.fieldNames()
    assert sorted(map(repr, map(tuple, log.even.select(columns).union(log.heavy.select(columns)).collect()))) == sorted(
        map(repr, map(tuple, inbound(spark, data).collect())))
    heavy = {(r.switch_id, r.trc_ad_no) for r in log.heavy.select("switch_id", "trc_ad_no").distinct().collect()}
    counts = inbound(spark, data).groupBy("switch_id", "trc_ad_no").count().collect()
    assert heavy == {(r.switch_id, r.trc_ad_no) for r in counts if r["count"] > 2 * len(data) / 32}
    assert any(t is None for _, t in heavy) or any(t == "000001" for _, t in heavy)
    assert not heavy & {(r.switch_id, r.trc_ad_no) for r in log.even.select("switch_id", "trc_ad_no").distinct().collect()}


def test_stored_sums_equal_the_joined_sums(spark, data, stored):
    *_, log = stored
    plain = inbound(spark, data)
    asked, answered = F.col("trx_cd") != "NINQURY", ~F.col("resp_cd").isin("05")
    for keys in (KEYS_3, KEYS_4, KEYS_5):
        for by, by_response in ((["trx_dt", "switch_id", "trx_cd"], ["resp_cd"]), (["trx_cd"], []), (["switch_id"], ["resp_cd"]), ([], [])):
            want = pair_sums(requests(plain).where(asked), responses(plain).where(answered), keys, by, error_measures(), by_response)
            got = pair_sums_stored(log, keys, by, error_measures(), by_response, asked, answered)
            shown = (*by, *by_response, "volume", "errors", "service_errors")
            assert rows(got, *shown) == rows(want, *shown)
    assert rows(pair_sums_in_place(plain, KEYS_3, ["trx_cd"], approval_measures())) == rows(
        pair_sums(requests(plain), responses(plain), KEYS_3, ["trx_cd"], approval_measures()))


def test_no_log_row_of_a_bucket_is_shuffled(spark, stored):
    *_, log = stored
    for keys, by in ((KEYS_3, ["trx_cd"]), (KEYS_5, ["trx_dt", "switch_id", "bsns_cd"])):
        text = plan(pair_sums_in_place(log.even, keys, by, approval_measures(), ["resp_cd"]))
        below = text[:text.index("Window")], text[text.index("Window"):]
        assert text.count("FileScan parquet") == 1 and "Bucketed: true" in text and "Join" not in text
        assert below[0].count("Exchange") == 1 and "Exchange" not in below[1]  # only the groups' sums
    day = log.even.where(F.col("trx_dt") == F.lit(date(2024, 3, 7)))
    assert re.search(r"PartitionFilters: \[[^\n]*2024-03-07", plan(pair_sums_in_place(day, KEYS_3, ["trx_cd"], approval_measures())))


def test_another_session_finds_the_buckets(spark, data, stored):
    name, path, log = stored
    other = spark.newSession()
    again = bucketed.open_bucketed(other, f"{name}_again", path, 32)
    got = pair_sums_stored(again, KEYS_4, ["trx_cd"], approval_measures())
    assert rows(got) == rows(pair_sums_stored(log, KEYS_4, ["trx_cd"], approval_measures()))
    assert "Bucketed: true" in plan(pair_sums_in_place(again.even, KEYS_4, ["trx_cd"], approval_measures()))


def test_an_empty_log_has_empty_buckets(spark):
    name, path = f"t_{uuid.uuid4().hex}", work_dir(spark, "bucketed")
    log = bucketed.write_bucketed(inbound(spark, []), name, path, 4)
    assert pair_sums_stored(log, KEYS_3, ["trx_cd"], approval_measures()).count() == 0
    assert rows(pair_sums_stored(log, KEYS_3, [], approval_measures())) == [(0, 0)]


@pytest.fixture(scope="module")
def clustered(spark):
    """Two days of a message a second, in files of many row groups; references are as good as random."""
    path = work_dir(spark, "clustered")
    start = at("00:00:00")
    log = spark.range(2 * 86_400).select(
        (F.lit(str(start)).cast("timestamp") + F.make_dt_interval(secs=F.col("id"))).alias("event_ts"), F.lit("ATMD").alias("switch_id"),
        F.when(F.col("id") % 2 == 0, "I").otherwise("O").alias("io_cd"), F.lpad((F.col("id") % 50).cast("string"), 6, "0").alias("trc_ad_no"),
        F.md5(F.col("id").cast("string").cast("binary")).alias("ret_ref_no"), F.lit("x" * 40).alias("log_data"))
    log = log.withColumn("trx_dt", F.to_date("event_ts")).repartition(7)
    with settings(spark, {"parquet.block.size": str(128 << 10), "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1MB"}):
        sinks.write_log(log, path)
    return readers.read_parquet(spark, path)


def test_a_lookback_reads_its_time_and_little_more(spark, clustered):
    found = readers.lookback(clustered, at("15:00:00"), 60)
    assert found.count() == 3601
    # The day before is pruned by the partition filter's one day of slack only, then by time.
    assert 3601 <= rows_read(found.select("event_ts", "ret_ref_no")) <= 30_000 < clustered.count() / 5


def test_one_transaction_reads_few_row_groups(spark, clustered):
    reference = hashlib.md5(b"4242").hexdigest()
    found = drilldown.correlated(clustered, "ATMD", f"{4242 % 50:06d}", reference)
    assert [r.event_ts for r in found.collect()] == [at("00:00:00") + timedelta(seconds=4242)]
    assert rows_read(found.select("event_ts", "ret_ref_no")) <= 40_000 < clustered.count() / 4
    nothing = drilldown.correlated(clustered, "ATMD", "000001", hashlib.md5(b"none").hexdigest())
    assert rows_read(nothing.select("event_ts", "ret_ref_no")) <= 40_000


def test_an_index_leaves_files_out_and_the_search_exact(spark):
    """Twelve files; a rare word in two of them, another word only in a response payload, one only in another channel."""
    path, index = work_dir(spark, "log"), work_dir(spark, "search-index")
    schema, columns = schemas.OUTBOUND_LOG, ["i_log_data", "o_log_data"]

    def rows_of(n):
        rare = f"ref{n % 6 == 2 and 'NEEDLE77' or 'common'}"
        return [call(f"10:{n:02d}:{i:02d}", "ATMD" if i % 2 else "FINN", request=f"{rare} {n * 1000 + i:08d} card 4111" if i != 1 else None,
                     out=("reply QUARTZ" if (n, i) == (5, 3) else "reply"), trace=f"{n}-{i}") for i in range(8)]
    for n in range(12):
        outbound(spark, rows_of(n)).coalesce(1).write.mode("append").parquet(path)
    assert search_index.index_files(spark, path, index, columns, schema) == 12
    assert search_index.index_files(spark, path, index, columns, schema) == 0
    whole = spark.read.schema(schema).parquet(path)
    none = inbound(spark, [])

    def check(keywords, files, channel="ATMD", like=False):
        found = search_index.narrowed(spark, path, index, columns, schema, channel, keywords, like)
        want = payload.search_payload(none, whole, channel, keywords, like=like)
        assert rows(payload.search_payload(none, found.log, channel, keywords, like=like)) == rows(want)
        assert (found.files, found.all_files) == files, keywords
        return want.count()
    assert check(["NEEDLE77"], (2, 12)) > 0 and check(["refNEEDLE77", "card"], (2, 12)) > 0
    assert check(["QUARTZ"], (1, 12)) == 1 and check(["QUARTZ"], (0, 12), "FINN") == 0
    assert check(["NEEDLE77", "QUARTZ"], (0, 12)) == 0  # one payload must hold both
    assert check(["00005003"], (1, 12)) == 1 and check(["nowhere"], (0, 12)) == 0
    assert check(["NEE%77"], (12, 12), like=True) > 0 and check(["N%DLE77 0000_003"], (2, 12), like=True) > 0  # parts of three letters say nothing
    assert check(["IDR"], (12, 12)) == 0 and check([""], (12, 12)) > 0
    # A file that came after the index is read until it is indexed.
    outbound(spark, rows_of(14)).coalesce(1).write.mode("append").parquet(path)
    whole = spark.read.schema(schema).parquet(path)
    assert check(["QUARTZ"], (2, 13)) == 1
    assert search_index.index_files(spark, path, index, columns, schema) == 1
    assert check(["QUARTZ"], (1, 13)) == 1 and check(["NEEDLE77"], (3, 13)) > 0


def test_layout_is_worked_out_once(spark):
    offsets = payload.layout_offsets(payload.message_layout(test_reports.layout(spark), dims.message_families(spark)))
    got = drilldown.transaction_detail(inbound(spark, sample(20)), outbound(spark, [call("10:00:00", "ATMD")]), offsets)
    text = plan(got)
    assert text.count("BroadcastHashJoin") == 2 and "Window" not in text and "Subquery" not in text and "SortMergeJoin" not in text


def test_live_readings_read_both_legs_by_time(spark, clustered):
    log = clustered.withColumns({"reg_ts": F.col("event_ts"), **{c: F.lit("x") for c in ("bsns_cd", "trx_cd", "resp_cd")}})
    as_of = at("12:00:00")
    calls = outbound(spark, [])
    for want, got in (
            (throughput(log, calls, as_of, 210, 10, ts="event_ts"), throughput(log, calls, as_of, 210, 10, ts="event_ts", live=True, settle=60)),
            (dashboards.inbound_slots(log, as_of=as_of, minutes=5), dashboards.inbound_slots(log, as_of=as_of, minutes=5, settle=60))):
        with settings(spark, {"spark.sql.maxMetadataStringLength": "2000"}):
            text = plan(got)
        scans = [s for s in text.split("\n") if "FileScan parquet" in s and "io_cd" in s]
        assert scans and all("GreaterThanOrEqual(event_ts" in s and "LessThan" in s for s in scans)
    day = log.where(F.col("trx_dt") == F.lit(date(2024, 3, 5)))
    assert rows(throughput(day, calls, as_of, 210, 10, ts="event_ts", settle=60).select("direction", "tot")) == [("INC", 0), ("OUT", 0)]
    inc = inbound(spark, [leg(io, t, "1", f"r{t}", resp="00" if io == "O" else None) for t in ("11:56:21", "11:56:25") for io in "IO"])
    exact, bounded = (throughput(inc, calls, as_of, 210, 10, settle=s, live=s is not None) for s in (None, 60))
    assert rows(exact) == rows(bounded) and exact.where("direction = 'INC'").first()["tot"] == 2


def test_a_burst_of_one_instant_is_dealt_over_files(spark):
    path = work_dir(spark, "burst")
    burst = spark.range(40_000).select(F.lit(date(2024, 3, 5)).alias("trx_dt"), F.lit(str(at("10:00:00"))).cast("timestamp").alias("event_ts"),
                                       F.md5(F.col("id").cast("string").cast("binary")).alias("log_data"))
    with settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        sinks.write_log(burst, path)
    written = spark.read.parquet(path)
    assert written.count() == 40_000 and max(r["count"] for r in written.groupBy(F.input_file_name()).count().collect()) < 20_000
