import json
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from tables import at, inbound, leg, outbound, rows
from tallyrail.operators.dims import broadcast_if_small
from tallyrail.plans import billpay, channels, dashboards
from tallyrail.session import size_shuffles, work_dir
from tallyrail import schemas
from tallyrail.sources import ingest, readers, sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ingest_makes_logical_rows(spark):
    raw = spark.sql("""select date'2024-03-05' as D, '23:59:59' as TRX_TM, 'ATMD' as SWITCH_ID, '  ' as RESP_CD,
                              ' x ' as O_LOG_DATA, 12 as TRC_AD_NO""")
    schema = schemas.OUTBOUND_LOG
    wanted = type(schema)([schema[c] for c in ("trx_dt", "event_ts", "switch_id", "resp_cd", "trc_ad_no", "o_log_data")])
    got = ingest.to_table(raw, wanted, {"event_ts": ("trx_dt", "trx_tm")}, {"D": "trx_dt"}).first()
    assert (str(got["event_ts"]), got["resp_cd"], got["trc_ad_no"], got["o_log_data"]) == (
        "2024-03-05 23:59:59", None, "12", " x ")
    with pytest.raises(ValueError):
        ingest.to_table(raw, schema, ingest.LOG_TIMES)


def test_json_rows_keep_types_and_nulls(spark):
    path = work_dir(spark, "rows")
    df = spark.createDataFrame([("a", 1, None), (None, 2, 1.5)], "x string, y long, z double")
    sinks.write_json_rows(df, path)
    lines = sorted(r["value"] for r in spark.read.text(f"{path}/rows").collect())
    assert [json.loads(line) for line in lines] == [["a", 1, None], [None, 2, 1.5]]
    assert [r["name"] for r in spark.read.json(f"{path}/metaData").collect()] == ["x", "y", "z"]


def test_json_objects_and_csv(spark):
    path = work_dir(spark, "objects")
    df = spark.createDataFrame([("a", 1234.5), ("b", None)], "x string, y double")
    sinks.write_json_objects(df, path, {"x": "name", "y": "value"}, amounts=["y"])
    lines = sorted(r["value"] for r in spark.read.text(path).collect())
    assert [json.loads(line) for line in lines] == [
        {"name": "a", "value": "1,234.50"}, {"name": "b", "value": None}]
    path = work_dir(spark, "csv")
    sinks.write_csv(spark.createDataFrame([(10, 90, 95)], "volume long, cae long, sar long"), path)
    assert [r["value"] for r in spark.read.text(path).collect()] == ["10,90,95"]


def test_jdbc_options_come_from_the_caller():
    settings = {"url": "jdbc:x:y", "user": "u", "password": "p"}
    options = readers.jdbc_options(settings, "log", "trx_dt", "2024-01-01", "2024-02-01", 31)
    assert options["partitionColumn"] == "trx_dt" and options["numPartitions"] == "31"
    with pytest.raises(ValueError):
        readers.jdbc_options({"url": "jdbc:x:y"}, "log")
    with pytest.raises(ValueError):
        readers.jdbc_options(settings, "log", "trx_dt")


@pytest.fixture(scope="module")
def stored(spark):
    path = work_dir(spark, "log")
    data = []
    for d in range(1, 6):
        for i in range(20):
            when = at("10:00:00").replace(day=d, minute=i)
            data.append(leg("I", when, str(i), day=date(2024, 3, d)))
            data.append(leg("O", when, str(i), resp="00", day=date(2024, 3, d)))
    sinks.write_log(inbound(spark, data), path, ("trx_dt", "io_cd"))
    return readers.read_parquet(spark, path)


def test_day_reports_prune_partitions_and_push_filters(spark, stored):
    today = readers.scan_day(stored, at("12:00:00"))
    report = channels.two_rate_summary(today, outbound(spark, []))
    text = plan(report)
    assert "PartitionFilters: [isnotnull(trx_dt" in text and "2024-03-05" in text
    assert "log_data" not in text.split("ReadSchema:")[1].split("\n")[0]
    assert rows(report, "switch_id", "volume", "cae") == [("ATMD", 20, 100)]


def test_channel_summary_reads_the_log_once_without_a_join(spark, stored):
    report = channels.two_rate_summary(stored, outbound(spark, []))
    text = plan(report)
    assert text.count("FileScan parquet") == 1
    assert "Join" not in text
    assert re.search(r"PushedFilters: \[[^\n]*In\(switch_id", text)


def test_catalog_report_reads_each_leg_once(spark, stored):
    codes = schemas.literal_table(spark, [("INTER_ID", "NPAYMNT", None, None, None, "ATMD")], schemas.CATALOG)
    report = channels.catalog_two_rate(channels.catalog_counts(
        stored, outbound(spark, []), codes, (), {}, request_coded={"ATMD": ("OTHER",)}, strict_channels=("ATMD",),
        days=(date(2024, 3, 1), date(2024, 3, 5))))
    scans = [line for line in plan(report).split("\n") if "FileScan parquet" in line]
    assert 2 <= len(scans) <= 3 and all("PartitionFilters" in s and "io_cd" in s for s in scans)  # one may only prune days
    assert report.agg(F.sum("volume"), F.count("*")).first() == (100, 5)


def test_rejected_times_are_counted(spark):
    raw = spark.createDataFrame([(date(2024, 3, 5), "10:00:00", "x"), (date(2024, 3, 5), "24:99:00", "11:00:00"),
                                 (date(2024, 3, 6), None, "")], "TRX_DT date, TRX_TM string, REG_TM string")
    got = ingest.rejected_times(raw, ingest.LOG_TIMES)
    assert rows(got, "trx_dt", "event_ts", "reg_ts") == [(date(2024, 3, 5), 1, 1), (date(2024, 3, 6), 1, 1)]


def test_live_slots_prune_days_on_both_legs(spark, stored):
    facts = dashboards.inbound_slots(stored, as_of=at("10:30:00"))
    facts.collect()
    text = plan(facts)
    scans = [line for line in text.split("\n") if "FileScan parquet" in line]
    assert scans and all("PartitionFilters" in s and "2024-03-04" in s for s in scans)
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    # The few requests' keys narrow the responses before they are counted.
    assert "LeftSemi, BuildRight" in text
    assert facts.agg(F.sum("tot")).first()[0] == 20


def test_broadcast_needs_a_count(spark):
    small, large = spark.range(5), spark.range(50)
    base = spark.range(100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(base.join(broadcast_if_small(small, 10), "id"))
        assert "BroadcastHashJoin" not in plan(base.join(broadcast_if_small(large, 10), "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hot_key_of_distinct_payloads_is_split_over_tasks(spark):
    rows_ = spark.range(300_000).select(
        F.lit("2024-03-05").cast("date").alias("trx_dt"), F.lit("VADP").alias("switch_id"),
        F.lit("EB1").alias("bsns_cd"), F.lit("NBLLPAY").alias("trx_cd"), F.lit("r").alias("ret_ref_no"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 997).cast("string")).alias("trc_ad_no"),
        F.when(F.col("id") % 2 == 0, "I").otherwise("O").alias("io_cd"),
        F.when(F.col("id") % 4 == 1, "00").otherwise("05").alias("resp_cd"),
        F.concat(F.repeat(F.lit("."), 85), F.lit("P0001"), F.col("id").cast("string")).alias("log_data"))
    products = schemas.literal_table(
        spark, [("PART_CENT_ID", None, "P0001", None, "Water", None)], schemas.CATALOG)
    settings = {
        "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        counts = billpay.payload_counts(rows_.repartition(16), products)
        found = {r["resp_cd"]: r["n"] for r in counts.collect()}
        assert "skew=true" in plan(counts)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert found["05"] == found["00"] == 150_000


def test_shuffles_are_sized_by_volume(spark):
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        assert size_shuffles(spark, 10 * 1024 ** 4) == 81_920
        assert spark.conf.get(keys[0]) == "81920"
        assert size_shuffles(spark, 1) == spark.sparkContext.defaultParallelism
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
