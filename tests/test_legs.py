import itertools
import random

from pyspark.sql import functions as F

from tables import inbound, leg, outbound, call, rows
from tallyrail.operators.legs import (
    KEYS_3, KEYS_4, KEYS_5, approval_measures, error_measures, pair_counts, pair_sums, pair_sums_by_key,
    requests, responses, unanswered_requests, unified_activity)


def brute_pairs(data, keys):
    names = ["trx_dt", "event_ts", "reg_ts", "switch_id", "bsns_cd", "io_cd", "trx_cd", "svc_cd", "resp_cd",
             "trc_ad_no", "ret_ref_no", "log_data"]
    legs = [dict(zip(names, r)) for r in data]
    asked = [x for x in legs if x["io_cd"] == "I"]
    answered = [x for x in legs if x["io_cd"] == "O"]
    return [(a, b) for a, b in itertools.product(asked, answered)
            if all(a[k] is not None and a[k] == b[k] for k in keys)]


def sample(n=300, hot=True):
    rng = random.Random(5)
    data = []
    for _ in range(n):
        trace = "000001" if hot and rng.random() < 0.4 else f"{rng.randrange(30):06d}"
        data.append(leg(
            rng.choice("IO"), f"{rng.randrange(24):02d}:{rng.randrange(60):02d}:00",
            rng.choice([trace, trace, trace, None]), rng.choice(["r1", "r2"]), rng.choice(["ATMD", "GIBI"]),
            rng.choice(["PBK", "MBK", "ODS", None]), rng.choice(["NPAYMNT", "NINQURY"]),
            rng.choice(["00", "00", "51", "05", None])))
    return data


def test_pair_counts_equal_the_plain_self_join(spark):
    data = sample()
    log = inbound(spark, data).cache()
    for keys in (KEYS_3, KEYS_4, KEYS_5):
        expected = {}
        for a, b in brute_pairs(data, keys):
            group = (a["switch_id"], a["trx_cd"], b["resp_cd"])
            expected[group] = expected.get(group, 0) + 1
        got = pair_counts(requests(log), responses(log), keys, ["switch_id", "trx_cd"])
        assert {tuple(r)[:3]: r["n"] for r in got.collect()} == expected


def test_one_pass_sums_equal_the_joined_sums(spark):
    log = inbound(spark, sample()).cache()
    asked, answered = F.col("trx_cd") != "NINQURY", ~F.col("resp_cd").isin("05")
    for by in (["trx_dt", "switch_id", "bsns_cd"], ["switch_id"], []):
        joined = pair_sums(requests(log).where(asked), responses(log).where(answered), KEYS_5, by,
                           error_measures())
        one_pass = pair_sums_by_key(log, KEYS_5, by, error_measures(), asked, answered)
        assert rows(one_pass, *by, "volume", "errors", "service_errors") == rows(
            joined, *by, "volume", "errors", "service_errors")
    assert pair_sums_by_key(log, KEYS_5, ["switch_id"], error_measures()).count() == 2


def test_global_sums_of_an_empty_log_are_one_row_of_zeros(spark):
    log = inbound(spark, [])
    assert rows(pair_sums(requests(log), responses(log), KEYS_5, [], approval_measures())) == [(0, 0)]


def test_repeated_trace_number_fans_out_on_three_keys_only(spark):
    log = inbound(spark, [
        leg("I", "10:00:00", "1", "a"), leg("I", "10:00:01", "1", "b"),
        leg("O", "10:00:02", "1", "a", resp="00"), leg("O", "10:00:03", "1", "b", resp="51")])
    on3 = pair_sums(requests(log), responses(log), KEYS_3, [], approval_measures())
    on4 = pair_sums(requests(log), responses(log), KEYS_4, [], approval_measures())
    assert rows(on3) == [(2, 4)]
    assert rows(on4) == [(1, 2)]


def test_unanswered_requests(spark):
    log = inbound(spark, [
        leg("I", "10:00:00", "1"), leg("O", "10:00:02", "1", resp=None),
        leg("I", "10:01:00", "2"), leg("I", "10:01:30", "2"), leg("O", "10:01:31", "2", "other", resp="00"),
        leg("O", "10:02:00", "3", resp="00")])
    got = unanswered_requests(requests(log), responses(log))
    assert rows(got, "trc_ad_no", "trx_cd", "n_requests") == [("2", "NPAYMNT", 2)]


def test_unified_activity_has_one_shape(spark):
    log = inbound(spark, [leg("I", "10:00:00", "1"), leg("O", "10:00:01", "1", resp="00")])
    calls = outbound(spark, [call("11:00:00", "FINN", resp="05")])
    got = unified_activity(log, calls)
    assert rows(got, "direction", "switch_id", "bsns_cd", "resp_cd") == [
        ("INC", "ATMD", "EB1", None), ("OUT", "FINN", "EB1", "05")]


def test_a_hot_key_costs_its_counts_not_its_pairs(spark):
    """A third of all rows under one key: 400 million pairs, counted without making them."""
    hot = spark.range(60_000).select(
        F.lit("2024-03-05").cast("date").alias("trx_dt"), F.lit("ATMD").alias("switch_id"),
        F.when(F.col("id") < 40_000, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("trc_ad_no"),
        F.lit("NPAYMNT").alias("trx_cd"), F.when(F.col("id") % 2 == 0, "I").otherwise("O").alias("io_cd"),
        F.when(F.col("id") % 4 == 1, "00").otherwise("05").alias("resp_cd"))
    got = pair_counts(requests(hot), responses(hot), KEYS_3, ["switch_id", "trx_cd"])
    assert rows(got, "resp_cd", "n") == [("00", 20_000 * 10_000), ("05", 20_000 * 10_000)]
