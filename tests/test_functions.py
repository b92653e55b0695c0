from decimal import Decimal

from pyspark.sql import functions as F

from tallyrail import config, schemas
from tallyrail.config import ChannelRule
from tallyrail.functions.codes import (
    binary_resp_code, decode_values, effective_resp_code, in_channels, is_error, is_service_error)
from tallyrail.functions.rates import floor_pct, round_pct
from tallyrail.functions.text import amount_text, category_code, field, has_keywords
from tallyrail.functions.timeaxis import slot_label, slot_start


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'long' if isinstance(x, int) else 'string'}" for k, x in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_effective_code(spark):
    cases = [("00", None, "00"), ("00", "ok [68]", "68"), ("00", "host ok", "93"), (None, "x", "93"),
             (None, None, "93"), ("05", "ok [68]", "05"), ("00", "[6]", "93"), ("00", "a [00] [51]", "00")]
    for code, text, expected in cases:
        assert one(spark, effective_resp_code(), resp_cd=code, resp_val=text) == expected


def test_missing_response_is_an_error_of_the_service(spark):
    for code, error, service in [(None, True, True), ("00", False, False), ("51", True, False),
                                 ("05", True, True)]:
        assert one(spark, is_error(), resp_cd=code) is error
        assert one(spark, is_service_error(), resp_cd=code) is service


def test_binary_and_decode(spark):
    assert [one(spark, binary_resp_code(), resp_cd=c) for c in ("00", "51", None)] == ["00", "05", "05"]
    label = decode_values("onoff", config.AUTH_LABELS, missing=config.AUTH_MISSING)
    assert [one(spark, label, onoff=c) for c in ("05", "09", None)] == ["Success 3DS", "09", "OFFLINE"]


def test_rates(spark):
    part, whole = F.col("a"), F.col("b")
    assert one(spark, floor_pct(part, whole), a=2, b=3) == 66
    assert one(spark, floor_pct(part, whole), a=-1, b=3) == -34
    assert one(spark, floor_pct(part, whole), a=29, b=100) == 29
    assert one(spark, floor_pct(part, whole), a=1, b=0) is None
    assert one(spark, floor_pct(part, whole), a=9 * 10**17 - 1, b=9 * 10**17) == 99
    assert one(spark, round_pct(part, whole), a=9 * 10**17, b=9 * 10**17) == 100
    assert one(spark, round_pct(part, whole), a=1, b=8) == 13
    assert one(spark, round_pct(part, whole), a=0, b=0) is None


def test_fields_past_the_end_are_null(spark):
    assert one(spark, field("p", 3, 2), p="abcdef") == "cd"
    assert one(spark, field("p", 5, 4), p="abcdef") == "ef"
    assert one(spark, field("p", 7, 2), p="abcdef") is None


def test_keywords(spark):
    for words, like, expected in [(["ab", "50%"], False, True), (["a_c"], False, False), (["a_c"], True, True),
                                  (["", ""], False, True), (["zz"], False, False)]:
        assert one(spark, has_keywords("p", words, like), p="abc 50% off") is expected
    assert one(spark, has_keywords("p", [""]), p=None) is False


def test_category_code(spark):
    for raw, code in [(" 5712", "5712"), ("763", "0763"), (" 0763", "0763"), ("AIRLINE", "AIRLINE")]:
        assert one(spark, category_code("c"), c=raw) == code


def test_amount_text(spark):
    df = spark.createDataFrame([(Decimal("1234567.50"),)], "a decimal(18,2)")
    assert df.select(amount_text("a")).first()[0] == "1,234,567.50"


def test_slots_and_midnight(spark):
    df = spark.createDataFrame([("2024-03-05 23:59:59.999",), ("2024-03-06 00:00:00",)], "t string")
    got = df.select(slot_start(F.to_timestamp("t"), 5).alias("s")).select(
        slot_label("s"), slot_label("s", True), F.to_date("s").cast("string")).collect()
    assert [tuple(r) for r in got] == [("23:55", "23:55:00", "2024-03-05"), ("00:00", "00:00:00", "2024-03-06")]


def test_channel_rules(spark):
    rules = [ChannelRule("A", only_trx=("t1",)), ChannelRule("B", exclude_trx=("t1",), exclude_bsns=("ODS",)),
             ChannelRule("C")]
    data = [("A", "t1", "x"), ("A", "t2", "x"), ("A", None, "x"), ("B", "t1", "x"), ("B", "t2", "x"),
            ("B", None, "x"), ("B", "t2", "ODS"), ("B", "t2", None), ("C", None, None), ("D", "t1", "x")]
    df = spark.createDataFrame(data, "switch_id string, trx_cd string, bsns_cd string")
    kept = {tuple(r) for r in df.where(in_channels(rules)).collect()}
    assert kept == {("A", "t1", "x"), ("B", "t2", "x"), ("C", None, None)}


def test_normalisation(spark):
    df = spark.createDataFrame([("  ", "a")], "x string, y string")
    assert tuple(schemas.blanks_to_null(df, ["x", "y"]).first()) == (None, "a")
    times = spark.sql("select date'2024-03-05' as d, '23:59:58' as t union all select date'2024-03-05', 'bad'")
    got = [r["ts"] for r in schemas.with_timestamp(times, "ts", "d", "t").collect()]
    assert str(got[0]) == "2024-03-05 23:59:58" and got[1] is None


def test_required_columns(spark):
    df = spark.range(1)
    assert schemas.require_columns(df, ["id"]) is df
    try:
        schemas.require_columns(df, ["id", "no"])
    except ValueError as error:
        assert "no" in str(error)
    else:
        raise AssertionError("a missing column must be reported")


def test_literal_table(spark):
    table = schemas.literal_table(spark, [("A", None, 1)], schemas.CHANNEL_RANK)
    assert table.schema.fieldNames() == ["switch_id", "bsns_cd", "rank"]
    assert tuple(table.first()) == ("A", None, 1)
    assert schemas.literal_table(spark, [], schemas.CHANNEL_RANK).count() == 0
