"""Hand-made log rows."""

from datetime import date, datetime

from tallyrail import schemas

DAY = date(2024, 3, 5)  # a Tuesday


def at(text):
    return datetime.fromisoformat(f"2024-03-05 {text}")


def leg(io, time, trace, ref="r1", switch="ATMD", bsns="EB1", trx="NPAYMNT", resp=None, payload="", day=DAY):
    when = time if isinstance(time, datetime) else at(time)
    return (day, when, when, switch, bsns, io, trx, None, resp, trace, ref, payload)


def call(time, switch, trx="OPAY", resp="00", val=None, out="", request="", trace="t", ref="r"):
    return (DAY, at(time), at(time), switch, None, trx, resp, val, trace, ref, request, out)


def inbound(spark, rows):
    return spark.createDataFrame(rows, schemas.INBOUND_LOG)


def outbound(spark, rows):
    return spark.createDataFrame(rows, schemas.OUTBOUND_LOG)


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
