"""Request/response pairing on streams.

Both legs are first collapsed per correlation key and second (the logs' own time resolution), so the state
of a busy key grows with the seconds kept, not with its messages, and no message pairs are produced.
A response answers a request if it comes in the same second or up to `settle` seconds later.

A reference number names one transaction, so with it a key holds few seconds and they are joined one by one. Keys without it come again all
day; joined so, each of a key's requests would meet every response of its day. There the seconds of responses are gathered by short spans, the join's
equality takes the span as well, and a request meets only the spans that its settle time reaches: the work grows with the log, not with its square.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrail.operators.legs import KEYS_4, approval_measures, counted

REFERENCE = "ret_ref_no"
MEASURES = ("approve", "tot")  # of approval_measures
SPANS = 2  # of responses in a settle time; fewer are less work, and hold results back longer


def _per_second(legs: DataFrame, keys: Sequence[str], by: Sequence[str], measures: dict[str, Column],
                delay: str, ts: str, prefix: str) -> DataFrame:
    per_second = (legs.withWatermark(ts, delay)
                  .groupBy(F.window(ts, "1 second").alias("_second"), *keys, *by)
                  .agg(*counted(measures)))
    return per_second.select(F.window_time("_second").alias(f"{prefix}_ts"),
                             *[F.col(k).alias(f"{prefix}_{k}") for k in keys], *by, *measures)


def _by_span(answered: DataFrame, keys: Sequence[str], width: int, spans: int) -> DataFrame:
    """The seconds of responses per key and span of `width` seconds, for the requests of this span and of the `spans` before it."""
    gathered = answered.groupBy(F.window("r_ts", f"{width} seconds").alias("_span"), *[f"r_{k}" for k in keys]).agg(
        F.collect_list(F.struct("r_ts", *MEASURES)).alias("_answers"))
    number = _span_no(F.col("_span.start"), width)
    # A span's time is its end, as a second's is.
    return gathered.select(F.window_time("_span").alias("r_ts"), *[f"r_{k}" for k in keys], "_answers",
                           F.explode(F.sequence(number - spans, number)).alias("r_span"))


def _span_no(ts: Column, width: int) -> Column:
    seconds = F.unix_seconds(ts)
    return ((seconds - F.pmod(seconds, F.lit(width))) / width).cast("bigint")


def _sides(request_legs: DataFrame, response_legs: DataFrame, keys: Sequence[str], by: Sequence[str],
           delay: str, settle: int, ts: str) -> tuple[DataFrame, DataFrame, Column, bool]:
    """Both legs, the condition to join them on, and whether the responses are gathered by spans (`_answers`)."""
    asked = _per_second(request_legs, keys, by, {"n_requests": F.lit(True)}, delay, ts, "q")
    answered = _per_second(response_legs, keys, (), approval_measures(), delay, ts, "r")
    settle = int(settle)
    reach, gathered = settle, REFERENCE not in keys
    if gathered:
        width = max(-(-settle // SPANS), 1)
        answered = _by_span(answered, keys, width, SPANS)
        asked = asked.withColumn("q_span", _span_no(F.col("q_ts"), width))
        reach = (SPANS + 1) * width  # true of every span that the equality finds; the watermark needs it
    on = F.expr(f"r_ts >= q_ts and r_ts <= q_ts + interval {reach} seconds")
    for k in [*keys, "span"] if gathered else keys:
        on = on & (F.col(f"q_{k}") == F.col(f"r_{k}"))
    return asked, answered, on, gathered


def _in_time(answer: Column, settle: int) -> Column:
    return (answer["r_ts"] >= F.col("q_ts")) & (answer["r_ts"] <= F.col("q_ts") + F.expr(f"interval {int(settle)} seconds"))


def pair_stream(request_legs: DataFrame, response_legs: DataFrame, keys: Sequence[str] = KEYS_4,
                by: Sequence[str] = (), delay: str = "210 seconds", settle: int = 210,
                ts: str = "event_ts") -> DataFrame:
    """Per key and request second: `tot` request/response pairs and how many were approved.

    A second's pairs are in several rows if its responses come in several seconds (keys with a reference number) or spans.
    """
    asked, answered, on, gathered = _sides(request_legs, response_legs, keys, by, delay, settle, ts)
    paired = asked.join(answered, on)
    if gathered:
        none = F.struct(*[F.lit(0).cast("bigint").alias(m) for m in MEASURES])
        paired = paired.withColumn("_sums", F.aggregate("_answers", none, lambda sums, answer: F.when(
            _in_time(answer, settle), F.struct(*[(sums[m] + answer[m]).alias(m) for m in MEASURES])).otherwise(sums)))
        paired = paired.select("*", "_sums.*").where("tot > 0")
    n = F.col("n_requests")
    return paired.select(
        F.col("q_ts").alias("request_ts"), *[F.col(f"q_{k}").alias(k) for k in keys], *by,
        (n * F.col("approve")).alias("approve"), (n * F.col("tot")).alias("tot"))


def unanswered_stream(request_legs: DataFrame, response_legs: DataFrame, keys: Sequence[str] = KEYS_4,
                      by: Sequence[str] = (), delay: str = "210 seconds", settle: int = 210,
                      ts: str = "event_ts") -> DataFrame:
    """Requests without a response within `settle` seconds, emitted once the watermark has passed them."""
    asked, answered, on, gathered = _sides(request_legs, response_legs, keys, by, delay, settle, ts)
    if gathered:
        on = on & F.exists("_answers", lambda answer: _in_time(answer, settle))
    missing = asked.join(answered, on, "left_outer").where(F.col(f"r_{keys[0]}").isNull())
    return missing.select(F.col("q_ts").alias("request_ts"),
                          *[F.col(f"q_{k}").alias(k) for k in keys], *by, "n_requests")
