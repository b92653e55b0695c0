"""Alert rules on closed stream windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyrail import config
from tallyrail.functions.rates import floor_pct
from tallyrail.functions.timeaxis import instant, slot_label
from tallyrail.operators.spine import on_spine
from tallyrail.schemas import ALERT_RULE, literal_table
from tallyrail.session import settings
from tallyrail.streaming import jobs

CLOSED = T.StructType([T.StructField("last_window", T.TimestampType())])
WINDOWS = T.StructType([T.StructField("window_start", T.TimestampType()), T.StructField("switch_id", T.StringType()),
                        T.StructField("approve", T.LongType()), T.StructField("tot", T.LongType())])
ALERTS = ["window_start", "switch_id", "approve", "tot", "rate"]


def zero_approval_rules(spark: SparkSession, channels: Sequence[str],
                        hours: tuple[str, str] = config.SLOT_HOURS) -> DataFrame:
    return literal_table(spark, [(c, *hours, 0) for c in channels], ALERT_RULE)


def window_alerts(windows: DataFrame, axis: DataFrame) -> DataFrame:
    """Windows of watched channels at or below their approval limit within the rule's hours.

    `axis` has every closed window of every rule (window_start, switch_id, since, until, max_rate). A window in which a
    watched channel has no answered request counts zero, as an empty slot of the dashboard does.
    """
    series = on_spine(axis, windows.select("window_start", "switch_id", "approve", "tot"), ["window_start", "switch_id"],
                      ["approve", "tot"])
    label, rate = slot_label("window_start"), floor_pct(F.col("approve"), F.col("tot"))
    hit = (label > F.col("since")) & (label < F.col("until")) & (F.coalesce(rate, F.lit(0)) <= F.col("max_rate"))
    return series.withColumn("rate", rate).where(hit).select(ALERTS)


def alert_writer(folder: str, rules: DataFrame, width: str) -> Callable[[DataFrame, int], None]:
    """Write each batch's alerts to the batch's own folder, and the last window that it closed beside them.

    Windows close in time order and for all channels at once, so a batch closes what lies between the last window of
    the batches before it and its own last window; a repeated batch finds the same bounds and overwrites itself.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            first, last = batch.agg(F.min("window_start"), F.max("window_start")).first()
            if last is None:
                return
            seen = spark.read.schema(T.StructType([*CLOSED.fields, T.StructField("batch_id", T.LongType())])).parquet(f"{folder}/closed")
            before = seen.where(F.col("batch_id") < batch_id).agg(F.max("last_window")).first()[0]
            step = F.expr(f"interval {width}")
            start = F.lit(before) + step if before is not None else F.lit(first)
            axis = rules.withColumn("window_start", F.explode(F.sequence(start, F.lit(last), step)))
            window_alerts(batch, axis).write.mode("overwrite").parquet(f"{folder}/data/batch_id={batch_id}")
            literal_table(spark, [(last,)], CLOSED).write.mode("overwrite").parquet(f"{folder}/closed/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return write


def run_alerts(windows: DataFrame, folder: str, rules: DataFrame, width: str, every: str | None = None,
               state_partitions: int | None = None) -> StreamingQuery:
    """Alert on a windowed stream (`window_paired` by switch_id, windows of `width`), silent channels included."""
    spark = windows.sparkSession
    literal_table(spark, [], CLOSED).write.mode("ignore").parquet(f"{folder}/closed/batch_id=-1")
    return jobs.run_writer(windows, folder, alert_writer(folder, rules, width), "append", every, state_partitions)


def watch_silence(spark: SparkSession, folder: str, rules: DataFrame, width: str, as_of: datetime, delay: str = "210 seconds",
                  since: datetime | None = None) -> None:
    """Alert on windows that the clock has closed but the stream has not, since no channel at all sends rows.

    Run it at regular polls beside `run_alerts`. A window is closed by the clock if it ended `delay` before `as_of`. The windows
    after the stream's last closed one count zero for every watched channel; before the stream has closed any, `since` says where the watch
    begins. Each poll writes its whole answer to its own folder, so a repeated poll overwrites itself.
    """
    before = spark.read.schema(CLOSED).parquet(f"{folder}/closed").agg(F.max("last_window")).first()[0]
    step = F.expr(f"interval {width}")
    if before is not None:
        start = F.lit(before) + step
    elif since is not None:
        start = F.window(instant(since), width)["start"]
    else:
        return
    last = F.window(instant(as_of) - F.expr(f"interval {delay}"), width)["start"] - step
    axis = rules.withColumn("_start", start).withColumn("_last", last).where("_start <= _last").withColumn(
        "window_start", F.explode(F.sequence("_start", "_last", step))).drop("_start", "_last")
    none = literal_table(spark, [], WINDOWS)
    moment = as_of.strftime("%Y%m%dT%H%M%S")
    window_alerts(none, axis).write.mode("overwrite").parquet(f"{folder}/clock/polled={moment}")


def alerts_so_far(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The stream's alerts, and for the windows after its last closed one those of the clock.

    Rows that arrive after all move the stream's watermark over such windows; from then on its own answer counts.
    """
    found = jobs.results(spark, folder, schema)
    closed = spark.read.schema(CLOSED).parquet(f"{folder}/closed").agg(F.max("last_window")).first()[0]
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/clock")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return found
    clock = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/clock").distinct()
    if closed is not None:
        clock = clock.where(F.col("window_start") > F.lit(closed))
    return found.unionByName(clock)


def replay_alerts(windows: DataFrame, name: str, rules: DataFrame, width: str,
                  state_partitions: int | None = None) -> DataFrame:
    """`run_alerts` over a finite stream; its alerts as a table."""
    spark = windows.sparkSession
    folder = jobs.work_dir(spark, name)
    with settings(spark, jobs.REPLAY):
        query = run_alerts(windows, folder, rules, width, state_partitions=state_partitions)
    query.awaitTermination()
    return jobs.results(spark, folder, windows.select(ALERTS).schema)
