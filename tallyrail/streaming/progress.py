"""What every micro-batch did, kept beside a job's results: rows read, rows that came too late, and the watermark.

Spark drops a row whose window the watermark has closed, and says so only in the progress of the batch. `keep_progress` writes that progress
down, an entry per batch and stateful operator. An aggregation combines rows before it looks at the watermark, so its number is of
combined rows (one per key, window and task); `late_rows` counts the log's own rows by the same rule.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tallyrail.schemas import literal_table
from tallyrail.streaming import jobs

PROGRESS = T.StructType([
    T.StructField("batch_id", T.LongType()), T.StructField("operator_no", T.IntegerType()), T.StructField("operator", T.StringType()),
    T.StructField("rows_read", T.LongType()), T.StructField("rows_dropped", T.LongType()), T.StructField("rows_updated", T.LongType()),
    T.StructField("state_rows", T.LongType()), T.StructField("watermark", T.StringType())])


class _Keeper(StreamingQueryListener):
    def __init__(self, spark: SparkSession, query: StreamingQuery, folder: str):
        self.spark, self.id, self.folder = spark, str(query.id), folder

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if str(event.progress.id) == self.id:
            write_progress(self.spark, self.folder, json.loads(event.progress.json))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def write_progress(spark: SparkSession, folder: str, progress: dict) -> None:
    """One file per batch, written over if the batch is repeated."""
    rows = [{"batch_id": progress["batchId"], "operator_no": i, "operator": op["operatorName"], "rows_read": progress["numInputRows"],
             "rows_dropped": op.get("numRowsDroppedByWatermark", 0), "rows_updated": op.get("numRowsUpdated", 0),
             "state_rows": op.get("numRowsTotal", 0), "watermark": progress.get("eventTime", {}).get("watermark")}
            for i, op in enumerate(progress.get("stateOperators", []))]
    if not progress["numInputRows"] and not any(r["rows_dropped"] or r["rows_updated"] for r in rows):
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/progress/{progress['batchId']}.json")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray("".join(json.dumps(r) + "\n" for r in rows), "utf-8"))
    finally:
        out.close()


def keep_progress(query: StreamingQuery, folder: str) -> StreamingQueryListener:
    """Write the progress of a running query's batches under `folder`, until the listener is removed."""
    spark = query._spark if hasattr(query, "_spark") else SparkSession.active()
    listener = _Keeper(spark, query, folder)
    spark.streams.addListener(listener)
    for progress in query.recentProgress:  # batches that were over before the listener was there
        write_progress(spark, folder, json.loads(progress.json))
    return listener


def finish(query: StreamingQuery, listener: StreamingQueryListener, folder: str) -> None:
    """Wait for a query's end and for what is still to be written of its progress."""
    query.awaitTermination()
    spark = SparkSession.active()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.streams.removeListener(listener)
    for progress in query.recentProgress:
        write_progress(spark, folder, json.loads(progress.json))


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """The kept progress of all batches."""
    return spark.read.schema(PROGRESS).json(f"{folder}/progress")


LATE = T.StructType([T.StructField("watermark", T.TimestampType()), T.StructField("latest", T.TimestampType()), T.StructField("n_rows", T.LongType()),
                     T.StructField("n_late", T.LongType())])


def run_late_rows(stream: DataFrame, folder: str, width: str, delay: str = "210 seconds", ts: str = "event_ts", by: Sequence[str] = (),
                  every: str | None = None) -> StreamingQuery:
    """Count, per micro-batch, the log rows whose window of `width` is closed when they come; kept in `folder/late`.

    The rule is the windowed job's own: the watermark of a batch is the latest time of the batches before it less `delay`, and a row is
    late if its window ends at or before it. With `by`, late rows are also counted by those columns, in `folder/late_by`.
    """
    spark = stream.sparkSession
    literal_table(spark, [], LATE).write.mode("ignore").parquet(f"{folder}/late/batch_id=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        before = late_batches(session, folder).where(F.col("batch_id") < batch_id).agg(F.max("latest")).first()[0]
        mark = F.lit(None).cast("timestamp") if before is None else F.lit(before) - F.expr(f"interval {delay}")
        marked = batch.withColumn("_late", F.coalesce(F.window(ts, width)["end"] <= mark, F.lit(False)))
        found = marked.agg(F.max(ts).alias("latest"), F.count("*").alias("n_rows"), F.count_if("_late").alias("n_late")).select(
            mark.alias("watermark"), F.greatest("latest", F.lit(before).cast("timestamp")).alias("latest"), "n_rows", "n_late")
        if by:
            marked.where("_late").groupBy(*by).agg(F.count("*").alias("n_late")).write.mode("overwrite").parquet(f"{folder}/late_by/batch_id={batch_id}")
        found.write.mode("overwrite").parquet(f"{folder}/late/batch_id={batch_id}")

    return jobs.run_writer(stream, folder, write, "append", every)


def late_batches(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(T.StructType([*LATE.fields, T.StructField("batch_id", T.LongType())])).parquet(f"{folder}/late")
