"""Sources, markers and runs of the streaming jobs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyrail.schemas import literal_table
from tallyrail.session import settings, work_dir

# State is kept on disk, and what of it is in memory is bounded for all stores of an executor together.
STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}
# Of a run that ends and is not gone back in: its last versions of the state will do, and nobody asks how many rows the state holds.
REPLAY = {
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}
TURN_ROWS = 250_000  # of a replay's micro-batch, for every state partition
TURN_FILES = 8  # that a micro-batch reads at once


def read_log_stream(spark: SparkSession, path: str, schema: T.StructType,
                    files_per_trigger: int | None = None) -> DataFrame:
    """Stream a table that is one file or a folder of files; of a file's folder only that file is read."""
    path = path.rstrip("/")
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        path, _, name = path.rpartition("/")
        reader = reader.option("pathGlobFilter", re.sub(r"([\\*?\[\]{}])", r"\\\1", name))
    return reader.parquet(path)


def read_replay(spark: SparkSession, path: str, table: DataFrame, ts: str, marker: Mapping[str, Any] | None = None,
                turn_rows: int = TURN_ROWS) -> DataFrame:
    """Stream the table at `path` once, as `table` reads it; with a closing marker if its values are given.

    A table of up to `turn_rows` rows is one micro-batch. A larger one is dealt by ranges of time first and comes in time order, a range per
    micro-batch: the state holds a range and not the whole log, and no row is late.
    """
    turns = -(-table.count() // turn_rows)
    if turns > 1:
        folder = work_dir(spark, "turns")
        rows = table if marker is None else table.unionByName(marker_row(table, ts, marker))
        # One file per range: the files of a cut range would not be in time order.
        rows.repartitionByRange(turns * TURN_FILES, ts).write.option("maxRecordsPerFile", 0).parquet(folder)
        if _timed_by_name(spark, folder):
            return read_log_stream(spark, folder, table.schema, files_per_trigger=TURN_FILES)
    stream = read_log_stream(spark, path, table.schema)
    return stream if marker is None else with_closing_marker(stream, table, ts, marker)


def _timed_by_name(spark: SparkSession, folder: str) -> bool:
    """Let the times of a folder's files rise with their names, since a stream takes files by time; False if the store does not keep such times."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def parts() -> list[Any]:
        return sorted((f for f in store.listStatus(place) if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName())

    found = parts()
    first = min(f.getModificationTime() for f in found) - 1000 * len(found)
    for number, file in enumerate(found):
        store.setTimes(file.getPath(), first + 1000 * number, -1)
    times = [f.getModificationTime() for f in parts()]
    return times == sorted(set(times))


def with_closing_marker(stream: DataFrame, table: DataFrame, ts: str, values: Mapping[str, Any],
                        after: str = "1 day") -> DataFrame:
    """Add one marker row, `after` the table's last row, so that a finite replay closes all its windows.

    `values` must carry the marker through every filter before the watermarks; its other columns are NULL.
    Its own window stays open, so the marker never reaches the output.
    """
    spark = table.sparkSession
    folder = work_dir(spark, "marker")
    marker_row(table, ts, values, after).coalesce(1).write.parquet(folder)
    return stream.unionByName(spark.readStream.schema(table.schema).parquet(folder))


def marker_row(table: DataFrame, ts: str, values: Mapping[str, Any], after: str = "1 day") -> DataFrame:
    """One row `after` the table's last; for a replay in several batches it belongs in the last file."""
    last = table.agg(F.max(ts).alias(ts)).where(F.col(ts).isNotNull())
    return last.select(*[
        (F.col(ts) + F.expr(f"interval {after}")).alias(f.name) if f.name == ts
        else F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in table.schema.fields])


@contextmanager
def _state(spark: SparkSession, partitions: int | None) -> Iterator[None]:
    """While a query starts: `partitions` state partitions per operator, or what the session says, and `STATE` where the session says nothing.

    A query keeps the number and the kind of store it starts with in its checkpoint; the session's own settings are put back.
    """
    values = {key: value for key, value in STATE.items() if spark.conf.get(key, None) is None}
    if partitions:
        values["spark.sql.shuffle.partitions"] = str(partitions)
    with settings(spark, values):
        yield


def run_to_parquet(stream: DataFrame, folder: str, every: str | None = None,
                   state_partitions: int | None = None) -> StreamingQuery:
    """Append a stream's closed results to `folder/data`; progress is kept in `folder/checkpoint`.

    `state_partitions` holds for the life of the checkpoint: size it for the job's final volume.

    With `every` (such as "10 seconds") the query keeps running, else it stops at the end of the data.
    """
    with _state(stream.sparkSession, state_partitions):
        return (stream.writeStream.outputMode("append").format("parquet")
                .option("path", f"{folder}/data").option("checkpointLocation", f"{folder}/checkpoint")
                .trigger(**_trigger(every)).start())


def batch_writer(folder: str, make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Write `make(batch)` to the batch's own folder: a repeated batch overwrites itself, never adds twice."""
    def write(batch: DataFrame, batch_id: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{folder}/data/batch_id={batch_id}")

    return write


def run_batches(stream: DataFrame, folder: str, make: Callable[[DataFrame], DataFrame],
                mode: str = "append", every: str | None = None, state_partitions: int | None = None) -> StreamingQuery:
    """Run `make` on every micro-batch and keep its rows under `folder/data`."""
    return run_writer(stream, folder, batch_writer(folder, make), mode, every, state_partitions)


def run_writer(stream: DataFrame, folder: str, write: Callable[[DataFrame, int], None], mode: str = "append",
               every: str | None = None, state_partitions: int | None = None) -> StreamingQuery:
    """Give every micro-batch to `write`; progress is kept in `folder/checkpoint`."""
    with _state(stream.sparkSession, state_partitions):
        return (stream.writeStream.outputMode(mode).foreachBatch(write)
                .option("checkpointLocation", f"{folder}/checkpoint").trigger(**_trigger(every)).start())


def _trigger(every: str | None) -> dict[str, Any]:
    return {"processingTime": every} if every else {"availableNow": True}


def replay(stream: DataFrame, name: str, make: Callable[[DataFrame], DataFrame] | None = None,
           state_partitions: int | None = None) -> DataFrame:
    """Run a finite stream to its end in the shared folder and read the result as a table."""
    spark = stream.sparkSession
    folder = work_dir(spark, name)
    with settings(spark, REPLAY):
        query = (run_batches(stream, folder, make, state_partitions=state_partitions) if make
                 else run_to_parquet(stream, folder, state_partitions=state_partitions))
    query.awaitTermination()
    schema = make(literal_table(spark, [], stream.schema)).schema if make else stream.schema
    return results(spark, folder, schema)


def results(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """What a job has written so far."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/data")
