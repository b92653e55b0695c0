"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULTS = {
    # The Python call site of every column is only for error messages and costs the driver time.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "tallyrail", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings for the jobs that run inside; what held before is put back."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for `name` under the cluster's shared checkpoint folder.

    A machine-local folder is used only in local mode, where driver and executors share the machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/tallyrail/{name}-{uuid.uuid4().hex}"
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return os.path.join(tempfile.mkdtemp(prefix="tallyrail-"), name)


def size_shuffles(spark: SparkSession, shuffled_bytes: int, target_bytes: int = 128 * 1024 * 1024) -> int:
    """Set enough shuffle partitions for the expected shuffle volume; AQE merges the ones that stay small.

    AQE splits skewed join partitions but never adds partitions to an aggregation, so a big log needs
    the number set up front: 10 TB of keys and counts at 128 MB are about 80,000 partitions.
    """
    partitions = max(spark.sparkContext.defaultParallelism, -(-shuffled_bytes // target_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_bytes))
    return partitions
