"""What several operators share: tables, written intermediates and column helpers."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrail.session import work_dir

SHIPPED = "tallyrail-code"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# White space and word characters of the contracts, as Java regular expressions.
SPACES = r"[ \t-\r]+"
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that `stored` has written and nothing has removed yet.
_FOLDERS: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the cluster's shared folder and read again: cuts lineage, survives lost executors.

    The folder stays, since results read it lazily; `discard` removes one, `clean` all of them once a run's results are written.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    _FOLDERS.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    _FOLDERS.remove(path)


def discard(df: DataFrame) -> None:
    """Remove the folder of a table that `stored` returned; nothing may read it any more."""
    _remove(df.sparkSession, df.stored_at)


def clean(spark: SparkSession) -> None:
    """Remove every folder that `stored` has written in this process: once all results that read them are written."""
    for path in list(_FOLDERS):
        _remove(spark, path)


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, wherever the driver imported it from; once per Spark context."""
    context = spark.sparkContext
    if any(os.path.basename(f).startswith(SHIPPED) for f in context.listFiles):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # A file of the driver's, which serves it to all executors.
    name = os.path.join(tempfile.mkdtemp(prefix=f"{SHIPPED}-"), SHIPPED)
    context.addPyFile(shutil.make_archive(name, "zip", os.path.dirname(package), os.path.basename(package)))


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Before work in Python: bound what a worker holds of long texts at once, and see that it has the code."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often `body` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed."""
    return F.translate(text, UPPER, UPPER.lower())


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id's decimal text modulo `parts`; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


#: A table is broadcast only if it was written first and holds no more than this many rows and text characters.
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 8 << 20


def sized(df: DataFrame, name: str) -> DataFrame:
    """`df` written out, and marked for broadcast if its counted size allows; otherwise joins shuffle as usual."""
    kept = stored(df, name)
    texts = [F.coalesce(F.length(F.col(f.name).cast("string")), F.lit(0)) for f in kept.schema.fields]
    total = texts[0]
    for more in texts[1:]:
        total = total + more
    rows, chars = kept.agg(F.count("*"), F.coalesce(F.sum(total), F.lit(0))).first()
    return F.broadcast(kept) if rows <= BROADCAST_ROWS and chars <= BROADCAST_CHARS else kept


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of undirected `edges`; root is the smallest node it can reach.

    Each round takes the smallest root among a node and its neighbours and then the root's own root, so a chain shrinks by
    half or more; every round is written to the shared folder.
    """
    ends = edges.select(F.col(a).alias("node"), F.col(b).alias("to"))
    both = stored(ends.union(ends.select(F.col("to").alias("node"), F.col("node").alias("to"))).distinct(), "edges")
    labels = stored(both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("to"), F.col("root").alias("via")), "to").groupBy("node").agg(
            F.min("via").alias("via"))
        step = labels.join(near, "node").select("node", F.col("root").alias("before"), F.least("root", "via").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        step = stored(step.join(up, "root").select("node", "before", F.least("root", "top").alias("root")), "labels")
        labels = step.select("node", "root")
        if step.filter("before <> root").isEmpty():
            return labels
