"""Centroid clustering with an incremental distance matrix.

Vectors are turned into integers, so that all arithmetic is exact and no result depends on how rows are dealt. Every vector keeps its dot
products with all centroids. When centroids move, only the components that changed take part: the product with centroid j grows by
the vector's components times the change of j's, for its nonzero changes alone. The squared distance is |v|^2 - 2 v.c + |c|^2, and the
nearest centroid is found again by argmin; ties go to the smaller number.

The matrix (a row per vector: its components, dot products, cluster and distance) is written to the shared folder each round and read for the
next, so a lost executor costs one round at most; the round before the last is removed, so two are on disk at once. A round is one pass
without a shuffle and one aggregation of a row per cluster and task. Only centroids and their sums come to the driver: `k` rows.

Defined results: vectors that are null, of another length, or with a null or non-finite component are left out. A row without an id is
clustered, but is never an initial centroid. Repeated rows are clustered each, and may be initial centroids each; equal hashes are ordered by
their components. Fewer vectors than `k` give as many centroids; an empty table gives an empty result. A component beyond 2**26 after
scaling would not keep distances within 64 bits and raises an error. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrail.llm.common import discard, ship_package, stored

SIZE, SCALE, K, ROUNDS, SEED = 64, 256, 40, 5, 2
LARGEST = 1 << 26
#: Vectors whose products are updated at once.
STEP = 4096


def integer_vectors(rows: DataFrame, size: int = SIZE, scale: int = SCALE, vec_id: str = "vec_id",
                    vector: str = "embedding") -> DataFrame:
    """(vec_id, vector): the usable vectors with components floor(scale * x)."""
    raw = rows.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("raw"))
    finite = F.forall("raw", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is greater than all numbers
    # The guard on a large component is an expression of its own, so that it fails with a message and not with an overflow.
    whole = F.transform("raw", lambda x: F.when(F.abs(x) * scale < LARGEST, F.floor(x * scale)).otherwise(
        F.raise_error(F.lit(f"a vector component times {scale} exceeds {LARGEST}")).cast("bigint")).cast("int"))
    return raw.filter((F.size("raw") == size) & finite).select("vec_id", whole.alias("vector"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The `k` vectors with the smallest hash of their ids, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.filter("vec_id IS NOT NULL").select(key.alias("hash"), "vector").orderBy("hash", "vector").limit(k).collect()
    return np.array([r.vector for r in rows], np.int64)


def _flat(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(range(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.ravel(), kind))


def updated(vectors: np.ndarray, dots: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Dot products with the centroids `after`, from those with `before`: only changed components are multiplied."""
    dots = dots.copy()
    change = after - before
    for j in np.flatnonzero(change.any(axis=1)):
        moved = np.flatnonzero(change[j])
        dots[:, j] += vectors[:, moved] @ change[j, moved]
    return dots


def assigned(rows: DataFrame, before: np.ndarray, after: np.ndarray) -> DataFrame:
    """Matrix rows whose products are brought from the centroids `before` to `after`, with `cluster` and `distance`.

    `rows` without a column `dots` has no products yet; `before` is then all zeros.
    """
    size, k = after.shape[1], len(after)
    norms = (after * after).sum(axis=1)
    fresh = "dots" not in rows.columns
    schema = T.StructType([rows.schema["vec_id"], T.StructField("vector", T.ArrayType(T.IntegerType())), T.StructField("dots", T.ArrayType(
        T.LongType())), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                vectors = _flat(batch.column("vector"), size, np.int64)
                dots = np.zeros((len(vectors), k), np.int64) if fresh else _flat(batch.column("dots"), k, np.int64)
                dots = updated(vectors, dots, before, after)
                apart = norms - 2 * dots
                cluster = apart.argmin(axis=1)  # the first of equals
                distance = apart[np.arange(len(vectors)), cluster] + (vectors * vectors).sum(axis=1)
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id"), _lists(vectors, pa.int32()), _lists(dots, pa.int64()),
                    pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=schema.names)
    ship_package(rows.sparkSession)
    return rows.select("vec_id", "vector", *([] if fresh else ["dots"])).mapInArrow(run, schema)


def moved(matrix: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every non-empty centroid becomes its vectors' componentwise floor(sum / count)."""
    sums = [F.sum(F.get("vector", F.lit(i)).cast("bigint")).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for row in matrix.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # a row per centroid
        out[row.cluster] = [row[f"s{i}"] // row.n for i in range(centroids.shape[1])]
    return out


def hash_of(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(rows: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED,
            vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per usable vector."""
    matrix = integer_vectors(rows, size, scale, vec_id, vector)
    centroids = first_centroids(matrix, k, seed)
    if not len(centroids):
        # Without any id there is no centroid and no cluster.
        nothing = matrix.limit(0)
        return nothing.select("vec_id", *(F.lit(None).cast(t).alias(n) for n, t in (
            ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string"))))
    before, old = np.zeros_like(centroids), None
    for done in range(rounds + 1):
        new = stored(assigned(matrix, before, centroids), "distance-matrix")
        if old is not None:
            discard(old)
        matrix = old = new
        if done < rounds:
            before, centroids = centroids, moved(matrix, centroids)
    totals = {r.cluster: r.total for r in matrix.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    inertia = sum(totals.values())

    def of_cluster(values: list, kind: str) -> Column:
        return F.get(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster"))
    return matrix.select("vec_id", "cluster", "distance", of_cluster([totals.get(j, 0) for j in range(len(centroids))], "bigint").alias("cluster_inertia"),
                         F.lit(inertia).cast("bigint").alias("inertia"), of_cluster([hash_of(c) for c in centroids], "string").alias("centroid_sha256"))
