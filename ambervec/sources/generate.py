"""Synthetic vectors. Values depend on the seed and the row's id only, so a task
that runs again makes the same rows, and any number of tasks gives the same table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "node_id long, embedding array<float>"


def _rng(seed: int, block: int, stream: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64([seed, stream, block]))


def _rows(spark: SparkSession, n: int, make, name: str = "node_id", block: int = 4096) -> DataFrame:
    """Rows 0..n-1 in blocks; ``make(block number, ids)`` gives their vectors."""
    blocks = -(-n // block)

    def run(batches):
        for b in batches:
            for k in b.column("id").to_pylist():
                ids = np.arange(k * block, min(n, (k + 1) * block))
                x = make(k, ids).astype(np.float32)
                lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids), lists], [name, "embedding"])

    return spark.range(blocks).mapInArrow(run, _SCHEMA.replace("node_id", name))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n > 0, x / np.where(n > 0, n, 1), x)


def random_vectors(spark: SparkSession, n: int, dimension: int, seed: int = 42) -> DataFrame:
    """Uniform in [-1, 1), scaled to unit length."""
    return _rows(spark, n, lambda k, ids: _unit(_rng(seed, k, 1).uniform(-1, 1, (len(ids), dimension))))


def clustered_vectors(spark: SparkSession, n: int, dimension: int, clusters: int, std: float = 0.1, seed: int = 42) -> DataFrame:
    """Unit centers with Gaussian noise."""
    centers = _unit(_rng(seed, 0, 2).uniform(-1, 1, (clusters, dimension)))

    def make(k, ids):
        rng = _rng(seed, k, 3)
        return centers[rng.integers(0, clusters, len(ids))] + rng.normal(0, std, (len(ids), dimension))

    return _rows(spark, n, make)


def benchmark_vectors(spark: SparkSession, n: int, dimension: int = 128, seed: int = 42) -> DataFrame:
    """Up to 200 clusters of gamma-distributed sizes, noise 0.2, the rest uniform outliers."""
    clusters = max(1, min(200, n // 50))
    rng = _rng(seed, 0, 4)
    centers = _unit(rng.uniform(-1, 1, (clusters, dimension)))
    sizes = np.floor(rng.gamma(2.0, 1.0, clusters) * n / clusters) + 1
    ends = np.cumsum(np.floor(sizes / sizes.sum() * n)).astype(np.int64)

    def make(k, ids):
        r = _rng(seed, k, 5)
        of = np.searchsorted(ends, ids, "right")
        noise, far = r.normal(0, 0.2, (len(ids), dimension)), r.uniform(-1, 1, (len(ids), dimension))
        return np.where((of < clusters)[:, None], centers[np.minimum(of, clusters - 1)] + noise, far)

    return _rows(spark, n, make)


def benchmark_queries(base: DataFrame, queries: int, dimension: int, seed: int = 42, near: float = 0.8) -> DataFrame:
    """(query_id, embedding): ``near`` of them are noisy base rows, the others uniform."""
    spark = base.sparkSession
    n = base.count()
    rng = _rng(seed, 0, 6)
    pick = rng.integers(0, max(n, 1), queries).tolist()
    close = (rng.uniform(0, 1, queries) < near).tolist()
    chosen = spark.createDataFrame([(q, int(p)) for q, (p, c) in enumerate(zip(pick, close)) if c], "query_id long, node_id long")
    noise = _rows(spark, queries, lambda k, ids: _rng(seed, k, 7).normal(0, 0.1, (len(ids), dimension)), "query_id")
    far = _rows(spark, queries, lambda k, ids: _rng(seed, k, 8).uniform(-1, 1, (len(ids), dimension)), "query_id")
    from_base = base.join(F.broadcast(chosen), "node_id").select("query_id", F.col("embedding").alias("v"))  # as many rows as queries
    near_rows = from_base.join(noise, "query_id").select("query_id", F.zip_with("v", "embedding", lambda x, y: (x + y).cast("float")).alias("embedding"))
    return near_rows.unionByName(far.join(chosen, "query_id", "left_anti"))


def perturbed_queries(base: DataFrame, queries: int, dimension: int, std: float = 0.01, seed: int = 42) -> DataFrame:
    """Queries that are base rows with a little noise, for tests with exact ground truth."""
    spark, n = base.sparkSession, base.count()
    pick = _rng(seed, 0, 9).integers(0, max(n, 1), queries).tolist()
    chosen = spark.createDataFrame([(q, int(p)) for q, p in enumerate(pick)], "query_id long, node_id long")
    noise = _rows(spark, queries, lambda k, ids: _rng(seed, k, 10).normal(0, std, (len(ids), dimension)), "query_id")
    rows = base.join(F.broadcast(chosen), "node_id").select("query_id", F.col("embedding").alias("v"))
    return rows.join(noise, "query_id").select("query_id", F.zip_with("v", "embedding", lambda x, y: (x + y).cast("float")).alias("embedding"))


def queries_with_truth(base: DataFrame, queries: int, dimension: int, k: int = 10, std: float = 0.01, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Perturbed base rows as queries, and their exact ground truth (query_id, rk, node_id, distance)."""
    from ..operators.exact import exact_knn

    q = perturbed_queries(base, queries, dimension, std, seed)
    return q, exact_knn(base, q, k)


def file_or_synthetic(spark: SparkSession, path: str | None, n: int, dimension: int = 128, seed: int = 42) -> DataFrame:
    """The file's vectors, or the benchmark's distribution where there is no such file."""
    from .vecs import read_or_empty

    if path:
        rows = read_or_empty(spark, path, limit=n)
        if not rows.isEmpty():
            return rows
    return benchmark_vectors(spark, n, dimension, seed)
