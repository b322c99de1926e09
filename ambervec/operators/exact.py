"""Exact nearest-neighbour search and lookups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions import vectors as V

RESULT = "query_id long, rk int, node_id long, distance double"
BROADCAST_ROWS = 2_000


def top_k(scored: DataFrame, k: int, by: str = "distance") -> DataFrame:
    """The k nearest of each query; ties go to the smaller id."""
    w = W.partitionBy("query_id").orderBy(by, "node_id")
    return scored.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def exact_knn(base: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2") -> DataFrame:
    """(query_id, rk, node_id, distance) of the k nearest base rows of each query.

    Queries are counted: up to 2,000 they are sent to the tasks, which keep the k best
    of each as they read the base once; beyond that blocks of queries go through
    `blocked_knn`. Rows without a vector are no results.
    """
    if k < 0:
        raise InvalidArgument("k must not be negative")
    if metric not in V.METRICS:
        raise InvalidArgument(f"unknown metric {metric!r}")
    base = base.where(F.col("embedding").isNotNull())
    few = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").where(F.col("embedding").isNotNull()).limit(BROADCAST_ROWS + 1).toArrow()
    if few.num_rows > BROADCAST_ROWS:
        return blocked_knn(base, queries.where(F.col("embedding").isNotNull()), k, metric)
    return top_k(_nearest(base, few, k, metric), k).select("query_id", "rk", "node_id", "distance")


def _nearest(base: DataFrame, queries: pa.Table, k: int, metric: str, cells: int = 1 << 21) -> DataFrame:
    """(query_id, node_id, distance): the k nearest of each query in each task.

    Matrix products say which rows can be among the k nearest; only their distances
    are computed again, row by row, so equal vectors get equal distances.
    """
    ids = queries.column("query_id").to_numpy()
    q = _matrix(queries.column("embedding").combine_chunks()) if len(ids) else np.zeros((0, 0))
    held = base.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches):
        ids, q = held.value
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # query, node, distance
        for batch in batches:
            step = max(1, cells // max(1, len(q)))
            for lo in range(0, batch.num_rows if len(q) and k else 0, step):
                part = batch.slice(lo, step)
                nodes, x = part.column("node_id").to_numpy(), _matrix(part.column("embedding"))
                if x.shape[1] != q.shape[1]:
                    raise InvalidArgument("dimension mismatch")
                d = _scores(x, q, metric, False)
                near = np.partition(d, k - 1, axis=1)[:, k - 1] if len(nodes) > k else np.full(len(q), np.inf)
                a, b = np.nonzero(~(d > (near + 1e-9 * (1 + np.abs(near) + (q * q).sum(1)))[:, None]))
                best = tuple(np.concatenate(both) for both in zip(best, (a, nodes[b], _exactly(x[b], q[a], metric))))
                order = np.lexsort((best[1], best[2], best[0]))
                a = best[0][order]
                rank = np.arange(len(a)) - np.searchsorted(a, a)
                best = tuple(c[order][rank < k] for c in best)
        yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]], pa.int64()), pa.array(best[1], pa.int64()), pa.array(best[2])], ["query_id", "node_id", "distance"])

    return base.select(F.col("node_id").cast("long").alias("node_id"), "embedding").mapInArrow(run, "query_id long, node_id long, distance double")


def _exactly(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows to rows."""
    if metric == "ip":
        return -(x * q).sum(1)
    if metric == "cosine":
        n = np.sqrt((x * x).sum(1) * (q * q).sum(1))
        return np.where(n > 0, 1 - (x * q).sum(1) / np.where(n > 0, n, 1), 1.0)
    d = ((x - q) ** 2).sum(1)
    return np.sqrt(d) if metric == "l2" else d


def _scores(x: np.ndarray, q: np.ndarray, metric: str, root: bool = True) -> np.ndarray:
    if metric == "ip":
        return -(q @ x.T)
    if metric == "cosine":
        n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)
        return np.where(n > 0, 1 - q @ x.T / np.where(n > 0, n, 1), 1.0)
    d = np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * (q @ x.T), 0)
    return np.sqrt(d) if metric == "l2" and root else d


def _blocks(rows: DataFrame, id_col: str, size: int, name: str) -> DataFrame:
    """Rows packed in blocks of about ``size``: parallel lists of ids and vectors."""
    n = max(1, -(-rows.count() // size))
    block = F.pmod(F.xxhash64(id_col), F.lit(n)).alias("b")
    packed = rows.select(block, F.struct(F.col(id_col).alias("id"), F.col("embedding").alias("v")).alias("x")).groupBy("b").agg(F.collect_list("x").alias("x"))
    return packed.select(F.col("x.id").alias(f"{name}_ids"), F.col("x.v").alias(f"{name}_vectors"))


def _matrix(lists) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    sizes = lists.value_lengths().unique()
    if len(sizes) != 1:
        raise InvalidArgument("dimension mismatch")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def near_in_blocks(pairs: DataFrame, k: int, metric: str) -> DataFrame:
    """(query_id, node_id, distance): the k nearest in each pair of blocks
    (q_ids, q_vectors, b_ids, b_vectors)."""

    def near(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                col = {c: batch.column(c)[i].values for c in batch.schema.names}
                ids, nodes = col["q_ids"].to_numpy(), col["b_ids"].to_numpy()
                q, x = _matrix(col["q_vectors"]), _matrix(col["b_vectors"])
                if q.shape[1] != x.shape[1]:
                    raise InvalidArgument("dimension mismatch")
                d = _scores(x, q, metric)
                m = min(k, len(nodes))
                order = np.lexsort((np.broadcast_to(nodes, d.shape), d), axis=1)[:, :m]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, m)), pa.array(nodes[order].ravel()), pa.array(np.take_along_axis(d, order, 1).ravel())], ["query_id", "node_id", "distance"]
                )

    return pairs.mapInArrow(near, "query_id long, node_id long, distance double")


def blocked_knn(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2", block: int = 2048) -> DataFrame:
    """Exact search of any number of queries: blocks of queries meet blocks of the
    base as matrix products, and each pair of blocks keeps k rows a query.

    The work is base times queries and is dealt over the tasks; no side reaches
    the driver or has to fit one task.
    """
    pairs = _blocks(base, "node_id", block, "b").crossJoin(_blocks(queries, "query_id", block, "q"))  # of blocks
    return top_k(near_in_blocks(pairs, k, metric), k).select("query_id", "rk", "node_id", "distance")


def get_vector(base: DataFrame, node_id: int) -> DataFrame:
    """Point read: the filter reaches the Parquet row groups."""
    return base.where(F.col("node_id") == node_id).select("node_id", "embedding")


def batch_lookup(ids: DataFrame, base: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows of ``ids`` (pos, node_id) in order, with what is stored for each id and
    whether it was found."""
    columns = columns or [c for c in base.columns if c != "node_id"]
    stored = base.select("node_id", *columns, F.lit(True).alias("__there"))
    return ids.join(stored, "node_id", "left").select("pos", "node_id", *columns, F.coalesce("__there", F.lit(False)).alias("found"))


def distances_to(ids: DataFrame, base: DataFrame, query: list[float], squared: bool = True) -> DataFrame:
    """Distance of one query to listed ids; null where an id is unknown."""
    q = F.array(*(F.lit(float(x)) for x in query))
    d = V.l2_squared("embedding", q) if squared else V.l2_distance("embedding", q)
    return batch_lookup(ids, base, ["embedding"]).select("pos", "node_id", d.alias("distance"), "found")


def merged_knn(base: DataFrame, delta: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2") -> DataFrame:
    """Search of a base and of rows written since: the k best of both."""
    both = exact_knn(base, queries, k, metric).unionByName(exact_knn(delta, queries, k, metric))
    return top_k(both.drop("rk"), k).select("query_id", "rk", "node_id", "distance")
