"""Product quantisation: training, encoding, and search in two phases."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import PqConfig
from ..errors import InvalidArgument
from ..functions import pq, vectors as V
from .exact import top_k

CODEBOOK = "sub int, code int, centroid array<double>"


def kmeans(x: np.ndarray, k: int, iterations: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm: distinct random rows to start from, the first centroid wins
    ties, an empty cluster keeps its centroid, and it ends when nothing moves."""
    if len(x) < k:
        raise InvalidArgument(f"{len(x)} vectors are fewer than {k} centroids")
    centers = x[np.sort(rng.choice(len(x), k, replace=False))].astype(np.float64)
    last = None
    for step in range(iterations):
        d = (x * x).sum(1)[:, None] + (centers * centers).sum(1) - 2 * x @ centers.T
        near = d.argmin(1)
        if step and (near == last).all():
            break
        last = near
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(centers)
        np.add.at(total, near, x)
        centers = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centers)
    return centers


def train_codebook(base: DataFrame, config: PqConfig = PqConfig()) -> DataFrame:
    """(sub, code, centroid): k-means in every subspace, one task a subspace, on a
    sample of at most ``config.sample`` rows with the least hash of their id."""
    m = config.subspaces
    sample = base.select("node_id", "embedding").orderBy(F.xxhash64("node_id", F.lit(config.seed)), "node_id").limit(config.sample)
    width = sample.select(F.max(F.size("embedding"))).first()[0]
    if width is None or width % m:
        raise InvalidArgument(f"dimension {width} is no multiple of {m} subspaces")
    width //= m
    parts = sample.select(F.posexplode(F.array(*(V.subvector("embedding", j, width) for j in range(m)))).alias("sub", "part"), "node_id")

    def fit(key, table):
        table = table.sort_by("node_id")
        x = np.array(table.column("part").to_pylist(), np.float64)
        rng = np.random.Generator(np.random.PCG64([config.seed, key[0].as_py()]))
        c = kmeans(x, config.codes, config.iterations, rng)
        return pa.table({"sub": pa.array([key[0].as_py()] * len(c), pa.int32()), "code": pa.array(range(len(c)), pa.int32()), "centroid": pa.array(c.tolist(), pa.list_(pa.float64()))})

    return parts.groupBy("sub").applyInArrow(fit, CODEBOOK)


def fixed_codebook(base: DataFrame, subspaces: int, codes: int) -> DataFrame:
    """Codebook of the parts of rows 0..codes-1, for checks against SQL."""
    first = base.where(F.col("node_id") < codes).select("node_id", "embedding")
    width = (F.size("embedding") / subspaces).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(subspaces - 1)), lambda j: F.slice("embedding", j * width + 1, width))
    return first.select(F.col("node_id").cast("int").alias("code"), F.posexplode(parts).alias("sub", "part")).select("sub", "code", F.transform("part", lambda x: x.cast("double")).alias("centroid"))


def as_row(codebook: DataFrame) -> DataFrame:
    """The codebook (m * k centroids, a fixed size) as one row of nested arrays."""
    subs = codebook.groupBy("sub").agg(F.array_sort(F.collect_list(F.struct("code", "centroid"))).alias("c"))
    return subs.agg(F.array_sort(F.collect_list(F.struct("sub", F.col("c.centroid").alias("c")))).alias("x")).select(F.col("x.c").alias("codebook"))


def book_array(codebook: DataFrame) -> np.ndarray:
    """(m, k, width): a codebook has a fixed size whatever the table's."""
    rows = sorted(codebook.collect(), key=lambda r: (r["sub"], r["code"]))
    m = len({r["sub"] for r in rows})
    return np.array([r["centroid"] for r in rows], np.float64).reshape(m, len(rows) // max(m, 1), -1)


def matrix(lists) -> np.ndarray:
    """A column of equally long lists as (rows, size) numbers, without Python lists."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks() if lists.num_chunks != 1 else lists.chunk(0)
    if not len(lists):
        return np.zeros((0, 1))
    sizes = lists.value_lengths().unique()
    if len(sizes) > 1 or lists.null_count:
        raise InvalidArgument("dimension mismatch")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def encode(base: DataFrame, codebook: DataFrame, block: int = 4096) -> DataFrame:
    """(node_id, codes): the nearest centroid of every part; the first one wins ties.

    A block of rows meets a subspace's centroids as one matrix product; distances
    within rounding of the least are computed again exactly, so ties are the same as
    by `pq.encode`.
    """
    book = base.sparkSession.sparkContext.broadcast(book_array(codebook))  # m * k centroids

    def run(batches):
        c = book.value
        norm = (c * c).sum(2)
        for b in batches:
            for lo in range(0, b.num_rows, block):
                part = b.slice(lo, block)
                x = matrix(part.column("embedding")).reshape(part.num_rows, len(c), -1)
                out = np.empty((part.num_rows, len(c)), np.int16)
                for j in range(len(c)):
                    v = x[:, j]
                    d = (v * v).sum(1)[:, None] + norm[j] - 2 * v @ c[j].T
                    low = d.min(1)
                    near = d <= (low + 1e-9 * (1 + np.abs(norm[j]).max() + (v * v).sum(1)))[:, None]
                    out[:, j] = d.argmin(1)
                    for i in np.flatnonzero(near.sum(1) > 1):
                        at = np.flatnonzero(near[i])
                        out[i, j] = at[((v[i] - c[j, at]) ** 2).sum(1).argmin()]
                lists = pa.ListArray.from_arrays(np.arange(0, out.size + 1, len(c), dtype=np.int32), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("node_id").cast(pa.int64()), lists], ["node_id", "codes"])

    return base.select("node_id", "embedding").mapInArrow(run, "node_id long, codes array<smallint>")


def decode(codes: DataFrame, codebook: DataFrame) -> DataFrame:
    """(node_id, embedding) as the codes say."""
    return codes.crossJoin(F.broadcast(as_row(codebook))).select("node_id", pq.decode("codes", "codebook").alias("embedding"))


def distance_tables(queries: DataFrame, codebook: DataFrame) -> DataFrame:
    """(query_id, table): squared distances of the query's parts to all centroids."""
    return queries.crossJoin(F.broadcast(as_row(codebook))).select("query_id", pq.distance_table("embedding", "codebook").alias("table"))


TABLE_BYTES = 16 << 20  # distance tables of the queries that one block holds


def adc_top(codes: DataFrame, tables: DataFrame, r: int) -> DataFrame:
    """(query_id, rk, node_id, adc) of the r nearest by estimated squared distance.

    Queries go in blocks whose distance tables fit ``TABLE_BYTES``, and every block meets
    all codes where they lie: a task keeps the r best of each query, so r rows a task
    and query are shuffled, and no more than a block's tables is sent at a time.
    """
    n, size = tables.agg(F.count(F.lit(1)), F.max(F.size("table") * F.size(F.element_at("table", 1)))).first() if r > 0 else (0, 0)
    blocks = max(1, -(-(n or 0) * 8 * (size or 0) // TABLE_BYTES))
    out = None
    for k in range(blocks):
        some = tables if blocks == 1 else tables.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
        rows = some.toArrow() if n else pa.table({"query_id": []})  # a block of counted size
        part = _adc_best(codes, rows, r)
        out = part if out is None else out.unionByName(part)
    return top_k(out, r, "adc").select("query_id", "rk", "node_id", "adc")


def _adc_best(codes: DataFrame, tables: pa.Table, r: int) -> DataFrame:
    q = tables.column("query_id").to_numpy() if tables.num_rows else np.zeros(0, np.int64)
    t = tables.column("table").combine_chunks() if tables.num_rows else None
    if isinstance(t, pa.ChunkedArray):
        t = t.chunk(0)
    m = t.value_lengths()[0].as_py() if len(q) else 0
    flat = t.flatten().flatten().to_numpy(zero_copy_only=False).reshape(len(q), m, -1) if len(q) else None
    held = codes.sparkSession.sparkContext.broadcast((q, flat))

    def run(batches):
        q, flat = held.value
        best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in q]
        for b in batches:
            if not b.num_rows or not len(q):
                continue
            ids, at = b.column("node_id").to_numpy(), matrix(b.column("codes")).astype(np.int64)
            for i in range(len(q)):
                d = flat[i, 0, at[:, 0]].copy()
                for j in range(1, at.shape[1]):
                    d += flat[i, j, at[:, j]]
                d, n = np.concatenate([best[i][0], d]), np.concatenate([best[i][1], ids])
                if len(d) > r:
                    worst = np.partition(d, r - 1)[r - 1]
                    keep = d <= worst  # ties stay until they are ordered
                    d, n = d[keep], n[keep]
                    order = np.lexsort((n, d))[:r]
                    d, n = d[order], n[order]
                best[i] = (d, n)
        for i, (d, n) in enumerate(best):
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), q[i])), pa.array(n), pa.array(d)], ["query_id", "node_id", "adc"])

    return codes.select("node_id", "codes").mapInArrow(run, "query_id long, node_id long, adc double")


def adc_scores(codes: DataFrame, tables: DataFrame) -> DataFrame:
    """(query_id, node_id, adc) of a few queries' tables against all codes, as column expressions."""
    return codes.crossJoin(F.broadcast(tables)).select("query_id", "node_id", pq.adc_distance("codes", "table").alias("adc"))  # a counted query set


def rerank(candidates: DataFrame, base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact distances of candidates (query_id, node_id), the k nearest of each query."""
    scored = candidates.select("query_id", "node_id").join(base.select("node_id", "embedding"), "node_id")
    scored = scored.join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
    return top_k(scored.select("query_id", "node_id", V.l2_distance("embedding", "q").alias("distance")), k).select("query_id", "rk", "node_id", "distance")


def pq_search(base: DataFrame, codes: DataFrame, codebook: DataFrame, queries: DataFrame, k: int = 10, r: int = 100) -> DataFrame:
    """Two phases: the r best by estimate, their exact distances, the k best."""
    return rerank(adc_top(codes, distance_tables(queries, codebook), r), base, queries, k)


def adc_threshold(scored: DataFrame, k: int, factor: float = 4.0) -> DataFrame:
    """Candidates (query_id, node_id, adc, exact squared d2) whose estimate is at most
    ``factor`` times the k-th best exact distance; queries of fewer than k keep all,
    and at least k stay."""
    w = W.partitionBy("query_id")
    ranked = scored.withColumn("by_d2", F.row_number().over(w.orderBy("d2", "node_id"))).withColumn("by_adc", F.row_number().over(w.orderBy("adc", "node_id")))
    ranked = ranked.withColumn("worst", F.max(F.when(F.col("by_d2") == k, F.col("d2"))).over(w))
    keep = F.col("worst").isNull() | (F.col("adc") <= factor * F.col("worst")) | (F.col("by_adc") <= k)
    return ranked.where(keep).select("query_id", "node_id", "adc", "d2")
