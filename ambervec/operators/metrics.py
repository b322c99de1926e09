"""Statistics, validation, recall, latency and memory reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions import vectors as V


def dataset_stats(base: DataFrame) -> DataFrame:
    """One row: n, dimension of the first row, mean/min/max/population deviation of the
    norms and mean/min/max of the elements; zeros for an empty table."""
    rows = base.select(
        "node_id", F.size("embedding").alias("size"), V.norm("embedding").alias("norm"),
        F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")).alias("total"),
        F.array_min("embedding").cast("double").alias("lo"), F.array_max("embedding").cast("double").alias("hi"),
    )
    zero = F.lit(0.0)
    return rows.agg(
        F.count(F.lit(1)).alias("num_vectors"), F.coalesce(F.min_by("size", "node_id"), F.lit(0)).alias("dimension"),
        F.coalesce(F.avg("norm"), zero).alias("mean_norm"), F.coalesce(F.min("norm"), zero).alias("min_norm"),
        F.coalesce(F.max("norm"), zero).alias("max_norm"), F.coalesce(F.stddev_pop("norm"), zero).alias("std_norm"),
        F.coalesce(F.sum("total") / F.sum("size"), zero).alias("mean_value"), F.coalesce(F.min("lo"), zero).alias("min_value"),
        F.coalesce(F.max("hi"), zero).alias("max_value"),
    )


def validate_dataset(base: DataFrame) -> DataFrame:
    """One row: whether every vector is finite and of one positive size; an empty table is valid."""
    out = base.agg(F.count(F.lit(1)).alias("num_vectors"), F.coalesce(F.bool_and(V.is_valid("embedding")), F.lit(True)).alias("ok"), F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b"))
    return out.select("num_vectors", (F.col("ok") & (F.coalesce("a", F.lit(0)) == F.coalesce("b", F.lit(0)))).alias("valid"))


def _hits(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, hits, truths): both sides cut at rank k."""
    t = truth.where(F.col("rk") <= k).select("query_id", "node_id")
    f = found.where(F.col("rk") <= k).select("query_id", "node_id").distinct().withColumn("hit", F.lit(1))
    return t.join(f, ["query_id", "node_id"], "left").groupBy("query_id").agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("truths"))


def recall_micro(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: hits over truths, both summed over the queries; 0 without truths."""
    return _hits(found, truth, k).agg(F.coalesce(F.sum("hits") / F.sum("truths"), F.lit(0.0)).alias("recall"))


def recall_macro(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: mean over the queries of hits / k, even where a query has fewer truths."""
    return _hits(found, truth, k).agg(F.coalesce(F.avg(F.col("hits") / k), F.lit(0.0)).alias("recall"))


def recall_strict(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """As `recall_micro`, but query sets that differ are an error."""
    a, b = found.select("query_id").distinct(), truth.select("query_id").distinct()
    if a.exceptAll(b).unionByName(b.exceptAll(a)).limit(1).count():
        raise InvalidArgument("results and ground truth have different queries")
    return recall_micro(found, truth, k)


def applicable_truth(truth: DataFrame, n: int, k: int, first: int = 10, share: float = 0.5) -> tuple[DataFrame, bool]:
    """Ground truth cut to ids below n and rank k, and whether at least ``share`` of
    the ids of the first queries lie in range (else exact search is to be used)."""
    head = truth.where(F.col("query_id") < first)
    ok = head.agg(F.avg((F.col("node_id") < n).cast("double"))).first()[0]
    w = W.partitionBy("query_id").orderBy("rk")
    cut = truth.where(F.col("node_id") < n).withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)
    return cut, bool(ok is not None and ok >= share)


def percentiles(rows: DataFrame, value: str, ps: list[float], by: str | None = None, buckets: int = 64) -> DataFrame:
    """Element min(floor(n p / 100), n - 1) of the sorted values for each p, as columns p50, p99...

    Values fall into buckets at approximate quantiles; counts of the buckets say
    in which one a rank lies, and only there values are ranked. So a task sees
    about a ``buckets``-th of the different values, not all of them.
    """
    key = [by] if by else []
    known = rows.where(F.col(value).isNotNull()).select(*key, F.col(value).alias("__v"))
    bounds = sorted(set(known.approxQuantile("__v", [i / buckets for i in range(1, buckets)], 0.002))) if not dict(rows.dtypes)[value].startswith("decimal") else []
    place = F.size(F.filter(F.array(*(F.lit(float(b)) for b in bounds)), lambda b: b < F.col("__v"))) if bounds else F.lit(0)
    hist = known.groupBy(*key, "__v").agg(F.count(F.lit(1)).alias("c")).withColumn("__b", place)
    w = W.partitionBy(*key) if key else W.partitionBy()
    sizes = hist.groupBy(*key, "__b").agg(F.sum("c").alias("s"))
    sizes = sizes.select(*key, "__b", F.coalesce(F.sum("s").over(w.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("s").over(w).alias("n"))
    inner = W.partitionBy(*key, "__b").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    run = hist.join(sizes, [*key, "__b"]).withColumn("upto", F.col("before") + F.sum("c").over(inner))
    cols = []
    for p in ps:
        rank = F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1)
        cols.append(F.min(F.when(F.col("upto") > rank, F.col("__v"))).alias(f"p{p:g}".replace(".", "_")))
    return run.groupBy(*key).agg(F.max("n").alias("n"), *cols)


def latency_report(rows: DataFrame, value: str) -> DataFrame:
    """One row: average, queries a second (1000 / average ms), p50, p95, p99, p99.9."""
    stats = rows.agg(F.avg(value).alias("avg_ms"), F.try_divide(F.lit(1000.0), F.avg(value)).alias("qps"))
    return stats.crossJoin(F.broadcast(percentiles(rows, value, [50, 95, 99, 99.9])))  # one row each


def memory_report(n: int, dimension: int, max_degree: int, subspaces: int, codes: int, cache_pages: int) -> dict[str, float]:
    """Bytes of codes, codebook, graph, visited bits and cache, and their share of the vectors."""
    raw = n * dimension * 4
    parts = {
        "codes": n * subspaces, "codebook": codes * dimension * 4, "graph": n * 2 * max_degree * 4 + n,
        "visited": -(-n // 8), "cache": cache_pages * 4096,
    }
    total = sum(parts.values())
    return parts | {"total": total, "vectors": raw, "ratio": total / raw if raw else 0.0}


def cache_pages(n: int, dimension: int, fixed: int, share: float = 0.20) -> int:
    """Pages that fit ``share`` of the vectors' bytes beside the fixed parts, within 20 and n / 10."""
    room = max(0, int(n * dimension * 4 * share) - fixed) // 4096
    return max(20, min(room, n // 10))


def within_memory_limits(used, total, low: float = 0.10, high: float = 0.20) -> Column:
    """Whether used / total lies in [low, high]; of columns or numbers."""
    ratio = (used if isinstance(used, Column) else F.lit(float(used))) / (total if isinstance(total, Column) else F.lit(float(total)))
    return F.coalesce((ratio >= low) & (ratio <= high), F.lit(False))


def engine_metrics(samples: DataFrame, keep: int = 10_000) -> DataFrame:
    """One row over latency samples (seq, ms): totals, and the average over the latest ones,
    of which half are dropped whenever ``keep`` are passed."""
    n = samples.agg(F.max("seq")).first()[0]
    drop = 0
    if n is not None and n + 1 > keep:
        drop = -(-(n + 1 - keep) // (keep // 2)) * (keep // 2)
    return samples.agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.avg(F.when(F.col("seq") >= drop, F.col("ms"))), F.lit(0.0)).alias("avg_ms"))
