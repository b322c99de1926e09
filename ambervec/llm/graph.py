"""Connected components of links between ids, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged


def _state(df: DataFrame) -> tuple:
    r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first()
    return (r[0], r[1])


def components(links: DataFrame) -> DataFrame:
    """(id, label): the least id reachable over ``links`` (a, b) for each id in them.

    Alternating large-star and small-star rounds until nothing changes; each
    round is aggregates and joins on ids, written to the shared folder.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = _state(edges)
    if not before[0]:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))
    while True:
        # large star: every larger neighbour goes to the least neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour and the id itself go to the least one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt = staged(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "links")
        now = _state(nxt)
        if now == before:
            return nxt.select(F.col("u").alias("id"), F.col("v").alias("label"))
        drop_staged(edges.sparkSession, edges)
        edges, before = nxt, now
