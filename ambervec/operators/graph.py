"""Proximity graphs as tables: nodes(node_id, neighbors), edges(src, dst)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import GraphConfig, SearchConfig
from ..errors import InvalidArgument
from ..functions import vectors as V
from ..sources.scratch import scratch_dir, written
from .exact import batch_lookup, blocked_knn, exact_knn, near_in_blocks
from .quantize import matrix

NODES = "node_id long, neighbors array<long>"


# ------------------------------------------------------------- primitives


def _none() -> Column:
    return F.array().cast("array<long>")


def edges(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("node_id").alias("src"), F.explode("neighbors").alias("dst"))


def add_neighbor(neighbors: Column, node_id, max_degree: int) -> Column:
    """Append unless it is there or the list is full."""
    x = F.lit(node_id) if isinstance(node_id, int) else node_id
    return F.when(F.array_contains(neighbors, x) | (F.size(neighbors) >= max_degree), neighbors).otherwise(F.concat(neighbors, F.array(x.cast("long"))))


def remove_neighbor(neighbors: Column, node_id) -> Column:
    return F.array_remove(neighbors, node_id)


def compact(nodes: DataFrame, max_degree: int) -> DataFrame:
    return nodes.select("node_id", F.slice("neighbors", 1, max_degree).alias("neighbors"))


def degrees(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_id", F.size("neighbors").alias("degree"))


def in_degrees(nodes: DataFrame) -> DataFrame:
    """(node_id, in_degree) with zeros; counts are pre-aggregated before the shuffle."""
    n = edges(nodes).groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.select("node_id").join(n, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).alias("in_degree"))


def hub_threshold(in_degree: DataFrame, percentile: float = 0.75) -> DataFrame:
    """One row: the non-zero in-degree at rank min(ceil(n p), n - 1) from 0; 1 if there is none.

    Works on the histogram of degrees, whose size is the number of different degrees.
    """
    hist = in_degree.where("in_degree > 0").groupBy("in_degree").agg(F.count(F.lit(1)).alias("n"))
    w = W.orderBy("in_degree").rowsBetween(W.unboundedPreceding, 0)
    run = hist.select("in_degree", F.sum("n").over(w).alias("upto"), F.sum("n").over(W.partitionBy()).alias("all"))
    rank = F.least(F.ceil(F.col("all") * percentile), F.col("all") - 1)
    return run.where(F.col("upto") > rank).agg(F.coalesce(F.min("in_degree"), F.lit(1)).alias("threshold"))


def hub_nodes(in_degree: DataFrame, percentile: float = 0.75) -> DataFrame:
    return in_degree.crossJoin(F.broadcast(hub_threshold(in_degree, percentile))).where("in_degree >= threshold").select("node_id", "in_degree")  # one row


def centroid(base: DataFrame) -> DataFrame:
    """One row: the mean vector."""
    means = base.select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def medoid(base: DataFrame, by: str | None = None) -> DataFrame:
    """The row nearest to the mean (least id on ties), of all rows or of each value of ``by``."""
    key = [by] if by else []
    means = base.select(*key, F.posexplode("embedding").alias("pos", "x")).groupBy(*key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = means.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))
    both = base.join(means, key) if by else base.crossJoin(F.broadcast(means))  # one row
    scored = both.select(*key, "node_id", V.l2_squared("embedding", "centroid").alias("d2"))
    return scored.groupBy(*key).agg(F.min_by("node_id", F.struct("d2", "node_id")).alias("node_id"), F.min("d2").alias("d2"))


def random_graph(base: DataFrame, degree: int, seed: int = 42) -> DataFrame:
    """Each node gets ``degree`` different others: its id's hash picks strides over the row numbers."""
    ids = base.select("node_id")
    n = ids.count()
    if n == 0:
        return base.sparkSession.createDataFrame([], NODES)
    numbered = _numbered(ids)
    take = min(degree, n - 1)
    picks = numbered.select("node_id", "no", F.explode(F.sequence(F.lit(0), F.lit(max(take * 2, 1)))).alias("t"))
    picks = picks.select("node_id", "no", "t", F.pmod(F.xxhash64("node_id", "t", F.lit(seed)), F.lit(n)).alias("other")).where("no <> other")
    picks = picks.groupBy("node_id", "no", "other").agg(F.min("t").alias("t"))
    named = picks.join(numbered.select(F.col("node_id").alias("dst"), F.col("no").alias("other")), "other")
    lists = named.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("t", "dst"))).alias("x"))
    return ids.join(lists, "node_id", "left").select("node_id", F.coalesce(F.slice(F.col("x.dst"), 1, take), F.array().cast("array<long>")).alias("neighbors"))


def _numbered(ids: DataFrame) -> DataFrame:
    """Consecutive numbers without one global sort: counts per hash bucket, then ranks inside."""
    b = ids.withColumn("b", F.pmod(F.xxhash64("node_id"), F.lit(256)))
    sizes = b.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.select("b", F.coalesce(F.sum("n").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rank = F.row_number().over(W.partitionBy("b").orderBy("node_id"))
    return b.withColumn("r", rank).join(F.broadcast(base), "b").select("node_id", (F.col("base") + F.col("r") - 1).alias("no"))  # 256 rows


# ------------------------------------------------------------------ prune


def prune_order(d: np.ndarray, cross: np.ndarray, degree: int, alpha: float, rule: str) -> list[int]:
    """Positions kept of candidates sorted by distance. ``d``: squared distances to the
    node, ``cross``: squared distances among the candidates.

    Rules: "fill" rejects c if alpha * d2(c, s) <= d2(n, c) for a kept s, then fills up
    with the nearest rejected ones; "strict" rejects if alpha * d2(c, s) < d2(n, c);
    "distance" rejects if d(c, s) < alpha * d(n, c), on distances that aren't squared.
    """
    keep: list[int] = []
    rest: list[int] = []
    for i in range(len(d)):
        if len(keep) >= degree:
            break
        s = cross[i, keep]
        if rule == "distance":
            bad = bool((np.sqrt(s) < alpha * np.sqrt(d[i])).any()) and bool(keep)
        elif rule == "strict":
            bad = bool((alpha * s < d[i]).any())
        else:
            bad = bool((alpha * s <= d[i]).any())
        (rest if bad else keep).append(i)
    if rule == "fill":
        keep += rest[: degree - len(keep)]
    return keep


def robust_prune(candidates: DataFrame, config: GraphConfig = GraphConfig()) -> DataFrame:
    """Neighbour lists from candidates (node_id, embedding, cands array<struct<id, v>>).

    Vectors come as flat Arrow buffers and a node's candidates meet in one matrix
    product; only the greedy choice goes step by step, over at most max_degree kept
    ones.
    """

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            cands = b.column("cands")
            first = np.concatenate(([0], np.cumsum(cands.value_lengths().to_numpy(zero_copy_only=False))))
            flat = cands.flatten()
            ids, own = flat.field("id").to_numpy(zero_copy_only=False), b.column("node_id").to_numpy()
            q = matrix(b.column("embedding"))
            x = matrix(flat.field("v")) if len(flat) else np.zeros((0, q.shape[1]))
            if len(flat) and x.shape[1] != q.shape[1]:
                raise InvalidArgument("dimension mismatch")
            lists = []
            for i in range(b.num_rows):
                lo, hi = int(first[i]), int(first[i + 1])
                # each candidate once, without the node itself
                key, at = np.unique(ids[lo:hi], return_index=True)
                at = at[key != own[i]] + lo
                key, v = key[key != own[i]], x[at]
                d = ((v - q[i]) ** 2).sum(1)
                order = np.lexsort((key, d))
                key, v, d = key[order], v[order], d[order]
                lists.append(key[prune_order(d, _cross(v), config.max_degree, config.alpha, config.rule)])
            size = np.fromiter(map(len, lists), np.int32, len(lists))
            out = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(size))).astype(np.int32), pa.array(np.concatenate(lists).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(own), out], ["node_id", "neighbors"])

    return candidates.select("node_id", "embedding", "cands").mapInArrow(run, NODES)


def _cross(v: np.ndarray) -> np.ndarray:
    """Squared distances among rows; 0 between equal ones."""
    n2 = (v * v).sum(1)
    cross = np.maximum(n2[:, None] + n2 - 2 * v @ v.T, 0)
    for i, j in np.argwhere(np.triu(cross <= 1e-9 * (1 + n2[:, None] + n2), 1)):
        cross[i, j] = cross[j, i] = ((v[i] - v[j]) ** 2).sum()
    np.fill_diagonal(cross, 0)
    return cross


def _with_vectors(pairs: DataFrame, base: DataFrame) -> DataFrame:
    """(node_id, embedding, cands) from pairs (src, dst): bounded lists, as many as candidates a node."""
    v = base.select("node_id", "embedding")
    named = pairs.join(v.select(F.col("node_id").alias("dst"), F.col("embedding").alias("v")), "dst")
    lists = named.groupBy(F.col("src").alias("node_id")).agg(F.collect_list(F.struct(F.col("dst").alias("id"), "v")).alias("cands"))
    none = F.array().cast("array<struct<id:bigint,v:array<float>>>")
    return v.join(lists, "node_id", "left").select("node_id", "embedding", F.coalesce("cands", none).alias("cands"))


def knn_graph(base: DataFrame, k: int) -> DataFrame:
    """(src, rk, dst, distance): each row's k nearest others, exactly."""
    q = base.select(F.col("node_id").alias("query_id"), "embedding")
    found = blocked_knn(base, q, k + 1, "l2")
    w = W.partitionBy("query_id").orderBy("distance", "node_id")
    return found.where("query_id <> node_id").withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k).select(F.col("query_id").alias("src"), "rk", F.col("node_id").alias("dst"), "distance")


PIVOT_BYTES = 64 << 20


def _pivots(base: DataFrame, cells: int, seed: int) -> np.ndarray:
    """Vectors of ``cells`` rows, or as many as ``PIVOT_BYTES`` hold (131,072 of 64 dimensions)."""
    width = base.select(F.max(F.size("embedding"))).first()[0] or 1
    most = max(1, min(cells, PIVOT_BYTES // (8 * width)))
    picked = base.select("node_id", "embedding").orderBy(F.xxhash64("node_id", F.lit(seed)), "node_id").limit(most).toArrow().combine_chunks()
    return matrix(picked.column("embedding").combine_chunks())


def cell_overlap(base: DataFrame, k: int, cells: int, least: float = 0.95, sample: int = 200, seed: int = 42) -> int:
    """The least ``overlap`` at which `cell_knn` finds a share ``least`` of the exact
    ``k`` nearest of ``sample`` rows.

    A pair meets if some pivot is among the ``overlap`` nearest of both, so each exact
    pair tells the overlap it needs. Only the sampled pairs reach the driver; the
    sample measures and takes nothing from the result.
    """
    p = _pivots(base, cells, seed)
    rows = base.select("node_id", "embedding")
    picked = rows.orderBy(F.xxhash64("node_id", F.lit(seed + 1)), "node_id").limit(sample).collect()
    q = base.sparkSession.createDataFrame(picked, rows.schema).withColumnRenamed("node_id", "query_id")
    true = exact_knn(rows, q, k + 1).where("query_id <> node_id").join(rows, "node_id").select("query_id", "embedding")

    def ranks(x) -> np.ndarray:
        x = np.atleast_2d(np.array(x, np.float64))
        order = np.argsort((p * p).sum(1) - 2 * x @ p.T, axis=1, kind="stable")
        out = np.empty_like(order)
        np.put_along_axis(out, order, np.arange(len(p))[None, :], 1)
        return out

    near: dict = {}
    for r in true.collect():
        near.setdefault(r.query_id, []).append(r.embedding)
    needs = [np.maximum(ranks(r.embedding), ranks(near[r.node_id])).min(1) + 1 for r in picked if r.node_id in near]
    if not needs:
        return 1
    needs = np.sort(np.concatenate(needs))
    return int(needs[max(0, int(np.ceil(least * len(needs))) - 1)])


def near_candidates(base: DataFrame, config: GraphConfig, exact_rows: int, cell_rows: int) -> DataFrame:
    """(src, dst): the candidates of each row, see `build_graph`."""
    n = base.count()
    if n > exact_rows:
        cells = -(-n // cell_rows)
        overlap = cell_overlap(base, config.candidates, cells, seed=config.seed)
        if overlap * overlap < cells:
            return cell_knn(base, config.candidates, cells, overlap, seed=config.seed).select("src", "dst")
    return knn_graph(base, config.candidates).select("src", "dst")


def cell_knn(base: DataFrame, k: int, cells: int, overlap: int = 2, block: int = 2048, seed: int = 42) -> DataFrame:
    """(src, rk, dst, distance): near neighbours among rows of the same cells.

    ``cells`` rows are pivots (at most 64 MB of them reach the driver); each row joins its
    ``overlap`` nearest ones. A cell is packed in blocks of ``block`` rows, so a dense
    cell is many pairs of blocks rather than one task.
    """
    held = base.sparkSession.sparkContext.broadcast(_pivots(base, cells, seed))

    def assign(batches):
        p = held.value
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("embedding"))
            d = (x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * x @ p.T
            m = min(overlap, len(p))
            near = np.argsort(d, axis=1, kind="stable")[:, :m].astype(np.int32)
            at = pa.array(np.repeat(np.arange(len(x)), m))
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel()), b.column("node_id").take(at), b.column("embedding").take(at)], ["cell", "node_id", "embedding"])

    rows = base.select("node_id", "embedding").mapInArrow(assign, "cell int, node_id long, embedding array<float>")
    sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    rows = rows.join(F.broadcast(sizes), "cell").withColumn("b", F.pmod(F.xxhash64("node_id"), F.col("blocks")))  # a row a cell
    packed = rows.groupBy("cell", "b").agg(F.collect_list(F.struct(F.col("node_id").alias("id"), F.col("embedding").alias("v"))).alias("x"))
    packed = packed.select("cell", F.col("x.id").alias("ids"), F.col("x.v").alias("vs"))
    pairs = packed.withColumnsRenamed({"ids": "q_ids", "vs": "q_vectors"}).join(packed.withColumnsRenamed({"ids": "b_ids", "vs": "b_vectors"}), "cell").drop("cell")
    found = near_in_blocks(pairs, k + 1, "l2").distinct()
    w = W.partitionBy("query_id").orderBy("distance", "node_id")
    found = found.where("query_id <> node_id").withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)
    return found.select(F.col("query_id").alias("src"), "rk", F.col("node_id").alias("dst"), "distance")


def reverse_edges(nodes: DataFrame) -> DataFrame:
    """(src, dst): edges and their reverses, each once."""
    e = edges(nodes)
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def build_graph(base: DataFrame, config: GraphConfig = GraphConfig(), exact_rows: int = 100_000, cell_rows: int = 10_000) -> DataFrame:
    """nodes(node_id, neighbors) of at most ``max_degree`` neighbours: nearest candidates,
    prune, reverse edges, prune again, as whole-table rounds.

    Candidates are exact up to ``exact_rows`` rows. Beyond that they come from
    `cell_knn` with a cell for every ``cell_rows`` rows and the overlap that finds
    95 % of the exact candidates of 200 rows, measured on the table itself. Its work
    is overlap^2 / cells of the exact one's; where that is no gain (vectors without
    clusters), candidates are exact.
    A popular node gets many reverse edges; the nearest ``4 * candidates`` of them
    go to the second prune, ranked before they are gathered.
    Of rows with the same vector the one of the least id takes part in this; the others
    hang on it (see `_copies`), as more copies than candidates would meet nothing else.
    """
    if config.max_degree < 1:
        raise InvalidArgument("max_degree must be positive")
    copies = _copies(base, config.max_degree)
    base = _without_copies(base, copies)
    near = near_candidates(base, config, exact_rows, cell_rows)
    first = robust_prune(_with_vectors(near, base), config)
    both = _nearest_only(reverse_edges(first), base, 4 * config.candidates)
    return _with_copies(robust_prune(_with_vectors(both, base), config), copies, config.max_degree)


def _copies(base: DataFrame, max_degree: int) -> DataFrame | None:
    """(node_id, head, near) of the rows whose vector other rows have too, None if there are none.

    ``head`` is the least id with the vector. The rows are a tree in the order of their
    ids, two below each, and ``near`` has a row's links in it, both ways. So the least
    ids are met first, from any of them. Ranks come from a sort by (head, id), where a
    large group lies in many parts.
    """
    below = min(2, max_degree - 1)
    if below < 1:
        return None
    same = base.where("embedding is not null").groupBy("embedding").agg(F.min("node_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = base.select("node_id", "embedding").join(same, "embedding").select("head", "node_id").orderBy("head", "node_id")
    rows = written(rows.withColumn("part", F.spark_partition_id()), scratch_dir(base.sparkSession, "copies"))
    if rows.isEmpty():
        return None
    rows = rows.withColumn("no", F.row_number().over(W.partitionBy("part").orderBy("head", "node_id")))
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = rows.join(F.broadcast(sizes), "part").withColumn("no", F.col("no") + F.col("before"))  # a row a part
    firsts = rows.groupBy("part", "head").agg(F.min("no").alias("first")).withColumn("first", F.min("first").over(W.partitionBy("head")))
    rows = rows.join(firsts, ["part", "head"]).select("head", "node_id", (F.col("no") - F.col("first")).alias("r"))
    lower = rows.where("r > 0").select("head", F.floor((F.col("r") - 1) / below).alias("r"), F.col("node_id").alias("other"))
    down = rows.join(lower, ["head", "r"]).where("node_id <> other").select("node_id", "head", "other")
    both = down.unionByName(down.select(F.col("other").alias("node_id"), "head", F.col("node_id").alias("other")))
    return written(both.groupBy("node_id", "head").agg(F.array_sort(F.collect_set("other")).alias("near")), scratch_dir(base.sparkSession, "copies"))


def _without_copies(base: DataFrame, copies: DataFrame | None) -> DataFrame:
    """The rows without those that have the vector of a row of a smaller id."""
    return base if copies is None else base.join(copies.where("node_id <> head").select("node_id"), "node_id", "left_anti")


def _with_copies(nodes: DataFrame, copies: DataFrame | None, max_degree: int) -> DataFrame:
    """The graph with the links of ``copies`` first in the lists; rows without a list get one."""
    if copies is None:
        return nodes
    both = F.array_union(F.coalesce("near", _none()), F.coalesce("neighbors", _none()))
    return nodes.join(copies.select("node_id", "near"), "node_id", "full_outer").select("node_id", F.when(F.col("near").isNull(), F.col("neighbors")).otherwise(F.slice(both, 1, max_degree)).alias("neighbors"))


def _nearest_only(pairs: DataFrame, base: DataFrame, most: int) -> DataFrame:
    v = base.select("node_id", "embedding")
    d = pairs.join(v.select(F.col("node_id").alias("src"), F.col("embedding").alias("a")), "src").join(v.select(F.col("node_id").alias("dst"), F.col("embedding").alias("b")), "dst")
    w = W.partitionBy("src").orderBy("d2", "dst")
    return d.select("src", "dst", V.l2_squared("a", "b").alias("d2")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("src", "dst")


def insert_nodes(nodes: DataFrame, base: DataFrame, fresh: DataFrame, config: GraphConfig = GraphConfig(), shards: int | None = None) -> DataFrame:
    """Add rows to a graph. Candidates of a fresh row are what a beam search of the graph
    finds for it, and its nearest other fresh rows; they are pruned, reverse edges are
    added, and only lists over ``max_degree`` are pruned again. Copies of a vector hang on
    the least id that has it, whichever of them are fresh (see `_copies`). Beams and lists
    grow with the fresh rows, not with the base times them. An empty graph gives a built
    one."""
    from .search import beam_search

    if nodes.isEmpty():
        return build_graph(fresh, config)
    spark, everything = base.sparkSession, base.select("node_id", "embedding").unionByName(fresh.select("node_id", "embedding"))
    former, copies = _copies(base, config.max_degree), _copies(everything, config.max_degree)
    hidden = None
    if former is not None:  # the tree is made anew
        hidden = former.where("node_id <> head").select("node_id")
        nodes = nodes.join(former.select("node_id", "near"), "node_id", "left").select("node_id", F.when(F.col("near").isNull(), F.col("neighbors")).otherwise(F.array_except("neighbors", "near")).alias("neighbors"))
    fresh = _without_copies(fresh, copies)
    q = fresh.select(F.col("node_id").alias("query_id"), "embedding").repartition("query_id")
    walk = SearchConfig(k=config.candidates, ef=config.candidates)
    near = beam_search(base, nodes, q, walk, shards=shards, hidden=hidden).select(F.col("query_id").alias("src"), F.col("node_id").alias("dst"))
    near = near.unionByName(near_candidates(fresh, config, 100_000, 10_000)).where("src <> dst").distinct()
    added = written(robust_prune(_with_vectors(near, everything).join(fresh.select("node_id"), "node_id", "left_semi"), config), scratch_dir(spark, "added"))
    back = edges(added).select(F.col("dst").alias("node_id"), F.col("src").alias("other")).groupBy("node_id").agg(F.collect_set("other").alias("more"))
    grown = nodes.unionByName(added).join(back, "node_id", "left").select("node_id", F.array_union("neighbors", F.coalesce("more", _none())).alias("neighbors"))
    grown = written(grown, scratch_dir(spark, "grown"))
    over = grown.where(F.size("neighbors") > config.max_degree)
    again = robust_prune(_with_vectors(edges(over), everything).join(over.select("node_id"), "node_id", "left_semi"), config)
    return _with_copies(grown.where(F.size("neighbors") <= config.max_degree).unionByName(again), copies, config.max_degree)


def next_hop(frontier: DataFrame, nodes: DataFrame, seen: DataFrame) -> DataFrame:
    """Neighbours of the frontier (node_id) that aren't in ``seen`` (node_id)."""
    out = frontier.join(nodes, "node_id").select(F.explode("neighbors").alias("node_id")).distinct()
    return out.join(seen.select("node_id"), "node_id", "left_anti")


def graph_memory(n: int, max_degree: int) -> int:
    """Bytes of a flat graph: slots for twice the degree of four bytes, and a count a node."""
    return n * 2 * max_degree * 4 + n


def disk_index(base: DataFrame, nodes: DataFrame, codes: DataFrame, max_degree: int = 32) -> DataFrame:
    """Records (node_id, embedding, neighbors, neighbor_codes): each neighbour's code is
    stored beside its id, in order; zeros where a code is missing."""
    short = compact(nodes, max_degree)
    e = short.select("node_id", F.posexplode("neighbors").alias("pos", "dst")).join(codes.select(F.col("node_id").alias("dst"), "codes"), "dst", "left")
    width = codes.select(F.max(F.size("codes"))).first()[0] or 0
    zero = F.array_repeat(F.lit(0).cast("smallint"), width)
    lists = e.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("codes", zero).alias("c")))).alias("x"))
    rows = base.select("node_id", "embedding").join(short, "node_id", "left").join(lists, "node_id", "left")
    return rows.select("node_id", "embedding", F.coalesce("neighbors", F.array().cast("array<long>")).alias("neighbors"), F.coalesce(F.col("x.c"), F.array().cast("array<array<smallint>>")).alias("neighbor_codes"))


def read_records(ids: DataFrame, records: DataFrame) -> DataFrame:
    """Stored records of listed ids (pos, node_id): the vector, its neighbours and their
    codes, each neighbour with its code, and whether the id is there."""
    return batch_lookup(ids, records, ["embedding", "neighbors", "neighbor_codes"])


def unpack_record(records: DataFrame) -> DataFrame:
    """(node_id, pos, neighbor, code): a record's neighbours one by one; the code is empty
    where none was stored."""
    both = records.select("node_id", F.posexplode(F.arrays_zip("neighbors", "neighbor_codes")).alias("pos", "x"))
    return both.select("node_id", "pos", F.col("x.neighbors").alias("neighbor"), F.col("x.neighbor_codes").alias("code"))


def graph_report(nodes: DataFrame, base: DataFrame, max_degree: int, entry: int | None = None) -> DataFrame:
    """One row of a graph's contract: nodes, rows without a list (missing), lists that are
    too long (over), edges to themselves, repeated or to unknown ids, and nodes that
    can't be reached from the entry (the medoid)."""
    e = edges(nodes)
    known = base.select("node_id")
    if entry is None:
        first = medoid(base).first()
        entry = first.node_id if first else None
    folder = scratch_dir(base.sparkSession, "reach")
    links = written(e.where("src <> dst").distinct(), f"{folder}/links")
    seen = front = written(known.where(F.col("node_id") == entry).distinct(), f"{folder}/seen-0")
    step = 0
    while not front.isEmpty():
        step += 1
        reached = links.join(front.withColumnRenamed("node_id", "src"), "src").select(F.col("dst").alias("node_id")).distinct().join(known, "node_id", "left_semi")
        front = written(reached.join(seen, "node_id", "left_anti"), f"{folder}/front-{step}")
        seen = written(seen.unionByName(front), f"{folder}/seen-{step}")
    one = F.count(F.lit(1))
    lists = nodes.agg(
        one.alias("nodes"), F.count_if(F.size("neighbors") > max_degree).alias("over"), F.count_if(F.size("neighbors") > F.size(F.array_distinct("neighbors"))).alias("repeated"),
        F.coalesce(F.sum(F.size(F.filter("neighbors", lambda n: n == F.col("node_id")))), F.lit(0)).alias("selfs"),
    )
    counts = [
        known.join(nodes, "node_id", "left_anti").agg(one.alias("missing")), e.join(known, e.dst == known.node_id, "left_anti").agg(one.alias("unknown")),
        known.join(seen, "node_id", "left_anti").agg(one.alias("unreached")),
    ]
    for c in counts:
        lists = lists.crossJoin(c)  # one row each
    return lists.select("nodes", "missing", "over", "selfs", "repeated", "unknown", "unreached")
