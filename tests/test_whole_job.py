"""Searches ask every query and miss few neighbours at any table size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ambervec.config import GraphConfig, PqConfig, SearchConfig
from ambervec.operators import exact, graph, metrics, quantize, search


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "node_id long, embedding array<float>")


def asked(base, step):
    return base.where(F.col("node_id") % step == 0).select(F.col("node_id").alias("query_id"), "embedding")


@pytest.mark.parametrize("name", ["pq_trained_search", "beam_search", "beam_search_pq", "beam_search_sharded", "search_with_delta"])
def test_every_hundredth_row_is_asked(spark, tmp_path, name):
    import __spark_entry__ as entry

    x = np.random.default_rng(1).normal(0, 1, (350, 64))
    table(spark, x).withColumnRenamed("node_id", "vec_id").withColumn("label", F.lit(0)).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = entry.queries()[name](spark, str(tmp_path)).collect()
    assert {r.query_id for r in rows} == {0, 100, 200, 300} and len(rows) == 40


def test_dealt_index_loses_no_edges(spark):
    x = np.random.default_rng(2).normal(0, 1, (1200, 16))
    base = table(spark, x)
    nodes = spark.createDataFrame(graph.build_graph(base, GraphConfig(max_degree=16, candidates=40)).collect(), graph.NODES)
    q = asked(base, 40)
    truth = exact.exact_knn(base, q, 10).cache()
    for shards in (2, 5, 10):
        found = search.beam_search(base, nodes, q, SearchConfig(10, 50), shards=shards).cache()
        assert found.count() == 300
        assert metrics.recall_micro(found, truth, 10).first().recall >= 0.9, shards
    book = quantize.train_codebook(base, PqConfig(4, 16, 10))
    found = search.beam_search(base, nodes, q, SearchConfig(10, 50), codes=quantize.encode(base, book), codebook=book, shards=5)
    assert metrics.recall_micro(found, truth, 10).first().recall >= 0.85


@pytest.mark.parametrize("spread", [0.4, None])
def test_cells_keep_the_candidates_and_the_recall(spark, spread):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (1000, 32)) if spread is None else rng.normal(0, 1, (10, 32))[rng.integers(0, 10, 1000)] + rng.normal(0, spread, (1000, 32))
    base = table(spark, x)
    conf = GraphConfig(max_degree=16, candidates=20)
    exactly = {(r.src, r.dst) for r in graph.knn_graph(base, 20).collect()}
    near = {(r.src, r.dst) for r in graph.near_candidates(base, conf, 100, 20).collect()}
    assert len(near & exactly) >= 0.9 * len(exactly)
    if spread is None:
        assert sum((r.src, r.dst) in exactly for r in graph.cell_knn(base, 20, 50).collect()) < 0.9 * len(exactly)
        nodes = graph.build_graph(base, conf, exact_rows=100, cell_rows=20)
        q = asked(base, 20)
        assert metrics.recall_micro(search.beam_search(base, nodes, q, SearchConfig(10, 50)), exact.exact_knn(base, q, 10), 10).first().recall >= 0.9


@pytest.mark.parametrize("shards", [1, 4])
def test_replaced_and_deleted_rows_leave_k_results(spark, shards):
    """However many near rows were written again or deleted, the k best of what is left come."""
    x = np.random.default_rng(5).normal(0, 1, (400, 8))
    base = table(spark, x)
    nodes = spark.createDataFrame(graph.build_graph(base, GraphConfig(max_degree=16, candidates=40)).collect(), graph.NODES)
    q = asked(base, 50)
    near = [r.node_id for r in exact.exact_knn(base, q, 9).select("node_id").distinct().collect()]
    for away, fresh in ((near, x[near] + 50), (near[: len(near) // 2], x[near[: len(near) // 2]]), ([], x[:0])):
        delta = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in zip(away[::2], fresh[::2])], "node_id long, embedding array<float>")
        deleted = spark.createDataFrame([(i,) for i in away[1::2]], "node_id long")
        left = base.join(spark.createDataFrame([(i,) for i in away], "node_id long"), "node_id", "left_anti").unionByName(delta)
        truth = exact.exact_knn(left, q, 10).cache()
        found = search.search_with_delta(base, nodes, delta, q, SearchConfig(10, 60), deleted, shards=shards).cache()
        assert found.count() == truth.count() == 80
        assert not {r.node_id for r in found.collect()} & set(away[1::2])
        assert metrics.recall_micro(found, truth, 10).first().recall >= 0.95


def dense_group(spark):
    """400 rows and a group of 40 near the mean, and their graph of 6 nearest: no edge leaves the group."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 1, (400, 16)), rng.normal(0, 0.01, (40, 16))])
    base = table(spark, x)
    near = graph.knn_graph(base, 6).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rk", "dst")))["dst"].alias("neighbors"))
    nodes = spark.createDataFrame(near.withColumnRenamed("src", "node_id").collect(), graph.NODES)
    assert graph.medoid(base).first().node_id >= 400
    return x, base, nodes


def test_beams_leave_a_dense_group(spark):
    x, base, nodes = dense_group(spark)
    q = asked(base, 25)
    truth = exact.exact_knn(base, q, 10).cache()
    found = search.beam_search(base, nodes, q, SearchConfig(10, 10))
    assert metrics.recall_micro(found, truth, 10).first().recall >= 0.9
    narrow = search.beam_search(base, nodes, q, SearchConfig(10, 10), least=0)  # the width that was asked for is not enough
    assert metrics.recall_micro(narrow, truth, 10).first().recall < 0.9


def test_inserted_rows_meet_rows_outside_a_dense_group(spark):
    x, base, nodes = dense_group(spark)
    fresh = spark.createDataFrame([(1000 + i, [float(v) for v in x[i] + 0.01]) for i in range(0, 400, 40)], "node_id long, embedding array<float>")
    grown = graph.insert_nodes(nodes, base, fresh, GraphConfig(max_degree=8, candidates=20), shards=1)
    lists = {r.node_id: r.neighbors for r in grown.where("node_id >= 1000").collect()}
    assert len(lists) == 10 and all(i - 1000 in near for i, near in lists.items())


def test_many_copies_of_a_vector_stay_in_the_graph(spark):
    """60 rows of one vector and 12 of another, more than there are candidates; some of them inserted."""
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (300, 16)).astype(np.float32)
    x[rng.permutation(300)[:60]] = x[7]
    x[290:] = x[289]
    base = table(spark, x)
    old, fresh = base.where("node_id % 10 <> 0"), base.where("node_id % 10 = 0")
    conf = GraphConfig(max_degree=16, candidates=20)
    built = spark.createDataFrame(graph.build_graph(old, conf).collect(), graph.NODES)
    grown = spark.createDataFrame(graph.insert_nodes(built, old, fresh, conf, shards=1).collect(), graph.NODES)
    for nodes, n in ((built, 270), (grown, 300)):
        lists = {r.node_id: r.neighbors for r in nodes.collect()}
        assert len(lists) == n and all(len(set(near) - {i}) == len(near) <= 16 for i, near in lists.items())
        seen = todo = {graph.medoid(old).first().node_id}
        while todo:
            todo = {j for i in todo for j in lists[i]} - seen
            seen = seen | todo
        assert seen == set(lists)
    q = asked(base, 3)
    found = search.beam_search(base, grown, q, SearchConfig(10, 20), shards=1, least=0)
    assert metrics.recall_micro(found, exact.exact_knn(base, q, 10), 10).first().recall >= 0.9


def test_measured_recall_knows_ties(spark):
    """Of more equal rows than are asked for, the least ids are the true ones."""
    x = np.random.default_rng(8).normal(0, 1, (4001, 64)).astype(np.float32)
    x[1::2] = x[1]
    index = search._Index(np.arange(4001), x, np.arange(4002), (np.arange(4001) + 1) % 4001, 0)
    norms = np.einsum("ij,ij->i", x, x)
    for i in range(1, 40, 2):
        assert index.nearest(x[i] + np.float64(0.001) * x[i + 1], 10, norms) == set(range(1, 21, 2))
    assert len(index.nearest(x[0], 4001, norms)) == 4001
