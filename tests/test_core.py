"""The vector engine against golden values, numpy and plain Python models."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ambervec.config import CacheConfig, EngineConfig, GraphConfig, LogConfig, PqConfig, SearchConfig
from ambervec.errors import BufferPoolFull, ErrorCode, InvalidArgument, MemoryLimitExceeded, NodeNotFound, NotInitialized, ReadError
from ambervec.functions import bloom, pq, vectors as V
from ambervec.operators import cache, exact, graph, metrics, quantize, search, writelog
from ambervec.sources import generate, vecs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def vec(*x):
    return F.array(*(F.lit(float(v)).cast("float") for v in x))


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], "node_id long, embedding array<float>")


def asked(df):
    return df.withColumnRenamed("node_id", "query_id")


@pytest.fixture(scope="module")
def data():
    return np.random.default_rng(42).normal(0, 1, (150, 16)).astype(np.float32)


def test_distances(spark):
    a, b = vec(1, 2, 3), vec(4, 5, 6)
    assert one(spark, V.l2_distance(a, b)) == pytest.approx(5.196152, abs=1e-6)
    assert one(spark, V.inner_product_distance(a, b)) == -32
    assert one(spark, V.cosine_distance(vec(1, 0, 0), vec(0, 1, 0))) == 1.0
    assert one(spark, V.cosine_distance(vec(0, 0), vec(0, 1))) == 1.0
    assert one(spark, V.normalize_l2(vec(3, 4))) == pytest.approx([0.6, 0.8])
    assert one(spark, V.normalize_l2(vec(0, 0))) == [0, 0]
    with pytest.raises(Exception, match="dimension mismatch"):
        one(spark, V.l2_distance(vec(1, 2), vec(1)))
    ramp = [0.01 * i for i in range(128)]
    assert one(spark, V.l2_squared(vec(*ramp), vec(*[x + 0.01 for x in ramp]))) == pytest.approx(128e-4, rel=1e-3)


def test_validation_and_stats(spark):
    good = table(spark, [[1, 2], [3, 4]])
    assert metrics.validate_dataset(good).first().valid
    assert metrics.validate_dataset(good.limit(0)).first().valid
    for bad in ([[1.0, float("nan")]], [[1.0], [1.0, 2.0]], [[]], [[float("inf"), 0.0]]):
        assert not metrics.validate_dataset(table(spark, bad)).first().valid
    s = metrics.dataset_stats(good).first()
    norms = [5**0.5, 5.0]
    assert (s.num_vectors, s.dimension, s.mean_value) == (2, 2, 2.5)
    assert s.std_norm == pytest.approx(np.std(norms)) and s.max_norm == pytest.approx(5)
    assert metrics.dataset_stats(good.limit(0)).first().mean_norm == 0


def test_exact_search(spark, data):
    base, q = table(spark, data), asked(table(spark, data[:7] + 0.01))
    for metric in ("l2", "ip", "cosine"):
        a = {(r.query_id, r.rk): (r.node_id, round(r.distance, 4)) for r in exact.exact_knn(base, q, 5, metric).collect()}
        b = {(r.query_id, r.rk): (r.node_id, round(r.distance, 4)) for r in exact.blocked_knn(base, q, 5, metric, 3).collect()}
        assert a == b and len(a) == 35
    d = ((data[None] - (data[:7] + 0.01)[:, None]) ** 2).sum(2)
    got = exact.exact_knn(base, q, 3).collect()
    assert all(d[r.query_id].argsort()[r.rk - 1] == r.node_id for r in got)
    assert exact.exact_knn(base, q, 0).count() == 0
    assert exact.exact_knn(base, q, 1000).count() == 7 * 150
    assert exact.exact_knn(base.limit(0), q, 3).count() == exact.exact_knn(base, q.limit(0), 3).count() == 0
    same = table(spark, [[1.0, 1.0]] * 4)
    assert [r.node_id for r in exact.exact_knn(same, asked(same.limit(1)), 3).orderBy("rk").collect()] == [0, 1, 2]
    with pytest.raises(InvalidArgument):
        exact.exact_knn(base, q, 3, "none")
    ids = spark.createDataFrame([(0, 5), (1, 999), (2, 5)], "pos long, node_id long")
    assert [(r.pos, r.found) for r in exact.batch_lookup(ids, base).orderBy("pos").collect()] == [(0, True), (1, False), (2, True)]
    far = exact.distances_to(ids, base, data[5].tolist()).orderBy("pos").collect()
    assert far[0].distance == 0 and far[1].distance is None


def test_product_quantisation(spark, data):
    base = table(spark, data)
    book = quantize.train_codebook(base, PqConfig(4, 8, 10))
    cells = {(r["sub"], r["code"]): np.array(r["centroid"]) for r in book.collect()}
    assert len(cells) == 32
    codes = {r.node_id: list(r.codes) for r in quantize.encode(base, book).collect()}
    for i in (0, 7, 149):
        for j in range(4):
            d = [((data[i, 4 * j : 4 * j + 4].astype(float) - cells[j, c]) ** 2).sum() for c in range(8)]
            assert codes[i][j] == int(np.argmin(d))
    back = {r.node_id: r.embedding for r in quantize.decode(quantize.encode(base, book), book).collect()}
    assert back[3] == pytest.approx(np.concatenate([cells[j, codes[3][j]] for j in range(4)]).tolist())
    q = asked(table(spark, data[:5]))
    adc = quantize.adc_top(quantize.encode(base, book), quantize.distance_tables(q, book), 150).collect()
    for r in adc[:50]:
        want = sum(((data[r.query_id, 4 * j : 4 * j + 4].astype(float) - cells[j, codes[r.node_id][j]]) ** 2).sum() for j in range(4))
        assert r.adc == pytest.approx(want)
    truth = exact.exact_knn(base, q, 10)
    assert metrics.recall_micro(quantize.pq_search(base, quantize.encode(base, book), book, q, 10, 150), truth, 10).first().recall == 1
    with pytest.raises(Exception, match="fewer than"):
        quantize.train_codebook(base.limit(4), PqConfig(4, 8)).collect()
    with pytest.raises(InvalidArgument):
        quantize.train_codebook(base, PqConfig(5, 8))
    assert pq.memory_bytes(10, 8, 256, 16) == {"codes": 80, "codebook": 131072, "table": 8192}
    x = np.array([[0.0], [0.0], [10.0], [10.0]])
    assert sorted(quantize.kmeans(x, 2, 5, np.random.default_rng(0)).ravel().tolist()) in ([0, 10], [0, 0], [10, 10])


def test_graph_contract(spark, data):
    base = table(spark, data)
    conf = GraphConfig(max_degree=8, candidates=30)
    nodes = graph.build_graph(base, conf).cache()
    lists = {r.node_id: r.neighbors for r in nodes.collect()}
    assert len(lists) == 150 and all(len(n) <= 8 and len(set(n)) == len(n) and i not in n for i, n in lists.items())
    entry = graph.medoid(base).first().node_id
    assert entry == int(((data - data.mean(0)) ** 2).sum(1).argmin())
    seen, todo = {entry}, [entry]
    while todo:
        todo = [n for i in todo for n in lists[i] if n not in seen and not seen.add(n)]
    assert len(seen) >= 148
    q = asked(table(spark, data[:20] + 0.01))
    truth = exact.exact_knn(base, q, 10)
    found = search.beam_search(base, nodes, q, SearchConfig(10, 50))
    assert metrics.recall_micro(found, truth, 10).first().recall >= 0.9
    book = quantize.train_codebook(base, PqConfig(4, 16, 10))
    found = search.beam_search(base, nodes, q, SearchConfig(10, 50), codes=quantize.encode(base, book), codebook=book)
    assert metrics.recall_micro(found, truth, 10).first().recall >= 0.85
    found = search.beam_search(base, nodes, q, SearchConfig(10, 50), shards=3)
    assert metrics.recall_micro(found, truth, 10).first().recall >= 0.7
    fresh = table(spark, data[:10] + 5, 1000)
    grown = graph.insert_nodes(nodes, base, fresh, conf)
    lists = {r.node_id: r.neighbors for r in grown.collect()}
    assert len(lists) == 160 and all(0 < len(n) <= 8 for n in lists.values())
    both = search.search_with_delta(base, nodes, fresh, asked(fresh), SearchConfig(3, 50))
    assert both.where("rk = 1 and query_id = node_id").count() == 10
    records = graph.disk_index(base, nodes, quantize.encode(base, book)).collect()
    assert all(len(r.neighbors) == len(r.neighbor_codes) for r in records)
    rnd = graph.random_graph(base, 5).collect()
    assert all(len(set(r.neighbors)) == 5 and r.node_id not in r.neighbors for r in rnd)


def test_cells_give_good_candidates(spark, data):
    base = table(spark, data)
    exactly = {(r.src, r.dst) for r in graph.knn_graph(base, 5).collect()}
    near = {(r.src, r.dst) for r in graph.cell_knn(base, 5, 4, 3, 16).collect()}
    assert len(near) == 750 and len(near & exactly) > 0.8 * len(exactly)
    assert graph.build_graph(base, GraphConfig(candidates=20), exact_rows=10).count() == 150


def test_prune_rules():
    d = np.array([1.0, 1.1, 4.0])
    cross = np.array([[0, 0.01, 9], [0.01, 0, 9], [9, 9, 0]], float)
    assert graph.prune_order(d, cross, 3, 1.2, "strict") == [0, 2]
    assert graph.prune_order(d, cross, 3, 1.2, "distance") == [0, 2]
    assert graph.prune_order(d, cross, 3, 1.2, "fill") == [0, 2, 1]
    assert graph.prune_order(d, cross, 1, 1.2, "fill") == [0]


def test_graph_primitives(spark):
    df = spark.createDataFrame([(1, [2, 3])], "node_id long, neighbors array<long>")
    n = F.col("neighbors")
    assert df.select(graph.add_neighbor(n, 4, 3).alias("x")).first().x == [2, 3, 4]
    assert df.select(graph.add_neighbor(n, 3, 3).alias("x")).first().x == [2, 3]
    assert df.select(graph.add_neighbor(n, 4, 2).alias("x")).first().x == [2, 3]
    assert df.select(graph.remove_neighbor(n, 3).alias("x")).first().x == [2]


@pytest.mark.parametrize("degrees, want", [([0, 0, 1, 1, 2, 3, 5, 8, 10, 15], 10), ([], 1), ([0] * 4, 1), ([1] * 50 + [3] * 25 + [8] * 25, 8)])
def test_hub_threshold(spark, degrees, want):
    df = spark.createDataFrame(list(enumerate(degrees)), "node_id long, in_degree long")
    assert graph.hub_threshold(df).first().threshold == want
    c = cache.TwoQueueCache()
    c.update_hub_threshold(degrees)
    assert c.hub_threshold == want


def test_bloom(spark):
    ids = spark.createDataFrame([(i,) for i in (0, 100, 200, 300, 400, 500)], "node_id long")
    f = ids.agg(bloom.bloom_agg("node_id").alias("bloom"))
    probe = spark.range(600, 1600).select(F.col("id").alias("node_id")).crossJoin(f)
    assert probe.where(bloom.might_contain("bloom", "node_id")).count() == 6
    assert ids.crossJoin(f).where(bloom.might_contain("bloom", "node_id")).count() == 6
    assert one(spark, bloom.might_contain(F.array().cast("array<long>"), F.lit(5)))


def test_page_checksum(spark):
    page = bytes(random.Random(1).randrange(256) for _ in range(4096))
    s1 = s2 = 0
    for b in page[:4092]:
        s1 = (s1 + b) % 255
        s2 = (s2 + s1) % 255
    df = spark.createDataFrame([(bytearray(page),), (bytearray(b"abc"),), (None,)], "p binary")
    assert df.select(bloom.page_checksum("p").alias("c")).collect()[0].c == s2 << 8 | s1
    signed = df.where("p is not null").select(bloom.with_checksum("p").alias("p"))
    assert signed.where(F.length("p") == 4096).count() == 2
    assert signed.where(bloom.checksum_holds("p")).count() == 2
    assert df.where("length(p) = 4096").where(bloom.checksum_holds("p")).count() == 0


LOG = "node_id long, embedding array<float>, ts timestamp, seq long, is_deleted boolean"


def log_rows(n=200, seed=0):
    import datetime as dt

    rng = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    return [(rng.randrange(30), [float(k)], t0 + dt.timedelta(seconds=rng.randrange(50)), k, rng.random() < 0.25) for k in range(n)]


def model_of(rows):
    state = {}
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        state[r[0]] = r
    return state


def test_latest_wins_in_any_order(spark):
    rows = log_rows()
    want = model_of(rows)
    for seed in range(3):
        shuffled = rows[:]
        random.Random(seed).shuffle(shuffled)
        df = spark.createDataFrame(shuffled, LOG).repartition(seed + 1)
        assert {r.node_id: r.seq for r in writelog.latest(df).collect()} == {k: r[3] for k, r in want.items()}
        assert {r.node_id for r in writelog.live(df).collect()} == {k for k, r in want.items() if not r[4]}
        assert {r.node_id for r in writelog.tombstones(df).collect()} == {k for k, r in want.items() if r[4]}
    gone = next(k for k, r in want.items() if r[4])
    assert writelog.contains(df, gone) and writelog.get(df, gone).count() == 0 and not writelog.contains(df, 999)
    assert writelog.in_range(df, 3, 5).count() == sum(3 <= r[0] <= 5 for r in rows)
    with pytest.raises(MemoryLimitExceeded):
        writelog.check_capacity(11, 10)


def test_ids_follow_the_log(spark):
    df = spark.createDataFrame(log_rows(90, 4), LOG).drop("node_id")
    got = writelog.with_ids(df, 100).orderBy("node_id").collect()
    assert [r.node_id for r in got] == list(range(100, 190)) and [(r.ts, r.seq) for r in got] == sorted((r.ts, r.seq) for r in got)


def test_segments_and_compaction(spark):
    rows = log_rows(200)
    df = spark.createDataFrame(rows, LOG)
    seg = writelog.segmented(df, 50).withColumn("level", F.lit(0))
    m = writelog.manifest(seg)
    assert {r.segment_id: r.num_entries for r in m.collect()} == {k: 50 for k in range(4)}
    ids = spark.range(40).select(F.col("id").alias("node_id"))
    want = {k: r[3] for k, r in model_of(rows).items() if not r[4]}
    assert {r.node_id: r.seq for r in writelog.segment_lookup(ids, m, seg).collect()} == want
    two = writelog.size_tiered_choice(m, 0, LogConfig(most_tables=2))
    part = writelog.compact(seg, m, two, 0, 9)
    assert {r.node_id: r.seq for r in writelog.live(part.select("node_id", "embedding", "ts", "seq", "is_deleted")).collect()} == want
    assert part.where("segment_id = 9 and is_deleted").count() > 0
    full = writelog.compact(seg, m, m.select("segment_id"), 0, 9)
    assert {r.node_id: r.seq for r in full.collect()} == want and full.where("level <> 1").count() == 0
    assert writelog.size_tiered_choice(m.where("segment_id = 0"), 0).count() == 0
    assert writelog.level_tiered_choice(m, LogConfig(level_bytes=1000)) == 0
    assert writelog.level_tiered_choice(m) is None
    pos = writelog.sparse_index(seg, every=16).collect()
    assert sorted({r.pos for r in pos}) == [0, 16, 32, 48] and {r.offset for r in pos if r.pos == 16} == {16 + 16 * 521}
    stats = {r.segment_id: r for r in writelog.segment_stats(seg).collect()}
    own = [r for r in rows if r[3] // 50 == 1 and not r[4]]
    assert stats[1].rms_norm == pytest.approx((sum(r[1][0] ** 2 for r in own) / len(own)) ** 0.5)
    assert all(r.valid for r in writelog.valid_segment(seg).collect())


def test_log_table_and_stream(spark, tmp_path):
    from ambervec.streaming.ingest import ingest, read_log_files

    rows = log_rows(120, 3)
    spark.createDataFrame(rows, LOG).repartition(6).write.parquet(f"{tmp_path}/in")
    log = writelog.LogTable(spark, f"file://{tmp_path}/log", LogConfig(rows_per_segment=10))
    assert log.view().count() == 0 and log.next_id() == 0
    q = ingest(read_log_files(spark, f"{tmp_path}/in", 1), log, f"{tmp_path}/ck", compact_every=2)
    q.awaitTermination()
    want = {k: r[3] for k, r in model_of(rows).items() if not r[4]}
    assert {r.node_id: r.seq for r in log.view().collect()} == want
    before = log.manifest().count()
    log.compact()
    assert {r.node_id: r.seq for r in log.view().collect()} == want and log.manifest().count() <= before


def test_compactions_and_batches_never_share_a_segment(spark, tmp_path):
    """Two compactions in a row, then another batch: no row is overwritten."""
    import datetime as dt

    log = writelog.LogTable(spark, f"{tmp_path}/log", LogConfig(tables_to_compact=2, most_tables=2))
    t0 = dt.datetime(2024, 1, 1)
    for batch in range(8):
        log.append(spark.createDataFrame([(batch, [1.0], t0, batch, False)], LOG), batch * 2)
        if batch in (3, 5):
            made = [log.compact(), log.compact()]
            assert all(m is None or m % 2 for m in made) and made[0] is not None
    assert {r.node_id for r in log.view().collect()} == set(range(8))
    assert log.next_id() % 2 == 0 and log.next_id(True) % 2 == 1
    one = log.manifest().first().segment_id
    assert log.drop(one) and not log.drop(one) and one not in {r.segment_id for r in log.manifest().collect()}


def test_compactor(spark, tmp_path):
    import datetime as dt
    import time

    log = writelog.LogTable(spark, f"{tmp_path}/log", LogConfig(tables_to_compact=2, most_tables=4))
    rows = lambda k: spark.createDataFrame([(k, [float(k)], dt.datetime(2024, 1, 1), k, False)], LOG)
    for k in range(3):
        log.append(rows(k), k * 2)
    made: list[int] = []
    c = writelog.Compactor(log, every_s=0.05, on_done=made.append, bytes_per_s=1e9)
    assert c.pending() == 3 and not c.running
    c.pause()
    c.start()
    time.sleep(0.3)
    assert c.running and c.paused and not made
    c.resume()
    until = time.time() + 60
    while not made and time.time() < until:
        time.sleep(0.1)
    c.stop()
    assert not c.running and c.error is None and c.done == len(made) >= 1 and c.pending() == 0
    assert {r.node_id for r in log.view().collect()} == {0, 1, 2}


def test_cache_policy(spark):
    c = cache.TwoQueueCache(CacheConfig(10, 0.3, hub_threshold=50), {0: 100, 1: 2, 2: 1, 3: 1, 4: 1})
    for p in range(10):
        assert c.access(p) == (False, None)
    for p in range(3):
        assert c.access(p)[0]
    assert list(c.hot) == [2, 1, 0] and len(c) == 10
    hit, gone = c.access(100)
    assert not hit and gone == 2 and 0 in c  # the least in-degree goes, the hub stays
    assert c.access(200)[1] == 3  # the hot queue has room: the oldest warm page goes
    for p in list(c.hot) + list(c.warm):
        c.pin(p)
    with pytest.raises(BufferPoolFull):
        c.access(300)
    c.unpin_all()
    assert c.access(301)[1] is not None and 0 < c.hit_rate() < 1
    rng = random.Random(2)
    trace = [(k, rng.randrange(40), rng.randrange(5)) for k in range(500)]
    out = cache.simulate(spark.createDataFrame(trace, "seq long, page_id long, in_degree int").repartition(3), CacheConfig(12)).orderBy("seq").collect()
    model = cache.TwoQueueCache(CacheConfig(12))
    for (_, p, n), r in zip(trace, out):
        model.update_in_degree(p, n)
        assert model.access(p) == (r.hit, r.evicted)


def test_recall_and_percentiles(spark):
    truth = spark.createDataFrame([(0, k + 1, k) for k in range(4)] + [(1, 1, 9)], "query_id long, rk int, node_id long")
    found = spark.createDataFrame([(0, 1, 0), (0, 2, 2), (0, 3, 77), (1, 1, 9)], "query_id long, rk int, node_id long")
    assert metrics.recall_micro(found, truth, 4).first().recall == pytest.approx(3 / 5)
    assert metrics.recall_macro(found, truth, 4).first().recall == pytest.approx((2 / 4 + 1 / 4) / 2)
    assert metrics.recall_micro(found, truth.limit(0), 4).first().recall == 0
    with pytest.raises(InvalidArgument):
        metrics.recall_strict(found, truth.where("query_id = 0"), 4)
    cut, ok = metrics.applicable_truth(truth, 3, 2)
    assert ok and cut.count() == 2
    x = [5.0, 1.0, 3.0, 3.0, 9.0, 7.0, 2.0]
    r = metrics.percentiles(spark.createDataFrame([(v,) for v in x], "v double"), "v", [50, 99, 0]).first()
    s = sorted(x)
    assert (r.p50, r.p99, r.p0) == (s[min(7 * 50 // 100, 6)], s[min(7 * 99 // 100, 6)], s[0])
    by = metrics.percentiles(spark.createDataFrame([(i % 2, float(i)) for i in range(400)], "g int, v double"), "v", [50], "g").orderBy("g").collect()
    assert [r.p50 for r in by] == [200.0, 201.0]
    assert metrics.cache_pages(10_000, 128, 864_000) == 39
    by = metrics.percentiles(spark.createDataFrame([(i % 2, float(i)) for i in range(400)], "g int, v double"), "v", [50], "g").orderBy("g").collect()
    assert [r.p50 for r in by] == [200.0, 201.0]
    assert metrics.cache_pages(10_000, 128, 1 << 40) == 20
    assert one(spark, metrics.within_memory_limits(15, 100)) and not one(spark, metrics.within_memory_limits(21, 100))


def test_vecs_files(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(25, 6)).astype(np.float32)
    vecs.write_vecs(x, f"{tmp_path}/a.fvecs")
    got = vecs.read_fvecs(spark, f"{tmp_path}/a.fvecs").orderBy("node_id").collect()
    assert np.allclose([r.embedding for r in got], x) and [r.node_id for r in got] == list(range(25))
    assert vecs.read_fvecs(spark, f"{tmp_path}/a.fvecs", 4).count() == 4
    s = vecs.vecs_stats(spark, f"{tmp_path}/a.fvecs").first()
    assert (s.vectors, s.dimension) == (25, 6)
    vecs.write_vecs([[1, 2], [3], []], f"{tmp_path}/t.ivecs", True)
    assert [r.ids for r in vecs.read_ivecs(spark, f"{tmp_path}/t.ivecs").orderBy("node_id").collect()] == [[1, 2], [3], []]
    assert {(r.query_id, r.rk, r.node_id) for r in vecs.read_ground_truth(spark, f"{tmp_path}/t.ivecs").collect()} == {(0, 1, 1), (0, 2, 2), (1, 1, 3)}
    (tmp_path / "bad.fvecs").write_bytes(np.int32(99999).tobytes() + b"1234")
    (tmp_path / "cut.fvecs").write_bytes(np.int32(3).tobytes() + b"1234")
    for name in ("bad", "cut"):
        with pytest.raises(Exception):
            vecs.read_fvecs(spark, f"{tmp_path}/{name}.fvecs").count()
        assert vecs.read_or_empty(spark, f"{tmp_path}/{name}.fvecs").count() == 0
    with pytest.raises((ReadError, Exception)):
        vecs.read_fvecs(spark, f"{tmp_path}/none.fvecs").count()


def test_folders(spark, tmp_path):
    from ambervec.sources import files

    d = f"file://{tmp_path}/log"
    assert files.list_segments(spark, d) == [] and files.directory_size(spark, d) == 0 and not files.exists(spark, d)
    log = writelog.LogTable(spark, d)
    for k in (3, 1):
        log.append(spark.createDataFrame(log_rows(20), LOG), k)
    assert files.list_segments(spark, d) == [1, 3] and files.directory_size(spark, d) > 0
    assert files.file_sizes(spark, d).where("path like '%.parquet'").agg(F.sum("length")).first()[0] <= files.directory_size(spark, d)
    files.ensure_directory(spark, f"{d}/segment=3/_temporary/0")
    assert files.remove_stale(spark, d, -10) == 1 and files.list_segments(spark, d) == [1, 3]
    with pytest.raises(ReadError):
        files.file_size(spark, f"{d}/none")


def test_generators(spark):
    a = generate.random_vectors(spark, 100, 8)
    assert a.count() == 100 and a.select(V.norm("embedding").alias("n")).where("abs(n - 1) > 1e-5").count() == 0
    assert sorted(map(str, a.collect())) == sorted(map(str, generate.random_vectors(spark, 100, 8).collect()))
    assert generate.clustered_vectors(spark, 50, 8, 3).count() == 50
    base = generate.benchmark_vectors(spark, 300, 8)
    assert base.count() == 300 and generate.benchmark_queries(base, 20, 8).count() == 20
    q = generate.perturbed_queries(base, 10, 8)
    assert exact.exact_knn(base, q, 1).where("distance < 0.2").count() == 10
    assert generate.file_or_synthetic(spark, "/nowhere.fvecs", 120, 4).count() == 120


def test_engine(spark, tmp_path, data):
    from ambervec.engine import create_engine, create_sift1m_engine

    conf = EngineConfig(16, graph=GraphConfig(max_degree=8, candidates=30), pq=PqConfig(4, 16, 8))
    e = create_engine(spark, f"{tmp_path}/e", conf)
    with pytest.raises(NotInitialized):
        e.build_index()
    assert e.load_dataset(table(spark, data)) == 150
    e.build_index()
    e.save()
    assert spark.read.parquet(f"{tmp_path}/e/records").count() == 150
    r = e.search(data[4].tolist(), 3)
    assert r.results[0].node_id == 4 and r.results[0].distance == pytest.approx(0, abs=1e-6) and r.error is ErrorCode.SUCCESS
    new = e.insert((data[4] + 9).tolist())
    assert new.success and new.node_id == 150
    assert e.search((data[4] + 9).tolist(), 1).results[0].node_id == 150
    e.delete_vector(4)
    assert e.search(data[4].tolist(), 1).results[0].node_id != 4
    assert not e.insert([float("nan")]).success
    assert e.get_num_vectors() == 150
    with pytest.raises(NodeNotFound):
        e.get_vector(4)
    again = create_engine(spark, f"{tmp_path}/e", conf).load()
    assert [x[0].node_id for x in again.batch_search([data[7].tolist(), (data[4] + 9).tolist()], 1)] == [7, 150]
    assert e.get_metrics()["queries"] == 3 and e.get_memory_usage()["total"] > 0
    assert create_sift1m_engine(spark, f"{tmp_path}/s").config.memory_high == 0.20
    e.shutdown()
    assert not e.is_initialized()


def test_every_query_runs_and_has_stable_columns(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    rows = entry.entry(spark).collect()
    asked_for = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id % 100 = 0").count()
    assert len(rows) == 10 * asked_for


def test_store_files(spark, tmp_path):
    """Vector files through Hadoop's file systems, by a path that plain open() can't read."""
    x = np.random.default_rng(2).normal(size=(40, 5)).astype(np.float32)
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./d", f"file://{tmp_path}")
    path = "viewfs://store/d"
    vecs.write_vecs(x, f"{path}/a.fvecs", spark=spark)
    got = vecs.read_fvecs(spark, f"{path}/a.fvecs").orderBy("node_id").collect()
    assert np.allclose([r.embedding for r in got], x) and [r.node_id for r in got] == list(range(40))
    assert vecs.read_fvecs(spark, f"{path}/a.fvecs", 7).count() == 7
    vecs.write_vecs([[1, 2], [3], []], f"{path}/t.ivecs", True, spark)
    assert [r.ids for r in vecs.read_ivecs(spark, f"{path}/t.ivecs").orderBy("node_id").collect()] == [[1, 2], [3], []]
    assert vecs.read_ground_truth(spark, f"{path}/t.ivecs").count() == 3
    (tmp_path / "bad.fvecs").write_bytes(np.int32(99999).tobytes() + b"1234")
    for name in ("bad.fvecs", "none.fvecs"):
        assert vecs.read_or_empty(spark, f"{path}/{name}").count() == 0
    with pytest.raises(InvalidArgument):
        vecs.read_fvecs(spark, f"{path}/bad.fvecs")


def test_records_and_report(spark, data):
    base = table(spark, data)
    nodes = graph.build_graph(base, GraphConfig(max_degree=8, candidates=30)).cache()
    codes = quantize.encode(base, quantize.train_codebook(base, PqConfig(4, 8, 5))).cache()
    by_id, links = ({r.node_id: list(r[1]) for r in df.collect()} for df in (codes, nodes))
    records = graph.disk_index(base, nodes, codes)
    ids = spark.createDataFrame([(0, 3), (1, 999), (2, 7)], "pos long, node_id long")
    got = graph.read_records(ids, records).orderBy("pos").collect()
    assert [r.found for r in got] == [True, False, True] and got[0].neighbors == links[3] and got[0].embedding == pytest.approx(data[3].tolist())
    flat = graph.unpack_record(records.where("node_id in (3, 7)")).collect()
    assert {(r.node_id, r.pos, r.neighbor, tuple(r.code)) for r in flat} == {(i, p, n, tuple(by_id[n])) for i in (3, 7) for p, n in enumerate(links[i])}
    ok = graph.graph_report(nodes, base, 8).first()
    assert (ok.nodes, ok.missing, ok.over, ok.selfs, ok.repeated, ok.unknown) == (150, 0, 0, 0, 0, 0) and ok.unreached <= 2
    bad = spark.createDataFrame([(0, [0, 1, 1]), (1, [0, 999])], graph.NODES)
    r = graph.graph_report(bad, base.where("node_id < 4"), 2, 0).first()
    assert tuple(r) == (2, 2, 1, 1, 1, 1, 2)


def test_encode_takes_the_first_of_equal_codes(spark):
    book = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (0, 2, [0.0, 1.0])], quantize.CODEBOOK)
    base = table(spark, [[1, 0], [0, 1], [0.5, 0.5], [0.2, 0.9]])
    assert [list(r.codes) for r in quantize.encode(base, book).orderBy("node_id").collect()] == [[0], [2], [0], [2]]


def test_adc_in_blocks_of_queries(spark, data, monkeypatch):
    base = table(spark, data)
    book = quantize.train_codebook(base, PqConfig(4, 8, 5))
    codes, tables = quantize.encode(base, book), quantize.distance_tables(asked(base.limit(30)), book)
    few = {tuple(r) for r in quantize.adc_top(codes, tables, 7).collect()}
    monkeypatch.setattr(quantize, "TABLE_BYTES", 1000)
    assert few == {tuple(r) for r in quantize.adc_top(codes, tables, 7).collect()} and len(few) == 210
    assert quantize.adc_top(codes, tables.limit(0), 7).count() == quantize.adc_top(codes.limit(0), tables, 7).count() == 0


def test_cache_calls():
    c = cache.TwoQueueCache(CacheConfig(4, 0.5))
    assert c.prefetch([1, 2, 2, 3]) == [1, 2, 3] and c.hits == c.misses == 0
    assert c.load_and_pin(1) == (True, None) and not c.evict(1) and not c.evict(9)
    assert c.unpin(1) and c.evict(1) and 1 not in c
    assert c.load_and_pin(5) == (False, None) and c.evict_one() in (2, 3)
    for p in list(c.hot) + list(c.warm):
        c.pin(p)
    assert c.prefetch([7, 8, 9, 10]) == [7, 8] or len(c) == 4
    c = cache.TwoQueueCache(CacheConfig(4, 0.5))
    assert not c.get(1) and c.put(1) is None and c.in_warm(1) and c.get(1) and c.in_hot(1) and not c.in_warm(1) and c.hit_rate() == 0.5
    assert c.get_and_pin(1) and c.is_pinned(1) and not c.get_and_pin(2)
    c.prefetch([2, 3, 4])
    c.update_in_degrees({2: 9, 3: 1})
    assert c.in_degree == {2: 9, 3: 1} and c.set_capacity(2) == [2, 3] and len(c) == 2 and 1 in c


def test_temp_files(spark, tmp_path):
    from ambervec.sources import files

    place = f"{tmp_path}/t"
    with pytest.raises(ReadError):
        files.commit_temp(spark, files.temp_path(place), place)
    for n in (3, 5):
        temp = files.temp_path(place)
        spark.range(n).write.parquet(temp)
        files.commit_temp(spark, temp, place)
        assert spark.read.parquet(place).count() == n and not files.exists(spark, temp)
    spark.range(1).write.parquet(files.temp_path(place))
    assert files.remove_stale(spark, str(tmp_path), -10) == 1 and files.delete_path(spark, place) and not files.delete_path(spark, place)


def test_writes_go_into_the_graph(spark, tmp_path, data):
    from ambervec.engine import create_engine

    e = create_engine(spark, f"{tmp_path}/e", EngineConfig(16, graph=GraphConfig(max_degree=8, candidates=30), pq=PqConfig(4, 16, 8)))
    assert e.graph_stats() == {"nodes": 0, "edges": 0, "max_degree": 0, "entry": None} and not e.is_built()
    e.load_dataset(table(spark, data))
    e.build_index()
    for i in range(5):
        e.insert_with_id(200 + i, (data[i] + 7).tolist())
    e.insert_with_id(9, (data[9] - 7).tolist())
    e.delete_vector(4)
    assert e.index_writes() == 6 and e._log.rows().count() == 0 and e.get_num_vectors() == 154
    stats = e.graph_stats()
    assert stats["nodes"] == 154 and stats["max_degree"] <= 8 and e.neighbors(202) and 4 not in {n for r in e._nodes.collect() for n in r.neighbors}
    with pytest.raises(NodeNotFound):
        e.neighbors(4)
    asks = [(data[i] + 7).tolist() for i in range(5)] + [(data[9] - 7).tolist(), data[30].tolist()]
    assert [r[0].node_id for r in e.batch_search(asks, 1)] == [200, 201, 202, 203, 204, 9, 30]
    nav = e.nav_data().collect()
    assert len(nav) == 154 and sum(r.entry for r in nav) == 1 and all(r.degree == len(r.neighbors) for r in nav)
    e.search(data[3].tolist(), 2)
    assert e.get_metrics()["queries"] == 1
    e.reset_stats()
    assert e.get_metrics()["queries"] == 0
    c = e.compactor(every_s=0.05)
    assert not c.needs() and not c.compacting and c.run_once() is None


def test_queries_with_truth(spark):
    base = generate.random_vectors(spark, 80, 6)
    q, truth = generate.queries_with_truth(base, 9, 6, 3)
    assert q.count() == 9 and truth.count() == 27 and truth.where("rk = 1 and distance < 0.2").count() == 9


def test_benchmark_and_command_line(spark, tmp_path, capsys):
    """Build, search, insert and verify by the command line; a mixed load of a writer and readers."""
    import json

    from ambervec.__main__ import main
    from ambervec.engine import create_engine, run_benchmark

    out = run_benchmark(spark, f"{tmp_path}/b", n=300, dimension=16, queries=20, subspaces=4, codes=16, writes=24)
    assert out["recall"] >= 0.9 and out["read_back"] == 1 and out["found_by_graph"] >= 0.9 and out["searches_meanwhile"] >= 10 and out["writes_per_s"] > 0
    x = np.random.default_rng(3).normal(size=(300, 16)).astype(np.float32)
    vecs.write_vecs(x, f"{tmp_path}/a.fvecs")
    vecs.write_vecs(x[:5] + 9, f"{tmp_path}/new.fvecs")
    vecs.write_vecs(np.concatenate([x[10:12], x[:1] + 9]), f"{tmp_path}/q.fvecs")
    index = ["--index", f"{tmp_path}/i"]
    say = lambda *a: (main([*a]), capsys.readouterr().out)
    assert say("build", *index, "--vectors", f"{tmp_path}/a.fvecs", "--codes", "16")[0] == 0
    code, text = say("insert", *index, "--vectors", f"{tmp_path}/new.fvecs")
    assert code == 0 and json.loads(text) == {"first_id": 300, "inserted": 5}
    code, text = say("search", *index, "--queries", f"{tmp_path}/q.fvecs", "--k", "1")
    assert code == 0 and text.split("\n")[:3] == ["0: 10", "1: 11", "2: 300"]
    code, text = say("verify", *index, "--queries", f"{tmp_path}/q.fvecs")
    assert code == 0 and json.loads(text)["pass"]
    engine = create_engine(spark, f"{tmp_path}/i").load()
    assert engine.read_record(7)["embedding"] == pytest.approx(x[7].tolist()) and engine.read_record(7)["neighbors"]
    with pytest.raises(NodeNotFound):
        engine.read_record(999)
    with pytest.raises(InvalidArgument):
        engine.insert_frame(table(spark, [[1.0], [float("nan")]]))
