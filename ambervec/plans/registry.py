"""Named queries over the test tables and the SQL that must give the same rows.

Vectors are `embeddings` (vec_id as node_id). Queries are the rows whose id is
divisible by 100, against all rows; the write log is `events` (key user_id, sequence event_id, tombstone = event_type 'error'). Distances
are rounded to six digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CacheConfig, GraphConfig, PqConfig, SearchConfig
from ..functions import bloom, vectors as V
from ..operators import cache, exact, graph, metrics, quantize, search, writelog
from ..sources import generate
from ..sources.scratch import scratch_dir, written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _base(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").withColumnRenamed("vec_id", "node_id")


def _queries(base: DataFrame) -> DataFrame:
    return base.where(F.col("node_id") % 100 == 0).select(F.col("node_id").alias("query_id"), "embedding")


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("user_id").alias("node_id"), F.col("value"), F.col("ts"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("is_deleted"))


_BASE = "base AS (SELECT vec_id AS node_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_Q = "q AS (SELECT node_id AS query_id, v AS qv FROM base WHERE node_id % 100 = 0)"


def _knn(base: str = "base", k: int = 10, where: str = "true") -> str:
    return f"""(SELECT * FROM (SELECT query_id, node_id, list_distance(v, qv) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(v, qv), node_id) AS rk
      FROM {base}, q WHERE {where}) WHERE rk <= {k})"""


# ------------------------------------------------------- exact, distances


@_query(f"WITH {_BASE}, {_Q} SELECT query_id, CAST(rk AS INTEGER) AS rk, node_id, round(distance, 6) AS distance FROM {_knn()}")
def exact_knn_l2(spark, d):
    base = _base(spark, d)
    return _round(exact.exact_knn(base, _queries(base), 10), "distance")


@_query(f"WITH {_BASE}, {_Q} SELECT query_id, CAST(rk AS INTEGER) AS rk, node_id, round(distance, 6) AS distance FROM {_knn()}")
def blocked_knn_l2(spark, d):
    base = _base(spark, d)
    return _round(exact.blocked_knn(base, _queries(base), 10), "distance")


def _scaled_pairs(spark, d, metric):
    """Rescaled vectors and a zero vector, so that metrics rank differently."""
    base = _base(spark, d)
    v = base.select("node_id", F.transform("embedding", lambda x: (x.cast("double") * (1 + F.col("node_id") % 7)).cast("float")).alias("embedding"))
    zero = spark.range(1).select(F.lit(-1).cast("long").alias("node_id"), F.array_repeat(F.lit(0.0).cast("float"), 64).alias("embedding"))
    v = v.unionByName(zero)
    q = v.where("node_id % 100 = 0 or node_id = -1").select(F.col("node_id").alias("query_id"), F.col("embedding").alias("q"))
    return v.crossJoin(q).select("query_id", "node_id", (F.round(V.METRICS[metric]("embedding", "q"), 5) + 0.0).alias("distance"))


_SCALED = """WITH s AS (SELECT vec_id AS node_id, list_transform(embedding, lambda x: CAST(CAST(CAST(x AS DOUBLE) * (1 + vec_id % 7) AS FLOAT) AS DOUBLE)) AS v FROM embeddings
  UNION ALL SELECT -1, list_transform(range(64), lambda x: CAST(0 AS DOUBLE)))
  SELECT q.node_id AS query_id, s.node_id, round({}, 5) + 0.0 AS distance FROM s, s q WHERE q.node_id % 100 = 0 OR q.node_id = -1"""


@_query(_SCALED.format("list_distance(s.v, q.v)"))
def distance_l2(spark, d):
    return _scaled_pairs(spark, d, "l2")


@_query(_SCALED.format("-list_inner_product(s.v, q.v) + 0.0"))
def distance_ip(spark, d):
    return _scaled_pairs(spark, d, "ip")


@_query(_SCALED.format("CASE WHEN list_inner_product(s.v, s.v) * list_inner_product(q.v, q.v) = 0 THEN 1.0 ELSE 1 - list_inner_product(s.v, q.v) / sqrt(list_inner_product(s.v, s.v)) / sqrt(list_inner_product(q.v, q.v)) END"))
def distance_cosine(spark, d):
    return _scaled_pairs(spark, d, "cosine")


@_query(f"WITH {_BASE}, n AS (SELECT node_id, v, sqrt(list_inner_product(v, v)) AS l FROM base), e AS (SELECT node_id, unnest(range(1, len(v) + 1)) AS i, v, l FROM n) SELECT node_id, CAST(i - 1 AS INTEGER) AS pos, round(v[i] / l, 6) AS x FROM e")
def normalize_l2(spark, d):
    rows = _base(spark, d).select("node_id", V.normalize_l2("embedding").alias("v"))
    return rows.select("node_id", F.posexplode("v").alias("pos", "x")).withColumn("x", F.round("x", 6))


@_query(f"""WITH {_BASE}, n AS (SELECT node_id, len(v) AS d, sqrt(list_inner_product(v, v)) AS l, list_sum(v) AS s, list_min(v) AS a, list_max(v) AS b FROM base)
SELECT count(*) AS num_vectors, arg_min(d, node_id) AS dimension, round(avg(l), 6) AS mean_norm, round(min(l), 6) AS min_norm, round(max(l), 6) AS max_norm, round(stddev_pop(l), 6) AS std_norm,
 round(sum(s) / sum(d), 6) AS mean_value, round(min(a), 6) AS min_value, round(max(b), 6) AS max_value FROM n""")
def dataset_stats(spark, d):
    out = metrics.dataset_stats(_base(spark, d))
    return _round(out, *(c for c in out.columns if c not in ("num_vectors", "dimension"))).withColumn("dimension", F.col("dimension").cast("long"))


@_query("SELECT count(*) AS num_vectors, min(len(embedding)) = max(len(embedding)) AND bool_and(len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0) AS valid FROM embeddings")
def validate_dataset(spark, d):
    return metrics.validate_dataset(_base(spark, d))


_MEAN = "c AS (SELECT {0} list(m ORDER BY i) AS c FROM (SELECT {0} i, avg(v[i]) AS m FROM (SELECT {0} v, unnest(range(1, len(v) + 1)) AS i FROM base) GROUP BY {0} i) {1})"


@_query(f"WITH {_BASE}, {_MEAN.format('', '')} SELECT arg_min(node_id, (d2, node_id)) AS node_id, round(min(d2), 6) AS d2 FROM (SELECT node_id, list_distance(v, c) ** 2 AS d2 FROM base, c)")
def medoid(spark, d):
    return _round(graph.medoid(_base(spark, d)), "d2")


@_query(f"WITH {_BASE}, {_MEAN.format('label,', 'GROUP BY label')} SELECT label, arg_min(node_id, (d2, node_id)) AS node_id, round(min(d2), 6) AS d2 FROM (SELECT label, node_id, list_distance(v, c) ** 2 AS d2 FROM base JOIN c USING (label)) GROUP BY label")
def medoid_by_label(spark, d):
    return _round(graph.medoid(_base(spark, d), "label"), "d2")


@_query(f"WITH {_BASE} SELECT node_id, node_id * 4096 AS record_offset, node_id AS page_id, CAST(32 + 4 * len(v) + (node_id % 33) * 12 AS BIGINT) AS used_bytes, round((32 + 4 * len(v) + (node_id % 33) * 12) / 4096.0, 6) AS utilization FROM base")
def record_layout(spark, d):
    n = F.expr("array_repeat(0L, cast(node_id % 33 AS int))")
    return _base(spark, d).select("node_id", V.record_offset("node_id").alias("record_offset"), V.page_of("node_id").alias("page_id"), V.record_bytes(n, 64).cast("long").alias("used_bytes"), F.round(V.record_utilization(n, 64), 6).alias("utilization"))


# -------------------------------------------------------------------- PQ

_PQ = f"""{_BASE}, {_Q}, book AS (SELECT node_id AS code, j AS sub, v[j*8+1:j*8+8] AS c FROM base, range(8) t(j) WHERE node_id < 16),
codes AS (SELECT node_id, sub, arg_min(code, (d, code)) AS code FROM (SELECT b.node_id, k.sub, k.code, list_distance(b.v[k.sub*8+1:k.sub*8+8], k.c) AS d FROM base b, book k) GROUP BY node_id, sub),
lut AS (SELECT query_id, sub, code, list_distance(qv[sub*8+1:sub*8+8], c) ** 2 AS d FROM q, book),
adc AS (SELECT query_id, node_id, sum(d) AS adc FROM codes JOIN lut USING (sub, code) GROUP BY query_id, node_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY adc, node_id) AS rk FROM adc) WHERE rk <= 100)"""


def _fixed(spark, d):
    base = _base(spark, d)
    book = quantize.fixed_codebook(base, 8, 16)
    return base, book, quantize.encode(base, book)


@_query(f"WITH {_PQ} SELECT node_id, string_agg(CAST(code AS VARCHAR), ',' ORDER BY sub) AS codes FROM codes GROUP BY node_id")
def pq_encode(spark, d):
    return _fixed(spark, d)[2].select("node_id", F.concat_ws(",", F.col("codes").cast("array<string>")).alias("codes"))


@_query(f"WITH {_PQ} SELECT node_id, CAST(sub * 8 + i - 1 AS INTEGER) AS pos, round(c[i], 6) AS x FROM codes JOIN book USING (sub, code), range(1, 9) t(i)")
def pq_decode(spark, d):
    _, book, codes = _fixed(spark, d)
    return quantize.decode(codes, book).select("node_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.round("x", 6))


@_query(f"WITH {_PQ} SELECT query_id, sub, code, round(d, 6) AS d FROM lut")
def pq_distance_table(spark, d):
    base, book, _ = _fixed(spark, d)
    t = quantize.distance_tables(_queries(base), book).select("query_id", F.posexplode("table").alias("sub", "row"))
    return t.select("query_id", F.col("sub").cast("long").alias("sub"), F.posexplode("row").alias("code", "d")).select("query_id", "sub", F.col("code").cast("long").alias("code"), F.round("d", 6).alias("d"))


@_query(f"WITH {_PQ} SELECT query_id, CAST(rk AS INTEGER) AS rk, round(adc, 5) AS adc FROM top WHERE rk <= 10")
def pq_adc_topk(spark, d):
    base, book, codes = _fixed(spark, d)
    return quantize.adc_top(codes, quantize.distance_tables(_queries(base), book), 10).select("query_id", "rk", F.round("adc", 5).alias("adc"))


@_query(f"""WITH {_PQ}, s AS (SELECT query_id, node_id, list_distance(v, qv) AS distance FROM top JOIN base USING (node_id) JOIN q USING (query_id))
SELECT query_id, CAST(rk AS INTEGER) AS rk, node_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, node_id) AS rk FROM s) WHERE rk <= 10""")
def pq_rerank_topk(spark, d):
    base, book, codes = _fixed(spark, d)
    return _round(quantize.pq_search(base, codes, book, _queries(base), 10, 100), "distance")


@_query(f"""WITH {_PQ}, s AS (SELECT query_id, node_id, round(adc, 9) AS adc, round(list_distance(v, qv) ** 2, 9) AS d2 FROM adc JOIN base USING (node_id) JOIN q USING (query_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, node_id) AS bd, row_number() OVER (PARTITION BY query_id ORDER BY adc, node_id) AS ba FROM s),
w AS (SELECT query_id, max(d2) AS worst FROM r WHERE bd = 10 GROUP BY query_id)
SELECT query_id, count(*) AS kept, round(max(adc), 5) AS farthest FROM r JOIN w USING (query_id) WHERE adc <= 1.2 * worst OR ba <= 10 GROUP BY query_id""")
def adc_threshold_filter(spark, d):
    base, book, codes = _fixed(spark, d)
    q = _queries(base)
    adc = quantize.adc_scores(codes, quantize.distance_tables(q, book))
    both = adc.join(base.select("node_id", "embedding"), "node_id").join(q.withColumnRenamed("embedding", "q"), "query_id")
    both = both.select("query_id", "node_id", F.round("adc", 9).alias("adc"), F.round(V.l2_squared("embedding", "q"), 9).alias("d2"))
    return quantize.adc_threshold(both, 10, 1.2).groupBy("query_id").agg(F.count(F.lit(1)).alias("kept"), F.round(F.max("adc"), 5).alias("farthest"))


@_query()
def pq_trained_search(spark, d):
    base = _base(spark, d)
    book = quantize.train_codebook(base, PqConfig(16, 64, 15))
    return _round(quantize.pq_search(base, quantize.encode(base, book), book, _queries(base), 10, 200), "distance")


# ----------------------------------------------------------------- graph

_GRAPH = f"""{_BASE}, knn AS (SELECT * FROM (SELECT a.node_id AS src, b.node_id AS dst, list_distance(a.v, b.v) AS distance, row_number() OVER (PARTITION BY a.node_id ORDER BY list_distance(a.v, b.v), b.node_id) AS rk FROM base a, base b WHERE a.node_id <> b.node_id) WHERE rk <= 10),
deg AS (SELECT node_id, count(src) AS in_degree FROM base LEFT JOIN knn ON dst = node_id GROUP BY node_id),
nz AS (SELECT list(in_degree ORDER BY in_degree) AS l FROM deg WHERE in_degree > 0),
thr AS (SELECT coalesce(l[least(CAST(ceil(len(l) * 0.75) AS BIGINT), len(l) - 1) + 1], 1) AS threshold FROM nz)"""


def _knn_nodes(spark, d):
    rows = graph.knn_graph(_base(spark, d), 10)
    return rows.groupBy(F.col("src").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("rk", "dst"))).alias("x")).select("node_id", F.col("x.dst").alias("neighbors"))


@_query(f"WITH {_GRAPH} SELECT src, CAST(rk AS INTEGER) AS rk, dst, round(distance, 6) AS distance FROM knn")
def knn_graph(spark, d):
    return _round(graph.knn_graph(_base(spark, d), 10), "distance")


@_query(f"WITH {_GRAPH} SELECT node_id, in_degree FROM deg")
def in_degree(spark, d):
    return graph.in_degrees(_knn_nodes(spark, d))


@_query(f"WITH {_GRAPH} SELECT threshold FROM thr")
def hub_threshold(spark, d):
    return graph.hub_threshold(graph.in_degrees(_knn_nodes(spark, d)))


@_query(f"WITH {_GRAPH} SELECT node_id, in_degree FROM deg, thr WHERE in_degree >= threshold")
def hub_nodes(spark, d):
    return graph.hub_nodes(graph.in_degrees(_knn_nodes(spark, d)))


@_query(f"WITH {_GRAPH} SELECT DISTINCT src, dst FROM (SELECT src, dst FROM knn UNION ALL SELECT dst, src FROM knn)")
def reverse_edges(spark, d):
    return graph.reverse_edges(_knn_nodes(spark, d))


@_query(f"WITH {_GRAPH} SELECT DISTINCT dst AS node_id FROM knn WHERE src < 20 AND dst >= 20")
def next_hop(spark, d):
    nodes = _knn_nodes(spark, d)
    seen = nodes.where("node_id < 20").select("node_id")
    return graph.next_hop(seen, nodes, seen)


@_query(f"WITH {_GRAPH}, p AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY rk) AS pos FROM knn WHERE rk <= 4) SELECT src AS node_id, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY pos) AS neighbors FROM p GROUP BY src")
def graph_compact(spark, d):
    return graph.compact(_knn_nodes(spark, d), 4).select("node_id", F.concat_ws(",", F.col("neighbors").cast("array<string>")).alias("neighbors"))


def _listed(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_id", F.concat_ws(",", F.col("neighbors").cast("array<string>")).alias("neighbors"))


@_query()
def graph_build(spark, d):
    return _listed(graph.build_graph(_base(spark, d), GraphConfig(candidates=60)))


def _contract(nodes: DataFrame, base: DataFrame, most: int, recall: bool = True) -> DataFrame:
    """The graph's contract as one row; with ``recall``, whether beams over it find 90 % of
    the ten nearest of the queries."""
    folder = scratch_dir(base.sparkSession, "graph")
    nodes = written(nodes, folder)
    report = graph.graph_report(nodes, base, most).select("nodes", "missing", "over", "selfs", "repeated", "unknown")
    if not recall:
        return report
    q = _queries(base)
    found = search.beam_search(base, nodes, q, SearchConfig(10, 50))
    return report.crossJoin(metrics.recall_micro(found, exact.exact_knn(base, q, 10), 10).select((F.col("recall") >= 0.9).alias("recall_holds")))  # one row each


_CONTRACT = "SELECT count(*) AS nodes, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS over, CAST(0 AS BIGINT) AS selfs, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS unknown{} FROM embeddings"


@_query(_CONTRACT.format(", true AS recall_holds"))
def graph_build_contract(spark, d):
    base = _base(spark, d)
    return _contract(graph.build_graph(base, GraphConfig(candidates=60)), base, 16)


@_query()
def random_graph(spark, d):
    return _listed(graph.random_graph(_base(spark, d), 8))


@_query(_CONTRACT.format(""))
def random_graph_contract(spark, d):
    base = _base(spark, d)
    return _contract(graph.random_graph(base, 8), base, 8, False)


def _prune_sql(bad: str, fill: bool) -> str:
    """The greedy choice among ten neighbours in order, at most six, as a recursion over their ranks."""
    rest = "list_concat(keep, rest[1:6 - len(keep)])" if fill else "keep"
    return f"""WITH RECURSIVE {_GRAPH}, c AS (SELECT src, dst, rk, distance * distance AS d2, v FROM knn JOIN base ON dst = node_id),
x AS (SELECT a.src, a.rk AS i, list(list_distance(a.v, b.v) * list_distance(a.v, b.v) ORDER BY b.rk) AS row FROM c a JOIN c b ON a.src = b.src GROUP BY a.src, a.rk),
m AS (SELECT src, list(row ORDER BY i) AS cr FROM x GROUP BY src),
n AS (SELECT src, list(d2 ORDER BY rk) AS d, list(dst ORDER BY rk) AS ids, cr FROM c JOIN m USING (src) GROUP BY src, cr),
g AS (SELECT src, CAST(1 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS keep, CAST([] AS BIGINT[]) AS rest FROM n UNION ALL
  SELECT src, i + 1, CASE WHEN full_up OR bad THEN keep ELSE list_append(keep, i) END, CASE WHEN bad AND NOT full_up THEN list_append(rest, i) ELSE rest END
  FROM (SELECT g.src, i, keep, rest, len(keep) >= 6 AS full_up, len(list_filter(keep, lambda s: {bad})) > 0 AS bad FROM g JOIN n USING (src) WHERE i <= len(ids))),
z AS (SELECT src, ids, {rest} AS p FROM g JOIN n USING (src) WHERE i = len(ids) + 1)
SELECT src AS node_id, array_to_string(list_transform(p, lambda j: ids[j]), ',') AS neighbors FROM z"""


def _pruned(spark, d, rule):
    base = _base(spark, d)
    pairs = graph.edges(_knn_nodes(spark, d))
    return _listed(graph.robust_prune(graph._with_vectors(pairs, base), GraphConfig(max_degree=6, rule=rule)))


@_query(_prune_sql("1.2 * cr[i][s] <= d[i]", True))
def robust_prune(spark, d):
    return _pruned(spark, d, "fill")


@_query(_prune_sql("1.2 * cr[i][s] < d[i]", False))
def prune_strict(spark, d):
    return _pruned(spark, d, "strict")


@_query(_prune_sql("sqrt(cr[i][s]) < 1.2 * sqrt(d[i])", False))
def prune_by_distance(spark, d):
    return _pruned(spark, d, "distance")


@_query()
def beam_search(spark, d):
    base = _base(spark, d)
    return _round(search.beam_search(base, _knn_nodes(spark, d), _queries(base), SearchConfig(10, 50)), "distance")


@_query()
def beam_search_pq(spark, d):
    base, book, codes = _fixed(spark, d)
    return _round(search.beam_search(base, _knn_nodes(spark, d), _queries(base), SearchConfig(10, 50), codes=codes, codebook=book), "distance")


@_query()
def beam_search_sharded(spark, d):
    base = _base(spark, d)
    return _round(search.beam_search(base, _knn_nodes(spark, d), _queries(base), SearchConfig(10, 50), shards=4), "distance")


def _inserted(spark, d) -> DataFrame:
    base = _base(spark, d)
    old, new = base.where("node_id % 10 <> 0"), base.where("node_id % 10 = 0")
    nodes = written(graph.build_graph(old, GraphConfig(candidates=40)), scratch_dir(spark, "graph"))
    return graph.insert_nodes(nodes, old, new, GraphConfig(candidates=40))


@_query()
def incremental_insert(spark, d):
    return _listed(_inserted(spark, d))


@_query(_CONTRACT.format(", true AS recall_holds"))
def incremental_insert_contract(spark, d):
    return _contract(_inserted(spark, d), _base(spark, d), 16)


@_query()
def search_with_delta(spark, d):
    base = _base(spark, d)
    old, new = base.where("node_id % 5 <> 0"), base.where("node_id % 5 = 0")
    return _round(search.search_with_delta(old, graph.build_graph(old, GraphConfig(candidates=40)), new, _queries(base), SearchConfig(10, 50)), "distance")


@_query(f"""WITH {_PQ}, {_GRAPH.removeprefix(_BASE + ", ")}, s AS (SELECT node_id, string_agg(CAST(code AS VARCHAR), ' ' ORDER BY sub) AS code FROM codes GROUP BY node_id)
SELECT src AS node_id, round(any_value(v[1]), 6) AS first, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY rk) AS neighbors, string_agg(s.code, ',' ORDER BY rk) AS codes
FROM knn JOIN s ON dst = s.node_id JOIN base ON src = base.node_id GROUP BY src""")
def disk_index(spark, d):
    """Records written, read back by id and unpacked."""
    base, _, codes = _fixed(spark, d)
    records = written(graph.disk_index(base, _knn_nodes(spark, d), codes), scratch_dir(spark, "records"))
    ids = base.select(F.col("node_id").alias("pos"), "node_id")
    read = graph.read_records(ids, records)
    code = F.transform("neighbor_codes", lambda c: F.array_join(c.cast("array<string>"), " "))
    return read.select("node_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"), F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"), F.array_join(code, ",").alias("codes"))


@_query(f"WITH {_BASE}, {_Q} SELECT query_id, CAST(rk AS INTEGER) AS rk, node_id, round(distance, 6) AS distance FROM {_knn()}")
def delta_merge_knn(spark, d):
    base = _base(spark, d)
    return _round(exact.merged_knn(base.where("node_id % 5 <> 0"), base.where("node_id % 5 = 0"), _queries(base), 10), "distance")


@_query(f"WITH {_BASE}, ids AS (SELECT i AS pos, i * 7 % 600 AS node_id FROM range(100) t(i)) SELECT pos, ids.node_id, round(base.v[1], 6) AS first, base.node_id IS NOT NULL AS found FROM ids LEFT JOIN base USING (node_id)")
def batch_lookup(spark, d):
    ids = spark.range(100).select(F.col("id").alias("pos"), (F.col("id") * 7 % 600).alias("node_id"))
    return exact.batch_lookup(ids, _base(spark, d), ["embedding"]).select("pos", "node_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"), "found")


# --------------------------------------------------------------- metrics

_FOUND = f"{_PQ}, f AS (SELECT * FROM (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, node_id) AS rk FROM (SELECT query_id, node_id, list_distance(v, qv) AS distance FROM top JOIN base USING (node_id) JOIN q USING (query_id))) WHERE rk <= 10), t AS (SELECT * FROM {_knn()}), h AS (SELECT t.query_id, count(f.node_id) AS hits, count(*) AS n FROM t LEFT JOIN f ON t.query_id = f.query_id AND t.node_id = f.node_id GROUP BY t.query_id)"


def _recall(spark, d, f):
    base, book, codes = _fixed(spark, d)
    q = _queries(base)
    return f(quantize.pq_search(base, codes, book, q, 10, 100), exact.exact_knn(base, q, 10), 10).select(F.round("recall", 6).alias("recall"))


@_query(f"WITH {_FOUND} SELECT round(sum(hits) / sum(n), 6) AS recall FROM h")
def recall_micro(spark, d):
    return _recall(spark, d, metrics.recall_micro)


@_query(f"WITH {_FOUND} SELECT round(avg(hits / 10.0), 6) AS recall FROM h")
def recall_macro(spark, d):
    return _recall(spark, d, metrics.recall_macro)


_SEARCHES = ("beam_search", "beam_search_pq", "beam_search_sharded", "pq_trained_search", "search_with_delta")


@_query(f"SELECT m AS method, count(*) AS queries, count(*) * 10 AS found, true AS recall_holds FROM embeddings, (SELECT unnest({list(_SEARCHES)}) AS m) WHERE vec_id % 100 = 0 GROUP BY m")
def search_recall(spark, d):
    """Whether each approximate search finds 90 % of the ten nearest of all queries."""
    base = _base(spark, d)
    truth, out = exact.exact_knn(base, _queries(base), 10), None
    for name in _SEARCHES:
        found = written(QUERIES[name](spark, d), scratch_dir(spark, name))
        row = found.agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("found"))
        row = row.crossJoin(metrics.recall_micro(found, truth, 10)).select(F.lit(name).alias("method"), "queries", "found", (F.col("recall") >= 0.9).alias("recall_holds"))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


@_query("WITH s AS (SELECT list(value ORDER BY value) AS l FROM events WHERE value IS NOT NULL) SELECT CAST(len(l) AS BIGINT) AS n, " + ", ".join(f"l[least(CAST(floor(len(l) * {p} / 100) AS BIGINT), len(l) - 1) + 1] AS p{str(p).replace('.', '_')}" for p in (50, 95, 99, 99.9)) + " FROM s")
def latency_percentiles(spark, d):
    return metrics.percentiles(spark.read.parquet(f"{d}/events.parquet"), "value", [50, 95, 99, 99.9])


@_query("""WITH n AS (SELECT count(*) AS n FROM embeddings), p AS (SELECT n, n * 8 AS codes, 16 * 64 * 4 AS codebook, n * 129 AS graph, CAST(ceil(n / 8.0) AS BIGINT) AS visited, n * 256 AS vectors FROM n),
f AS (SELECT *, codes + codebook + graph + visited AS fixed FROM p),
c AS (SELECT *, greatest(20, least(greatest(0, CAST(floor(vectors * 0.2) AS BIGINT) - fixed) // 4096, n // 10)) * 4096 AS cache FROM f)
SELECT n, codes, codebook, graph, visited, cache, fixed + cache AS total, vectors, round((fixed + cache) / CAST(vectors AS DOUBLE), 6) AS ratio FROM c""")
def memory_report(spark, d):
    n = _base(spark, d).count()
    fixed = metrics.memory_report(n, 64, 16, 8, 16, 0)["total"]
    report = {"n": n} | metrics.memory_report(n, 64, 16, 8, 16, metrics.cache_pages(n, 64, int(fixed)))
    row = [int(v) if k != "ratio" else round(float(v), 6) for k, v in report.items()]
    return spark.createDataFrame([tuple(row)], ", ".join(f"{k} {'double' if k == 'ratio' else 'long'}" for k in report))


# ------------------------------------------------------------- write log

_LOG = "log AS (SELECT user_id AS node_id, value, ts, event_id AS seq, event_type = 'error' AS is_deleted FROM events), latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ts DESC, seq DESC) AS r FROM log) WHERE r = 1), seg AS (SELECT *, CAST(floor(seq / 500) AS BIGINT) AS segment_id FROM log)"
_BITS = "list_distinct([node_id % 1024, (31 * node_id + 7) % 1024, (37 * node_id + 13) % 1024])"


@_query(f"WITH {_LOG} SELECT node_id, value, seq, is_deleted FROM latest")
def latest_wins(spark, d):
    return writelog.latest(_log(spark, d)).select("node_id", "value", "seq", "is_deleted")


@_query(f"WITH {_LOG} SELECT node_id, value, seq FROM latest WHERE NOT is_deleted")
def tombstone_filter(spark, d):
    return writelog.live(_log(spark, d)).select("node_id", "value", "seq")


@_query(f"WITH {_LOG} SELECT node_id, seq, is_deleted FROM log WHERE node_id BETWEEN 10 AND 40")
def memtable_range(spark, d):
    return writelog.in_range(_log(spark, d), 10, 40).select("node_id", "seq", "is_deleted")


def _segments(spark, d):
    return writelog.segmented(_log(spark, d), 500)


@_query(f"WITH {_LOG} SELECT segment_id, count(*) AS num_entries, min(node_id) AS min_node_id, max(node_id) AS max_node_id, count(*) * 521 AS size_bytes, (SELECT count(DISTINCT b) FROM (SELECT unnest({_BITS}) AS b FROM seg s WHERE s.segment_id = seg.segment_id)) AS bits FROM seg GROUP BY segment_id")
def segment_manifest(spark, d):
    return writelog.manifest(_segments(spark, d)).select("segment_id", "num_entries", "min_node_id", "max_node_id", "size_bytes", F.size("bloom").cast("long").alias("bits"))


@_query(f"WITH {_LOG} SELECT segment_id, count(*) AS entries, count(*) FILTER (is_deleted) AS tombstones, min(node_id) AS min_node_id, max(node_id) AS max_node_id, round(coalesce(sqrt(sum(value * value) FILTER (NOT is_deleted) / nullif(count(*) FILTER (NOT is_deleted), 0)), 0), 6) AS rms_norm FROM seg GROUP BY segment_id")
def segment_stats(spark, d):
    return _round(writelog.segment_stats(_segments(spark, d), norm=F.col("value")), "rms_norm")


@_query(f"WITH {_LOG}, s AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY node_id, seq) - 1 AS pos FROM seg) SELECT segment_id, pos, node_id, pos * 521 + 16 AS \"offset\" FROM s WHERE pos % 64 = 0")
def sparse_index(spark, d):
    out = writelog.sparse_index(_segments(spark, d))
    return out.select("segment_id", F.col("pos").cast("long").alias("pos"), "node_id", F.col("offset").cast("long").alias("offset"))


_PROBE = "bits AS (SELECT segment_id, min(node_id) AS lo, max(node_id) AS hi, list(DISTINCT b) AS bloom FROM (SELECT segment_id, node_id, unnest([node_id % 1024, (31 * node_id + 7) % 1024, (37 * node_id + 13) % 1024]) AS b FROM seg) GROUP BY segment_id), ids AS (SELECT i AS node_id FROM range(0, 400, 3) t(i))"


@_query(f"WITH {_LOG}, {_PROBE} SELECT node_id, segment_id, node_id BETWEEN lo AND hi AS in_range, list_has_all(bloom, [node_id % 1024, (31 * node_id + 7) % 1024, (37 * node_id + 13) % 1024]) AS maybe FROM ids, bits")
def bloom_probe(spark, d):
    ids = spark.range(0, 400, 3).select(F.col("id").alias("node_id"))
    both = ids.crossJoin(writelog.manifest(_segments(spark, d)).select("segment_id", "min_node_id", "max_node_id", "bloom"))
    return both.select("node_id", "segment_id", F.col("node_id").between(F.col("min_node_id"), F.col("max_node_id")).alias("in_range"), bloom.might_contain("bloom", "node_id").alias("maybe"))


@_query(f"WITH {_LOG}, {_PROBE} SELECT node_id, value, seq FROM latest JOIN ids USING (node_id) WHERE NOT is_deleted")
def segment_lookup(spark, d):
    ids = spark.range(0, 400, 3).select(F.col("id").alias("node_id"))
    rows = _segments(spark, d)
    return writelog.segment_lookup(ids, writelog.manifest(rows), rows).select("node_id", "value", "seq")


@_query(f"WITH {_LOG}, old AS (SELECT *, segment_id < 4 AS o FROM seg), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ts DESC, seq DESC) AS r FROM old WHERE o) WHERE r = 1) SELECT node_id, seq, is_deleted, segment_id, 0 AS level FROM old WHERE NOT o UNION ALL SELECT node_id, seq, is_deleted, 1000000, 1 FROM m WHERE NOT is_deleted OR (SELECT count(*) FROM old WHERE NOT o) > 0")
def compaction(spark, d):
    rows = _segments(spark, d).withColumn("level", F.lit(0))
    m = writelog.manifest(rows)
    chosen = writelog.size_tiered_choice(m, 0)
    return writelog.compact(rows, m, chosen, 0, 1_000_000).select("node_id", "seq", "is_deleted", "segment_id", "level")


@_query(f"WITH {_LOG} SELECT 0 AS level, count(DISTINCT segment_id) AS tables, count(*) AS entries, count(*) * 521 AS bytes FROM seg")
def manifest_totals(spark, d):
    return writelog.totals(writelog.manifest(_segments(spark, d)))


@_query(f"WITH {_LOG} SELECT node_id, seq FROM latest WHERE NOT is_deleted")
def streamed_latest_wins(spark, d):
    """The log written by a stream of micro-batches; its view equals the batch one."""
    from ..streaming.ingest import ingest

    base = scratch_dir(spark, "stream")
    rows = _log(spark, d).select("node_id", F.array(F.col("value").cast("float")).alias("embedding"), "ts", "seq", "is_deleted")
    rows.repartition(4, "seq").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(writelog.LOG).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    table = writelog.LogTable(spark, f"{base}/log")
    ingest(stream, table, f"{base}/checkpoint").awaitTermination()
    return table.view().select("node_id", "seq")


# --------------------------------------------------------- cache, others


@_query()
def cache_sim_2q(spark, d):
    t = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), F.col("user_id").alias("page_id"), (F.col("user_id") % 11).alias("in_degree"))
    return cache.simulate(t, CacheConfig(capacity=40))


@_query()
def cache_stats(spark, d):
    t = spark.read.parquet(f"{d}/events.parquet").select("event_type", F.col("event_id").alias("seq"), F.col("user_id").alias("page_id"), (F.col("user_id") % 11).alias("in_degree"))
    return cache.queue_stats(cache.simulate(t, CacheConfig(capacity=40), "event_type"))


@_query("""WITH h AS (SELECT doc_id, text IS NULL AS none, string_split(substr(hex(encode(coalesce(text, ''))), 1, 8184), '') AS c FROM documents),
b AS (SELECT doc_id, none, list_transform(range(1, len(c) // 2 + 1), lambda i: 16 * (instr('0123456789ABCDEF', c[2 * i - 1]) - 1) + instr('0123456789ABCDEF', c[2 * i]) - 1) AS b FROM h)
SELECT doc_id, CASE WHEN none THEN NULL ELSE CAST(256 * (coalesce(list_sum(list_transform(range(1, len(b) + 1), lambda i: (4093 - i) * b[i])), 0) % 255) + coalesce(list_sum(b), 0) % 255 AS INTEGER) END AS checksum FROM b""")
def page_checksum(spark, d):
    """Checksums of pages that hold the bytes of texts."""
    rows = spark.read.parquet(f"{d}/documents.parquet")
    return rows.select("doc_id", bloom.page_checksum(F.col("text").cast("binary")).alias("checksum"))


@_query()
def synthetic_vectors(spark, d):
    return metrics.dataset_stats(generate.benchmark_vectors(spark, 2000, 64)).unionByName(metrics.dataset_stats(generate.random_vectors(spark, 500, 32))).unionByName(metrics.dataset_stats(generate.clustered_vectors(spark, 500, 32, 5)))
