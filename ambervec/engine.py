"""The engine as one object over tables in a folder: load, build, save, search, write."""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig, GraphConfig, PqConfig, SearchConfig, sift1m
from .errors import ErrorCode, InvalidArgument, NodeNotFound, NotInitialized
from .operators import exact, graph, metrics, quantize, search, writelog
from .sources import files, generate, vecs


@dataclass(frozen=True)
class SearchResult:
    node_id: int
    distance: float

    def __lt__(self, other: "SearchResult") -> bool:
        return (self.distance, self.node_id) < (other.distance, other.node_id)


@dataclass(frozen=True)
class InsertResult:
    success: bool
    node_id: int | None = None
    error: ErrorCode = ErrorCode.SUCCESS


@dataclass(frozen=True)
class QueryResult:
    results: list[SearchResult]
    latency_ms: float
    error: ErrorCode = ErrorCode.SUCCESS


class VectorEngine:
    """Base vectors, a graph and PQ codes as Parquet tables, and a log of writes.

    DataFrames are the main form (``search_frame``); ``search``, ``insert`` and
    ``delete`` are single-row conveniences.
    """

    def __init__(self, spark: SparkSession, path: str, config: EngineConfig = EngineConfig()):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config
        self._base: DataFrame | None = None
        self._nodes: DataFrame | None = None
        self._codes: DataFrame | None = None
        self._book: DataFrame | None = None
        self._log: writelog.LogTable | None = None
        self._pending: list[tuple] = []
        self._lock = threading.RLock()  # writers and readers may be threads
        self._samples: list[tuple[int, float]] = []

    # lifecycle
    def init(self) -> "VectorEngine":
        self._log = writelog.LogTable(self.spark, f"{self.path}/log", self.config.log)
        return self

    def shutdown(self) -> None:
        self.flush()
        self._base = self._nodes = self._codes = self._book = self._log = None

    def is_initialized(self) -> bool:
        return self._log is not None

    def _ready(self) -> None:
        if self._log is None:
            raise NotInitialized("call init() first")

    # building
    def load_dataset(self, source: str | DataFrame, limit: int = 0) -> int:
        """Read vectors from an fvecs file, a Parquet folder or a DataFrame (node_id, embedding)."""
        self._ready()
        if isinstance(source, DataFrame):
            rows = source.select("node_id", "embedding")
        elif source.endswith(".fvecs"):
            rows = vecs.read_fvecs(self.spark, source, limit)
        else:
            rows = self.spark.read.parquet(source).select("node_id", "embedding")
        if limit:
            rows = rows.where(F.col("node_id") < limit)
        if not metrics.validate_dataset(rows).first().valid:
            raise InvalidArgument("vectors of different size or with values that aren't finite")
        rows.write.mode("overwrite").parquet(f"{self.path}/base")
        self._base = self.spark.read.parquet(f"{self.path}/base")
        return self._base.count()

    def build_index(self) -> None:
        """Graph, codebook and codes of the base, written to the folder."""
        self._need_base()
        graph.build_graph(self._base, self.config.graph).write.mode("overwrite").parquet(f"{self.path}/nodes")
        book = quantize.train_codebook(self._base, self.config.pq)
        book.write.mode("overwrite").parquet(f"{self.path}/codebook")
        book = self.spark.read.parquet(f"{self.path}/codebook")
        quantize.encode(self._base, book).write.mode("overwrite").parquet(f"{self.path}/codes")
        self.load()

    def save(self) -> None:
        """Write the records that hold each vector with its neighbours and their codes."""
        self._need_index()
        graph.disk_index(self._base, self._nodes, self._codes).write.mode("overwrite").option("parquet.bloom.filter.enabled#node_id", "true").parquet(f"{self.path}/records")

    def load(self) -> "VectorEngine":
        self._ready()
        self._base = self.spark.read.parquet(f"{self.path}/base")
        self._nodes = self.spark.read.parquet(f"{self.path}/nodes")
        self._codes = self.spark.read.parquet(f"{self.path}/codes")
        self._book = self.spark.read.parquet(f"{self.path}/codebook")
        return self

    def _need_base(self) -> None:
        self._ready()
        if self._base is None:
            raise NotInitialized("call load_dataset() or load() first")

    def _need_index(self) -> None:
        self._need_base()
        if self._nodes is None:
            raise NotInitialized("call build_index() or load() first")

    # writing
    def insert(self, vector: list[float]) -> InsertResult:
        with self._lock:
            return self.insert_with_id(self._next_id(), vector)

    def insert_frame(self, rows: DataFrame) -> None:
        """Write a table (node_id, embedding) as one segment, where its rows lie."""
        self._ready()
        if not metrics.validate_dataset(rows).first().valid:
            raise InvalidArgument("vectors of different size or with values that aren't finite")
        with self._lock:
            self.flush()
            last = self._log.rows().agg(F.max("seq")).first()[0]
            seq = F.monotonically_increasing_id() + (0 if last is None else last + 1)
            out = rows.select("node_id", F.col("embedding").cast("array<float>").alias("embedding"), F.current_timestamp().alias("ts"), seq.alias("seq"), F.lit(False).alias("is_deleted"))
            self._log.append(out, self._log.next_id())

    def insert_with_id(self, node_id: int, vector: list[float]) -> InsertResult:
        self._ready()
        if not vector or any(x != x or abs(x) == float("inf") for x in vector):
            return InsertResult(False, None, ErrorCode.INVALID_ARGUMENT)
        with self._lock:
            self._pending.append((node_id, [float(x) for x in vector], False))
            self._rotate()
        return InsertResult(True, node_id)

    def delete_vector(self, node_id: int) -> None:
        self._ready()
        with self._lock:
            self._pending.append((node_id, None, True))
            self._rotate()

    def _rotate(self) -> None:
        if len(self._pending) >= self.config.log.rows_per_segment:
            self.flush()

    def _next_id(self) -> int:
        self._ready()
        known = [r[0] for r in (df.agg(F.max("node_id")).first() for df in (self._base, self._log.rows()) if df is not None)]
        return max([-1, *(x for x in known if x is not None), *(p[0] for p in self._pending)]) + 1

    def flush(self) -> None:
        """Write pending rows as one segment; their sequence numbers follow those of the log."""
        self._ready()
        with self._lock:
            if not self._pending:
                return
            last = self._log.rows().agg(F.max("seq")).first()[0]
            first = 0 if last is None else last + 1
            rows = self.spark.createDataFrame([(i, v, first + k, d) for k, (i, v, d) in enumerate(self._pending)], "node_id long, embedding array<float>, seq long, is_deleted boolean")
            rows = rows.withColumn("ts", F.current_timestamp()).select("node_id", "embedding", "ts", "seq", "is_deleted")
            self._log.append(rows, self._log.next_id())
            self._pending = []

    def index_writes(self) -> int:
        """Fold the written rows into the base: live ones are inserted through the graph and
        encoded, replaced and deleted ones leave it, and the log is empty again. The
        number of rows that were written into the graph."""
        self._need_index()
        with self._lock:
            old, new, _ = self._state()
            done = self._log.manifest().select("segment_id").collect()
            keep = old.select("node_id")
            links = graph.edges(self._nodes.join(keep, "node_id", "left_semi")).join(keep.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
            left = links.groupBy(F.col("src").alias("node_id")).agg(F.collect_list("dst").alias("neighbors"))
            nodes = keep.join(left, "node_id", "left").select("node_id", F.coalesce("neighbors", F.array().cast("array<long>")).alias("neighbors"))
            old = old.select("node_id", "embedding")
            tables = {
                "base": old.unionByName(new), "nodes": graph.insert_nodes(nodes, old, new, self.config.graph) if not new.isEmpty() else nodes,
                "codes": self._codes.join(keep, "node_id", "left_semi").unionByName(quantize.encode(new, self._book)),
            }
            temps = {name: files.temp_path(f"{self.path}/{name}") for name in tables}
            for name, rows in tables.items():
                rows.write.parquet(temps[name])
            n = new.count()
            for name, temp in temps.items():
                files.commit_temp(self.spark, temp, f"{self.path}/{name}")
            for r in done:
                self._log.drop(r.segment_id)
            self.spark.catalog.refreshByPath(self.path)
            self.load()
            return n

    def compactor(self, **options) -> writelog.Compactor:
        """Compaction of the log beside the writers."""
        self._ready()
        return writelog.Compactor(self._log, **options)

    def compact(self) -> int | None:
        self.flush()
        return self._log.compact()

    # reading
    def _state(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The base without ids that were written since, the live written rows, the deleted ids."""
        self.flush()
        newest = writelog.latest(self._log.rows().drop("segment_id", "level"))
        old = self._base.join(newest.select("node_id"), "node_id", "left_anti")
        return old, newest.where("not is_deleted").select("node_id", "embedding"), newest.where("is_deleted").select("node_id")

    def vectors(self) -> DataFrame:
        self._need_base()
        old, new, _ = self._state()
        return old.select("node_id", "embedding").unionByName(new)

    def search_frame(self, queries: DataFrame, k: int = 10, ef: int | None = None, approximate: bool = True) -> DataFrame:
        """(query_id, rk, node_id, distance) for a table of queries, writes included."""
        self._need_base()
        old, new, gone = self._state()
        if not approximate or self._nodes is None:
            return exact.exact_knn(old.select("node_id", "embedding").unionByName(new), queries, k)
        conf = SearchConfig(k=k, ef=max(k, ef or self.config.search.ef), adc_factor=self.config.search.adc_factor)
        return search.search_with_delta(self._base, self._nodes, new, queries, conf, gone, codes=self._codes, codebook=self._book)

    def search(self, query: list[float], k: int = 10) -> QueryResult:
        began = time.perf_counter()
        q = self.spark.createDataFrame([(0, [float(x) for x in query])], "query_id long, embedding array<float>")
        rows = self.search_frame(q, k).orderBy("rk").collect()
        took = (time.perf_counter() - began) * 1000
        self._samples = [*self._samples[-9_999:], (len(self._samples), took)]
        return QueryResult([SearchResult(r.node_id, r.distance) for r in rows], took)

    def batch_search(self, queries: list[list[float]], k: int = 10) -> list[list[SearchResult]]:
        q = self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(queries)], "query_id long, embedding array<float>")
        out: list[list[SearchResult]] = [[] for _ in queries]
        for r in self.search_frame(q, k).orderBy("query_id", "rk").collect():
            out[r.query_id].append(SearchResult(r.node_id, r.distance))
        return out

    def read_record(self, node_id: int) -> dict:
        """What `save` stored for a base row: its vector, neighbours and their codes."""
        self._ready()
        records = self.spark.read.parquet(f"{self.path}/records").where(F.col("node_id") == node_id)
        row = records.first()
        if row is None:
            raise NodeNotFound(node_id)
        return row.asDict()

    def get_vector(self, node_id: int) -> list[float]:
        row = exact.get_vector(self.vectors(), node_id).first()
        if row is None:
            raise NodeNotFound(node_id)
        return list(row.embedding)

    # the graph
    def is_built(self) -> bool:
        return self._nodes is not None

    def neighbors(self, node_id: int) -> list[int]:
        self._need_index()
        row = self._nodes.where(F.col("node_id") == node_id).first()
        if row is None:
            raise NodeNotFound(node_id)
        return list(row.neighbors)

    def nav_data(self) -> DataFrame:
        """(node_id, neighbors, degree, entry): what a walk needs, with the entry marked."""
        self._need_index()
        entry = graph.medoid(self._base).select(F.col("node_id").alias("first"))
        return self._nodes.crossJoin(F.broadcast(entry)).select("node_id", "neighbors", F.size("neighbors").alias("degree"), (F.col("node_id") == F.col("first")).alias("entry"))  # one row

    def graph_stats(self) -> dict[str, int | None]:
        """Nodes, edges, greatest degree and entry; zeros and no entry before the index is built."""
        if self._nodes is None:
            return {"nodes": 0, "edges": 0, "max_degree": 0, "entry": None}
        n, e, m = self._nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("neighbors")), F.lit(0)), F.coalesce(F.max(F.size("neighbors")), F.lit(0))).first()
        first = graph.medoid(self._base).first()
        return {"nodes": n, "edges": e, "max_degree": m, "entry": first.node_id if first else None}

    # reports
    def reset_stats(self) -> None:
        self._samples = []

    def get_num_vectors(self) -> int:
        return self.vectors().count()

    def get_memory_usage(self) -> dict[str, float]:
        n, width = self._base.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
        g, p = self.config.graph, self.config.pq
        fixed = metrics.memory_report(n, width, g.max_degree, p.subspaces, p.codes, 0)
        return metrics.memory_report(n, width, g.max_degree, p.subspaces, p.codes, metrics.cache_pages(n, width, int(fixed["total"])))

    def is_memory_within_limits(self) -> bool:
        m = self.get_memory_usage()
        return self.config.memory_low <= m["ratio"] <= self.config.memory_high

    def get_metrics(self) -> dict[str, float]:
        ms = sorted(t for _, t in self._samples)
        if not ms:
            return {"queries": 0, "avg_ms": 0.0, "p99_ms": 0.0}
        return {"queries": len(ms), "avg_ms": sum(ms) / len(ms), "p99_ms": ms[min(len(ms) * 99 // 100, len(ms) - 1)]}


def create_engine(spark: SparkSession, path: str, config: EngineConfig | None = None) -> VectorEngine:
    return VectorEngine(spark, path, config or EngineConfig()).init()


def create_sift1m_engine(spark: SparkSession, path: str) -> VectorEngine:
    return VectorEngine(spark, path, sift1m()).init()


def run_benchmark(spark: SparkSession, path: str, vectors: str | None = None, n: int = 2000, dimension: int = 64, queries: int = 100, k: int = 10, ef: int = 50, degree: int = 16, subspaces: int = 8, codes: int = 64, writes: int = 0) -> dict[str, float]:
    """Load or generate, build, search and report: recall, seconds, memory; with
    ``writes``, also a mixed load: a thread inserts that many vectors while batches of
    queries go on, and all of them must be found afterwards."""
    config = EngineConfig(dimension, graph=GraphConfig(max_degree=degree), pq=PqConfig(subspaces=subspaces, codes=codes), search=SearchConfig(k, ef))
    engine = create_engine(spark, path, config)
    engine.load_dataset(generate.file_or_synthetic(spark, vectors, n, dimension))
    began = time.perf_counter()
    engine.build_index()
    out = {"build_s": time.perf_counter() - began}
    generate.benchmark_queries(engine._base, queries, dimension).write.mode("overwrite").parquet(f"{path}/queries")
    q = spark.read.parquet(f"{path}/queries")
    truth = exact.exact_knn(engine._base, q, k)
    began = time.perf_counter()
    found = engine.search_frame(q, k)
    found.write.mode("overwrite").parquet(f"{path}/found")
    out["search_s"] = time.perf_counter() - began
    found = spark.read.parquet(f"{path}/found")
    out["recall"] = metrics.recall_micro(found, truth, k).first()[0]
    out |= {f"memory_{a}": b for a, b in engine.get_memory_usage().items()}
    if writes:
        fresh = [list(r.embedding) for r in generate.random_vectors(spark, writes, dimension, seed=7).collect()]
        first, batch = engine._next_id(), [list(r.embedding) for r in q.limit(10).collect()]
        took, failed = [], []

        def write():
            began = time.perf_counter()
            try:
                for i, v in enumerate(fresh):
                    engine.insert_with_id(first + i, v)
                    if (i + 1) % max(1, writes // 4) == 0:
                        engine.flush()
                engine.flush()
            except Exception as e:
                failed.append(e)
            took.append(time.perf_counter() - began)

        writer, searched, latencies = threading.Thread(target=write), 0, []
        writer.start()
        while writer.is_alive() or not searched:
            began = time.perf_counter()
            searched += len(engine.batch_search(batch, k))
            latencies.append((time.perf_counter() - began) * 1000)
        writer.join()
        if failed:
            raise failed[0]
        out |= {"writes_per_s": writes / took[0], "searches_meanwhile": searched, "batch_ms": sum(latencies) / len(latencies), "batch_p99_ms": sorted(latencies)[min(len(latencies) * 99 // 100, len(latencies) - 1)]}
        back = engine.batch_search(fresh, 1)
        out["read_back"] = sum(bool(r) and r[0].node_id == first + i for i, r in enumerate(back)) / writes
        # and through the graph, once the writes are in it
        engine.index_writes()
        back = engine.batch_search(fresh, 1)
        out["found_by_graph"] = sum(bool(r) and r[0].node_id == first + i for i, r in enumerate(back)) / writes
    return out
