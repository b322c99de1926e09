"""Command line: build, search, insert, verify, benchmark."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig, GraphConfig, PqConfig
from .engine import create_engine, run_benchmark
from .operators import exact, metrics
from .sources import vecs


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="ambervec", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("build", "search", "insert", "verify", "benchmark"):
        c = sub.add_parser(name)
        c.add_argument("--index", required=True, help="folder of the tables")
        c.add_argument("--k", type=int, default=10)
        c.add_argument("--ef", type=int, default=50)
        c.add_argument("--vectors", help="fvecs file or Parquet folder")
        c.add_argument("--queries", help="fvecs file")
        c.add_argument("--truth", help="ivecs file")
        c.add_argument("--output", help="folder for text results")
        c.add_argument("--degree", type=int, default=16)
        c.add_argument("--codes", type=int, default=256)
        c.add_argument("--num", type=int, default=2000)
        c.add_argument("--dimension", type=int, default=64)
        c.add_argument("--writes", type=int, default=0)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("ambervec").getOrCreate()
    config = EngineConfig(graph=GraphConfig(max_degree=a.degree), pq=PqConfig(codes=a.codes))
    if a.command == "benchmark":
        print(json.dumps(run_benchmark(spark, a.index, a.vectors, a.num, a.dimension, k=a.k, ef=a.ef, degree=a.degree, writes=a.writes)))
        return 0
    engine = create_engine(spark, a.index, config)
    if a.command == "build":
        n = engine.load_dataset(a.vectors)
        engine.build_index()
        engine.save()
        print(json.dumps({"vectors": n}))
        return 0
    engine.load()
    if a.command == "insert":
        first = engine._next_id()
        rows = vecs.read_fvecs(spark, a.vectors)
        engine.insert_frame(rows.withColumn("node_id", F.col("node_id") + first))
        print(json.dumps({"first_id": first, "inserted": rows.count()}))
        return 0
    queries = vecs.read_fvecs(spark, a.queries).withColumnRenamed("node_id", "query_id")
    found = engine.search_frame(queries, a.k, a.ef)
    if a.command == "search":
        ids = F.transform(F.array_sort(F.collect_list(F.struct("rk", "node_id"))), lambda s: s["node_id"].cast("string"))
        lines = found.groupBy("query_id").agg(F.concat(F.col("query_id").cast("string"), F.lit(": "), F.concat_ws(" ", ids)).alias("value"))
        if a.output:
            lines.select("value").write.mode("overwrite").text(a.output)
        else:
            for r in lines.orderBy("query_id").toLocalIterator():
                print(r.value)
        return 0
    truth = vecs.read_ground_truth(spark, a.truth) if a.truth else None
    if truth is not None:
        truth, usable = metrics.applicable_truth(truth, engine.get_num_vectors(), a.k)
        truth = truth if usable else None
    if truth is None:
        truth = exact.exact_knn(engine.vectors(), queries, a.k)
    recall = metrics.recall_macro(found, truth, a.k).first()[0]
    ratio = engine.get_memory_usage()["ratio"]
    print(json.dumps({"recall": recall, "memory_ratio": ratio, "pass": recall >= 0.85}))
    return 0 if recall >= 0.85 else 1


if __name__ == "__main__":
    raise SystemExit(main())
