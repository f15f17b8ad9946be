"""Command line: ``python -m tidegraph ALGORITHM GRAPH [--stream FOLDER] …``; also ``convert`` and ``compare``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.graph import Graph, symmetrise
from .operators.ingest import Options, parse_ops, replay
from .operators.primitives import compare, differences
from .plans import algorithms as alg
from .plans.adaptive import Adaptive
from .sources import edgelist
from .streaming.driver import Engine, stream

VALUES = {"pagerank": ["rank"], "labels": ["f0", "f1"], "coem": ["score"], "als": ["x0", "x1"], "paths": ["value"], "reach": ["value"]}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidegraph")
    sub = p.add_subparsers(dest="command", required=True)
    for name in VALUES:
        a = sub.add_parser(name)
        a.add_argument("graph", help="edge list, or adjacency file with --adjacency")
        a.add_argument("--adjacency", action="store_true")
        a.add_argument("--weighted", action="store_true")
        a.add_argument("--symmetric", action="store_true")
        a.add_argument("--simple", action="store_true")
        a.add_argument("--fixed-batch-size", action="store_true")
        a.add_argument("--enforce-edge-validity", action=argparse.BooleanOptionalAction, default=True)
        a.add_argument("--ops", help="file or folder of operations, applied in batches of --batch-size")
        a.add_argument("--batch-size", type=int, default=1000)
        a.add_argument("--batches", type=int, help="how many batches at most")
        a.add_argument("--adaptive", action="store_true", help="recompute where refinement is likely to be dearer")
        a.add_argument("--home", help="folder from which a stopped run goes on")
        a.add_argument("--stream", help="folder of operation files")
        a.add_argument("--checkpoint", help="folder of the stream's offsets")
        a.add_argument("--files-per-batch", type=int, default=1)
        a.add_argument("--output")
        a.add_argument("--max-iters", type=int, default=10)
        a.add_argument("--epsilon", type=float, default=0.01)
        a.add_argument("--seeds")
        a.add_argument("--partitions")
        a.add_argument("--mod", type=float)
        a.add_argument("--regular", type=float, default=5.5e-7)
        a.add_argument("--source", type=int, default=0)
        a.add_argument("--weight-cap", type=int, default=5)
    c = sub.add_parser("convert")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--symmetric", action="store_true")
    c.add_argument("--weighted", action="store_true")
    c = sub.add_parser("compare")
    c.add_argument("first")
    c.add_argument("second")
    c.add_argument("--version", type=int, default=0)
    c.add_argument("--features", type=int, default=1)
    c.add_argument("--tolerances", type=int, default=6)
    c.add_argument("--differences", help="folder for the rows that differ by more than the last tolerance")
    r = sub.add_parser("replay", help="cut operations into one text folder per batch")
    r.add_argument("source")
    r.add_argument("target")
    r.add_argument("--batch-size", type=int, default=1000)
    return p


def program(spark: SparkSession, a: argparse.Namespace):
    ids = lambda path: edgelist.read_ids(spark, path) if path else None
    none = spark.createDataFrame([], "id long")
    limits = {"epsilon": a.epsilon, "max_iters": a.max_iters}
    if a.command == "pagerank":
        return alg.pagerank(**limits)
    if a.command == "labels":
        return alg.label_propagation(ids(a.seeds) or none, a.mod or 0.5, **limits)
    if a.command == "coem":
        return alg.coem(ids(a.seeds) or none, ids(a.partitions), a.mod or 0.5, **limits)
    if a.command == "als":
        return alg.als(ids(a.partitions), a.mod or 0.00190000001, a.regular, **limits)
    if a.command == "paths":
        return alg.shortest_paths(a.source, a.weight_cap, a.weighted)
    return alg.reachability(a.source)


def main(argv: list[str] | None = None, spark: SparkSession | None = None):
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tidegraph").getOrCreate()
    if a.command == "convert":
        return edgelist.snap_to_adjacency(spark, a.source, a.target, a.symmetric, a.weighted)
    if a.command == "replay":
        ops = parse_ops(edgelist.read_lines(spark, a.source)).where("reason IS NULL").drop("reason")
        return replay(ops, a.batch_size, a.target)
    if a.command == "compare":
        names = [f"v{k}" for k in range(a.features)]
        first, second = (edgelist.read_result(spark, p, a.version, names) for p in (a.first, a.second))
        out = compare(first, second, names, a.tolerances)
        out.show()
        if a.differences:
            differences(first, second, names, 10.0 ** -(a.tolerances - 1)).write.mode("overwrite").json(a.differences)
        return out
    vertices, edges = edgelist.read_adjacency(spark, a.graph) if a.adjacency else (None, edgelist.read_edge_list(spark, a.graph, a.weighted))
    if a.weighted:
        edges = edges.withColumnRenamed("payload", "w").withColumn("w", F.col("w").try_cast("double"))
    if a.symmetric or a.simple:
        from .operators.graph import distinct_edges

        edges = symmetrise(edges) if a.symmetric else distinct_edges(edges)
    engine = Engine(program(spark, a), Graph(vertices, edges) if vertices is not None else Graph.of(edges), Options(a.symmetric, a.simple, a.enforce_edge_validity, a.fixed_batch_size), a.output, tuple(VALUES[a.command]), adaptive=Adaptive() if a.adaptive else None, home=a.home).start()
    if a.ops:
        engine.replayed(edgelist.read_lines(spark, a.ops), a.batch_size, a.batches, a.weighted)
    if a.stream:
        stream(spark, engine, a.stream, a.checkpoint or f"{a.output}-offsets", a.files_per_batch, a.weighted).awaitTermination()
    return engine


if __name__ == "__main__":
    main()
