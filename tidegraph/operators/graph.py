"""The evolving graph: a vertex table and an edge bag, and what changes them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """vertices(id) with all ids 0..n-1; edges(src, dst, …), parallel edges and loops allowed."""

    vertices: DataFrame
    edges: DataFrame

    @staticmethod
    def of(edges: DataFrame, least: int = 0) -> Graph:
        """The graph of an edge bag; ids without edges below the largest id exist too."""
        top = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
        n = max(least, -1 if top is None else top + 1, 0)
        return Graph(edges.sparkSession.range(n), edges)

    def grown(self, top: int | None) -> Graph:
        """With ids up to ``top``; ids are never taken away."""
        n = self.vertices.agg(F.max("id")).first()[0]
        n = 0 if n is None else n + 1
        return self if top is None or top < n else replace(self, vertices=self.vertices.sparkSession.range(top + 1))

    def degrees(self) -> DataFrame:
        """(id, in_degree, out_degree) of every vertex; each edge is read once."""
        ends = self.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
        summed = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
        return self.vertices.join(summed, "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"), F.coalesce("out_degree", F.lit(0)).cast("long").alias("out_degree"))


def swapped(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def transpose(edges: DataFrame) -> DataFrame:
    return swapped(edges)


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst); of several payloads the smallest."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    if not rest:
        return edges.distinct()
    return edges.groupBy("src", "dst").agg(F.min(F.struct(*rest)).alias("_p")).select("src", "dst", *[f"_p.{c}" for c in rest])


def symmetrise(edges: DataFrame) -> DataFrame:
    """No loops, both directions, no repeats."""
    plain = edges.where("src <> dst")
    return distinct_edges(plain.unionByName(swapped(plain)))


def instances(rows: DataFrame, *order: str) -> DataFrame:
    """Numbers the parallel rows of each (src, dst)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("src", "dst").orderBy(*(order or ("src",)))))


def delete_edges(edges: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges left, edges deleted): every op takes away one instance, the one with the smallest payload.

    Only edges that share a key with an op are numbered; all others pass by a
    join that Spark broadcasts when the batch is small.
    """
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    keys = ops.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("_k"))
    met = instances(edges.join(keys, ["src", "dst"]), *rest)
    columns = ["src", "dst", *rest]
    kept = edges.join(keys, ["src", "dst"], "left_anti").select(*columns).unionByName(met.where("_n > _k").select(*columns))
    return kept, met.where("_n <= _k").select(*columns)


def unmatched_deletes(edges: DataFrame, ops: DataFrame) -> DataFrame:
    """The deletions that find no instance."""
    have = edges.join(ops.select("src", "dst").distinct(), ["src", "dst"], "left_semi").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("_have"))
    return instances(ops, *(["seq"] if "seq" in ops.columns else [])).join(have, ["src", "dst"], "left").where("_n > coalesce(_have, 0)").select(*ops.columns)


def add_edges(edges: DataFrame, added: DataFrame) -> DataFrame:
    return edges.unionByName(added.select(*edges.columns))


@dataclass(frozen=True)
class Change:
    """What a batch did: the graph before and after, and the edges that really came and went."""

    before: Graph
    after: Graph
    added: DataFrame
    deleted: DataFrame


def apply(graph: Graph, adds: DataFrame, deletes: DataFrame, symmetric: bool = False) -> Change:
    """Deletions first, then growth, then additions."""
    if symmetric:
        adds = adds.unionByName(swapped(adds))
        deletes = deletes.unionByName(swapped(deletes))
    left, gone = delete_edges(graph.edges, deletes)
    top = adds.agg(F.max(F.greatest("src", "dst"))).first()[0]
    after = replace(graph.grown(top), edges=add_edges(left, adds))
    return Change(graph, after, adds.select(*graph.edges.columns), gone)
