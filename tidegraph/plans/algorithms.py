"""The algorithms: PageRank, label propagation, co-training, ALS, shortest paths, reachability, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import solve2, unsigned_double, with_hash, wrapping_add
from ..operators.graph import Graph, symmetrise
from ..sources.edgelist import flagged
from ..sources.storage import materialize
from .bsp import VertexProgram
from .monotonic import PathProgram, PathRun, fixpoint

DAMPING = 0.85
ALPHA = 0.15


def pagerank(epsilon: float = 0.01, max_iters: int = 10) -> VertexProgram:
    """x = 0.15 + 0.85 * sum of x(u) / out_degree(u); starts at 1, not normalised."""
    return VertexProgram(
        "pagerank", ("rank",),
        side=lambda g: g.degrees().select("id", "out_degree"),
        init=lambda s: s.withColumn("rank", F.lit(1.0)),
        edges=lambda g, s: g.edges.select("src", "dst"),
        message=lambda: {"rank": F.col("s_rank") / F.col("s_out_degree")},
        update=lambda: {"rank": F.lit(1 - DAMPING) + F.lit(DAMPING) * F.col("a_rank")},
        sent_side=("out_degree",), epsilon=epsilon, max_iters=max_iters,
    )


def id_weight(mod: float) -> Column:
    """Weight of an edge without one, from its ends."""
    return ((F.col("src") + F.col("dst")).cast("double") * 1.7777777777) % mod


def weighted(edges: DataFrame, default: Column) -> DataFrame:
    return edges.select("src", "dst", (F.col("w").cast("double") if "w" in edges.columns else default).alias("w"))


def label_propagation(seeds: DataFrame, mod: float = 0.5, epsilon: float = 0.01, max_iters: int = 10) -> VertexProgram:
    """Two scores; seeds and vertices without in-edges keep theirs, others mix the normalised weighted sum with their own."""

    def start(s: DataFrame) -> DataFrame:
        raw = s.withColumns({f"_{i}": ((F.col("id") + i + 3).cast("double") * 1.23456) % mod for i in range(2)})
        return raw.withColumns({f"f{i}": F.col(f"_{i}") / (F.col("_0") + F.col("_1")) for i in range(2)}).drop("_0", "_1")

    def update() -> dict[str, Column]:
        total = F.col("a_f0") + F.col("a_f1")
        mixed = [F.col(f"f{i}") * ALPHA + F.try_divide(F.col(f"a_f{i}"), total) * (1 - ALPHA) for i in range(2)]
        again = mixed[0] + mixed[1]
        frozen = F.col("seed") | (F.col("in_degree") == 0) | (total == 0) | (again == 0)
        return {f"f{i}": F.when(frozen, F.col(f"f{i}")).otherwise(F.try_divide(mixed[i], again)) for i in range(2)}

    return VertexProgram(
        "labels", ("f0", "f1"),
        side=lambda g: flagged(g.degrees().select("id", "in_degree"), seeds, "seed"),
        init=start,
        edges=lambda g, s: weighted(g.edges, id_weight(mod)),
        message=lambda: {c: F.col("w") * F.col(f"s_{c}") for c in ("f0", "f1")},
        update=update, epsilon=epsilon, max_iters=max_iters,
    )


def parted(vertices: DataFrame, members: DataFrame | None) -> DataFrame:
    """Adds ``part``: membership in the file's partition; without a file, odd ids are members."""
    if members is None:
        return vertices.withColumn("part", F.col("id") % 2 == 1)
    top = members.agg(F.max("id")).first()[0]
    return flagged(vertices, members, "part", F.when(F.col("id") > F.lit(-1 if top is None else top), F.col("id") % 2 == 1).otherwise(False))


def across(edges: DataFrame, side: DataFrame) -> DataFrame:
    """Edges between the partitions."""
    part = side.select(F.col("id"), "part")
    return edges.join(part.select(F.col("id").alias("src"), F.col("part").alias("_p")), "src").join(part.select(F.col("id").alias("dst"), F.col("part").alias("_q")), "dst").where("_p <> _q").drop("_p", "_q")


def coem(seeds: DataFrame, members: DataFrame | None = None, mod: float = 0.5, epsilon: float = 0.01, max_iters: int = 10) -> VertexProgram:
    """Bipartite co-training: seeds in the partition are 1; others the weighted mean over in-edges from the other partition."""
    weight = lambda g: weighted(g.edges, id_weight(mod) + 0.1)

    def side(g: Graph) -> DataFrame:
        into = weight(g).groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("in_weight"))
        v = parted(flagged(g.degrees().select("id", "in_degree"), seeds, "seed"), members)
        return v.join(into, "id", "left").select("id", "in_degree", (F.col("seed") & F.col("part")).alias("seed"), "part", F.coalesce("in_weight", F.lit(0.0)).alias("in_weight"))

    return VertexProgram(
        "coem", ("score",),
        side=side,
        init=lambda s: s.withColumn("score", F.when(F.col("seed"), 1.0).otherwise(0.0)),
        edges=lambda g, s: across(weight(g), s),
        message=lambda: {"score": F.col("w") * F.col("s_score")},
        update=lambda: {"score": F.when(F.col("seed"), F.col("score")).when(F.col("in_degree") == 0, 0.0).otherwise(F.coalesce(F.try_divide("a_score", "in_weight"), F.lit(0.0)))},
        epsilon=epsilon, max_iters=max_iters,
    )


def als(members: DataFrame | None = None, mod: float = 0.00190000001, regular: float = 5.5e-7, seed: int = 5, epsilon: float = 0.01, max_iters: int = 10, hashed: bool = True) -> VertexProgram:
    """Alternating least squares with two factors: members solve in odd iterations, the others in even ones."""

    def start(s: DataFrame) -> DataFrame:
        for i in range(2):
            if hashed:
                s = with_hash(s, F.col("id") * 2 + i, "_h")
                s = s.withColumn(f"x{i}", unsigned_double(wrapping_add(F.col("_h"), F.lit(seed).cast("long"))) % mod).drop("_h")
            else:
                s = s.withColumn(f"x{i}", F.lit(mod) * (F.col("id") % 7 + i + 1))
        return s

    def message() -> dict[str, Column]:
        x0, x1, w = F.col("s_x0"), F.col("s_x1"), F.col("w")
        return {"m00": x0 * x0, "m01": x0 * x1, "m11": x1 * x1, "b0": w * x0, "b1": w * x1}

    def update() -> dict[str, Column]:
        s0, s1 = solve2(F.col("a_m00") + regular, F.col("a_m01"), F.col("a_m11") + regular, F.col("a_b0"), F.col("a_b1"))
        return {"x0": s0, "x1": s1}

    def edges(g: Graph, s: DataFrame) -> DataFrame:
        return across(weighted(g.edges, (F.col("src") + F.col("dst")).cast("double") % mod), s)

    return VertexProgram(
        "als", ("x0", "x1"),
        side=lambda g: parted(g.vertices, members), init=start, edges=edges, message=message, update=update,
        computes=lambda i: F.col("part") if i % 2 else ~F.col("part"), forced=2, use_delta=lambda i: False, epsilon=epsilon, max_iters=max_iters,
    )


def shortest_paths(source: int = 0, cap: int = 5, weighted_edges: bool = False) -> PathProgram:
    """Distance from a source; an edge without weight costs (src + dst) % cap + 1."""
    return PathProgram("paths", source, lambda: F.col("w").cast("long") if weighted_edges else (F.col("src") + F.col("dst")) % cap + 1)


def reachability(source: int = 0) -> PathProgram:
    """Whether a path leads from the source; ``level`` is its least number of hops."""
    return PathProgram("reach", source, lambda: F.lit(0).cast("long"))


def reached(run: PathRun) -> DataFrame:
    return run.graph.degrees().join(run.state, "id").select("id", "in_degree", "out_degree", F.col("value").isNotNull().cast("int").alias("value"), "level")


def connected_components(graph: Graph) -> DataFrame:
    """(id, component): the smallest id of the undirected component."""
    edges = symmetrise(graph.edges.select("src", "dst")).repartition("src").persist()
    program = PathProgram("components", -1, lambda: F.lit(0).cast("long"))
    state = graph.vertices.select("id", F.col("id").alias("value"), F.lit(0).cast("long").alias("level"), F.col("id").alias("parent"), F.lit(True).alias("moved"))
    return fixpoint(program, graph, edges, materialize(state, "components")).state.select("id", F.col("value").alias("component"))
