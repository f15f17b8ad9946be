"""Monotonic path programs: value, level and parent of every vertex, and their repair.

A candidate (value, level) replaces a vertex's pair if it is lexicographically
smaller; ``min`` over a struct picks it together with its parent. Rounds are
semi-naive: only vertices that improved in the last round push.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import Change, Graph
from ..sources.storage import materialize

UNREACHED = 65535


@dataclass(frozen=True)
class PathProgram:
    """``cost`` sees src, dst and edge columns; it is added to the source's value and must not be negative."""

    name: str
    source: int
    cost: Callable[[], Column]


@dataclass
class PathRun:
    program: PathProgram
    graph: Graph
    state: DataFrame  # id, value, level, parent; nulls: not reached
    rounds: int = 0

    def result(self) -> DataFrame:
        return self.graph.degrees().join(self.state, "id").select("id", "in_degree", "out_degree", F.coalesce("value", F.lit(UNREACHED).cast("long")).alias("value"), "level")


def start(program: PathProgram, graph: Graph) -> DataFrame:
    here = F.col("id") == program.source
    return graph.vertices.select("id", F.when(here, 0).cast("long").alias("value"), F.when(here, 0).cast("long").alias("level"), F.when(here, F.col("id")).alias("parent"))


def offers(program: PathProgram, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, best): the best candidate for every destination of the sources' edges."""
    pushed = edges.join(sources.where("value IS NOT NULL").select(F.col("id").alias("src"), F.col("value").alias("_v"), F.col("level").alias("_l")), "src")
    best = F.min(F.struct((F.col("_v") + program.cost()).alias("value"), (F.col("_l") + 1).alias("level"), F.col("src").alias("parent")))
    return pushed.groupBy(F.col("dst").alias("id")).agg(best.alias("best"))


def merged(state: DataFrame, best: DataFrame) -> DataFrame:
    """State with better candidates taken; ``moved`` marks them."""
    better = F.col("best").isNotNull() & (F.col("value").isNull() | (F.col("best.value") < F.col("value")) | ((F.col("best.value") == F.col("value")) & (F.col("best.level") < F.col("level"))))
    take = lambda c: F.when(F.col("moved"), F.col(f"best.{c}")).otherwise(F.col(c)).alias(c)
    joined = state.select("id", "value", "level", "parent").join(best, "id", "left").withColumn("moved", better)
    return joined.select("id", take("value"), take("level"), take("parent"), "moved")


def fixpoint(program: PathProgram, graph: Graph, edges: DataFrame, state: DataFrame) -> PathRun:
    """``state`` with a ``moved`` column: whose values others have not seen."""
    rounds = 0
    while True:
        frontier = state.where("moved")
        if frontier.isEmpty():
            return PathRun(program, graph, state.drop("moved"), rounds)
        state = materialize(merged(state, offers(program, edges, frontier)), program.name)
        rounds += 1


def run(program: PathProgram, graph: Graph) -> PathRun:
    edges = graph.edges.repartition("src").persist()
    state = start(program, graph).withColumn("moved", F.col("value").isNotNull())
    return fixpoint(program, graph, edges, materialize(state, program.name))


def refine(old: PathRun, change: Change) -> PathRun:
    """Repair after a batch: drop what depended on deleted edges, pull once, relax additions, go on."""
    p, graph = old.program, change.after
    edges = graph.edges.repartition("src").persist()
    state = start(p, graph).select("id", F.struct("value", "level", "parent").alias("_new")).join(old.state, "id", "left")
    known = old.state.select("id").withColumn("_known", F.lit(True))
    state = state.join(known, "id", "left").select("id", *[F.when(F.col("_known"), F.col(c)).otherwise(F.col(f"_new.{c}")).alias(c) for c in ("value", "level", "parent")])
    state = materialize(state, p.name)

    # a tree edge is lost when a copy of it went that its value may have come through
    gone = change.deleted.select(F.col("dst").alias("id"), F.col("src").alias("parent")).distinct()
    lost = state.join(gone, ["id", "parent"], "left_semi").where(F.col("id") != p.source).select("id")
    lost = materialize(lost, "lost")
    wave = lost
    while not wave.isEmpty():
        below = state.where(F.col("id") != p.source).join(wave.select(F.col("id").alias("parent")), "parent", "left_semi").select("id")
        wave = materialize(below.join(lost, "id", "left_anti"), "lost")
        lost = lost.union(wave)
    lost = materialize(lost.distinct(), "lost")

    reset = state.join(lost.withColumn("_lost", F.lit(True)), "id", "left")
    reset = reset.select("id", *[F.when(F.col("_lost"), F.lit(None)).otherwise(F.col(c)).cast("long").alias(c) for c in ("value", "level", "parent")])
    reset = materialize(reset, p.name)
    into = edges.join(lost.select(F.col("id").alias("dst")), "dst", "left_semi")
    pulled = offers(p, into.unionByName(change.added.select(*edges.columns)), reset)
    return fixpoint(p, graph, edges, materialize(merged(reset, pulled), p.name))
