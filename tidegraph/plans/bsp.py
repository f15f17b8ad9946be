"""Synchronous vertex programs: run to convergence, and refine after a batch.

A program is a few column expressions; a superstep is one plan: state joined to
edges on the source, messages summed by destination, state joined to the sums.
Edges are placed by source once per graph version, so only state rows and partial
sums move. Every superstep's state, with the sums it was computed from, is written to
shared storage (short lineage, recovery from lost executors) and is the history that
refinement starts from.

Sums are kept up to date by signed rows: a source whose message changes retracts the old
message (sign -1) and propagates the new one along its out-edges. From scratch that is
done for the vertices that moved, once they are few (the frontier); after a batch for
sources that differ from the old run, or whose own edges or side data changed: the old
out-edges retract the old messages, the new ones propagate the new messages. A count of
messages goes with the sums, so that a vertex without messages has sums of exactly 0.
Vertices that receive nothing, and whose side data and previous value are the same, keep
the old run's row. Programs whose sums cannot be corrected (``use_delta``) pull all
messages of the affected vertices instead.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import Change, Graph
from ..sources.storage import materialize


@dataclass(frozen=True)
class VertexProgram:
    """``side`` gives id + side columns; messages see source columns as ``s_*`` and edge columns; updates see sums as ``a_*``."""

    name: str
    values: tuple[str, ...]
    side: Callable[[Graph], DataFrame]
    init: Callable[[DataFrame], DataFrame]  # adds the value columns to (id, side…)
    edges: Callable[[Graph, DataFrame], DataFrame]  # (src, dst, w…), from the graph and the side table
    message: Callable[[], dict[str, Column]]
    update: Callable[[], dict[str, Column]]
    #: Side columns of the source that messages use.
    sent_side: tuple[str, ...] = ()
    #: Which vertices compute at iteration i (others keep their value).
    computes: Callable[[int], Column] = lambda i: F.lit(True)
    #: Whether iteration i may correct sums by signed rows instead of summing all messages.
    use_delta: Callable[[int], bool] = lambda i: True
    #: The sign's message where it is not sign * message (a message that is not summed linearly).
    message_delta: Callable[[], dict[str, Column]] | None = None
    #: Vertices that push at iteration i although they have not moved.
    force_push: Callable[[int], Column] = lambda i: F.lit(False)
    #: Iterations that run whether or not the one before changed anything.
    forced: int = 1
    epsilon: float = 0.01
    max_iters: int = 10


@dataclass
class Run:
    """States of all iterations (0 = start) on one graph."""

    program: VertexProgram
    graph: Graph
    side: DataFrame
    edges: DataFrame
    states: list[DataFrame] = field(default_factory=list)
    seconds: list[float] = field(default_factory=list)
    work: list[int] = field(default_factory=list)
    converged: bool = False

    #: Vertices that moved in the last iteration, and all.
    moved: int | None = None
    size: int | None = None

    @property
    def final(self) -> DataFrame:
        return self.states[-1].drop("changed", *sums_of(self.program))

    def release(self) -> None:
        """Gives back the memory of the placed edges; the run can no longer be refined cheaply."""
        self.edges.unpersist()

    def at(self, i: int) -> DataFrame:
        """The state of iteration i; after convergence the last one."""
        return self.states[min(i, len(self.states) - 1)]

    def result(self) -> DataFrame:
        """(id, in_degree, out_degree, values)."""
        return self.graph.degrees().join(self.final.select("id", *self.program.values), "id")

    def history(self, ids: list[int] | None = None) -> DataFrame:
        """(iter, id, values): all, or of some vertices."""
        rows = None
        for i, s in enumerate(self.states):
            s = s if ids is None else s.where(F.col("id").isin(ids))
            s = s.select(F.lit(i).alias("iter"), "id", *self.program.values)
            rows = s if rows is None else rows.unionByName(s)
        return rows


def prepare(program: VertexProgram, graph: Graph) -> tuple[DataFrame, DataFrame]:
    side = materialize(program.side(graph), f"{program.name}-side")
    edges = program.edges(graph, side).repartition("src").persist()
    return side, edges


#: A frontier of at most one vertex in so many pushes signed rows.
FEW = 4


def sums_of(program: VertexProgram) -> list[str]:
    """The state's columns of sums, the number of messages last."""
    return [*(f"a_{c}" for c in program.message()), "a_n"]


def sent(program: VertexProgram, state: DataFrame, sign: int) -> DataFrame:
    """(src, s_…, sign): what messages see of their sources."""
    return state.select(F.col("id").alias("src"), *[F.col(c).alias(f"s_{c}") for c in (*program.values, *program.sent_side)], F.lit(sign).alias("sign"))


def summed(program: VertexProgram, pushed: DataFrame) -> DataFrame:
    """(id, a_…, a_n): the sums of signed messages by destination, from edges joined to their sources."""
    whole = program.message_delta() if program.message_delta else {c: e * F.col("sign") for c, e in program.message().items()}
    parts = pushed.select("dst", *[e.alias(c) for c, e in whole.items()], "sign")
    return parts.groupBy(F.col("dst").alias("id")).agg(*[F.sum(c).alias(f"a_{c}") for c in whole], F.sum("sign").cast("long").alias("a_n"))


def messages(program: VertexProgram, state: DataFrame, edges: DataFrame) -> DataFrame:
    """The sums of all messages."""
    return summed(program, edges.join(sent(program, state, 1), "src"))


def corrected(program: VertexProgram, sums: DataFrame, delta: DataFrame) -> DataFrame:
    """Old sums (of any ids) plus the delta, for the delta's ids."""
    names = sums_of(program)
    both = delta.join(sums.select("id", *[F.col(c).alias(f"o_{c}") for c in names]), "id", "left")
    n = F.coalesce("o_a_n", F.lit(0)) + F.col("a_n")
    exact = [F.when(n == 0, 0.0).otherwise(F.coalesce(F.col(f"o_{c}"), F.lit(0.0)) + F.col(c)).alias(c) for c in names[:-1]]
    return both.select("id", *exact, n.alias("a_n"))


def computed(program: VertexProgram, state: DataFrame, sums: DataFrame, i: int) -> DataFrame:
    """State after iteration i: new values where they differ enough, whether they did, and the sums."""
    names = sums_of(program)
    joined = state.drop("changed", *names).join(sums, "id", "left")
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in names[:-1]} | {"a_n": F.coalesce("a_n", F.lit(0).cast("long"))})
    new = {f"n_{c}": e for c, e in program.update().items()}
    joined = joined.withColumns(new)
    moved = F.lit(False)
    for c in program.values:
        moved = moved | (F.abs(F.col(f"n_{c}") - F.col(c)) > program.epsilon)
    joined = joined.withColumn("changed", program.computes(i) & F.coalesce(moved, F.lit(False)))
    keep = {c: F.when(F.col("changed"), F.col(f"n_{c}")).otherwise(F.col(c)) for c in program.values}
    return joined.withColumns(keep).drop(*new).select(*[c for c in state.columns if c not in names], *names)


def advanced(run: Run, i: int) -> DataFrame:
    """The sums of iteration i from those of the one before: vertices that moved replace their messages."""
    p, state, before = run.program, run.states[-1], run.states[-2]
    push = state.where(F.col("changed") | p.force_push(i))
    signed = sent(p, push, 1).unionByName(sent(p, before.join(push.select("id"), "id", "left_semi"), -1))
    fresh = corrected(p, state, summed(p, run.edges.join(signed, "src")))
    same = state.join(fresh.select("id"), "id", "left_anti").select("id", *sums_of(p))
    return fresh.unionByName(same)


def proceed(run: Run, start: int) -> Run:
    """Iterations from ``start`` on, until nothing changes or the limit is reached."""
    p = run.program
    run.size = run.size or run.side.count()
    for i in range(start, p.max_iters + 1):
        began = time.time()
        state = run.states[-1]
        few = i > 1 and len(run.states) > 1 and run.moved is not None and run.moved * FEW <= run.size and p.use_delta(i)
        sums = advanced(run, i) if few else messages(p, state, run.edges)
        run.states.append(materialize(computed(p, state, sums, i), p.name))
        run.seconds.append(time.time() - began)
        run.moved = run.states[-1].where("changed").count()
        if i >= p.forced and not run.moved:
            run.converged = True
            break
    return run


def started(program: VertexProgram, side: DataFrame) -> DataFrame:
    first = program.init(side).withColumn("changed", F.lit(True))
    names = sums_of(program)
    return first.withColumns({c: F.lit(0.0) for c in names[:-1]} | {"a_n": F.lit(0).cast("long")})


def run(program: VertexProgram, graph: Graph) -> Run:
    side, edges = prepare(program, graph)
    out = Run(program, graph, side, edges)
    out.states.append(materialize(started(program, side), program.name))
    return proceed(out, 1)


def differing(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Ids whose columns differ, or that only one of the two has."""
    left = a.select("id", F.struct(*columns).alias("x")) if columns else a.select("id", F.lit(0).alias("x"))
    right = b.select("id", F.struct(*columns).alias("y")) if columns else b.select("id", F.lit(0).alias("y"))
    return left.join(right, "id", "full_outer").where("NOT (x <=> y)").select("id")


def refine(old: Run, change: Change) -> Run:
    """The run of the changed graph, from the old run's history."""
    p = old.program
    graph = change.after
    side, edges = prepare(p, graph)
    out = Run(p, graph, side, edges)
    start = started(p, side)
    out.states.append(materialize(start, p.name))

    columns = [c for c in side.columns if c != "id"]
    own = differing(old.side, side, columns)
    other = differing(old.side, side, list(p.sent_side)) if p.sent_side else side.select("id").join(old.side.select("id"), "id", "left_anti")
    # sources that push other messages whatever their value: their side data or their own edges changed
    turned = other.union(change.added.select("src")).union(change.deleted.select("src")).distinct()
    touched = change.added.select(F.col("dst").alias("id")).union(change.deleted.select(F.col("dst").alias("id")))
    fixed = materialize(own.union(touched).distinct(), "touched")
    turned = materialize(turned, "turned")
    moved = materialize(differing(old.at(0), out.states[0], list(p.values)), "moved")
    horizon = len(old.states) - 1
    for i in range(1, p.max_iters + 1):
        if i > horizon and old.converged is False:
            break
        began = time.time()
        before, after = old.at(i), out.states[-1]
        sources = moved.union(turned).distinct()
        if p.use_delta(i):
            was = old.at(i - 1).join(sources, "id", "left_semi")
            now = after.join(sources, "id", "left_semi")
            delta = summed(p, old.edges.join(sent(p, was, -1), "src").unionByName(edges.join(sent(p, now, 1), "src")))
            delta = materialize(delta.join(side.select("id"), "id", "left_semi"), "delta")
            affected = materialize(delta.select("id").union(own).union(moved).distinct().join(side.select("id"), "id", "left_semi"), "affected")
            old_sums = before.join(affected, "id", "left_semi").select("id", *sums_of(p))
            sums = corrected(p, before, delta).unionByName(old_sums.join(delta.select("id"), "id", "left_anti"))
        else:
            ends = sources.select(F.col("id").alias("src"))
            reached = edges.join(ends, "src", "left_semi").select(F.col("dst").alias("id")).union(old.edges.join(ends, "src", "left_semi").select(F.col("dst").alias("id")))
            affected = materialize(reached.union(fixed).union(moved).distinct().join(side.select("id"), "id", "left_semi"), "affected")
            sums = messages(p, after, edges.join(affected.select(F.col("id").alias("dst")), "dst", "left_semi"))
        new = computed(p, after.join(affected, "id", "left_semi"), sums, i)
        kept = before.join(affected, "id", "left_anti").select("id", *p.values, *sums_of(p)).join(side, "id")
        prior = after.select("id", F.struct(*p.values).alias("_prior"))
        kept = kept.join(prior, "id").withColumn("changed", ~F.struct(*p.values).eqNullSafe(F.col("_prior"))).drop("_prior")
        # whether a vertex differs from the old run is written with its state: no second pass
        was = before.select("id", F.struct(*p.values).alias("_was"))
        state = new.select(*start.columns).unionByName(kept.select(*start.columns)).join(was, "id", "left")
        state = materialize(state.withColumn("differs", ~F.struct(*p.values).eqNullSafe(F.col("_was"))).drop("_was"), p.name)
        moved = state.where("differs").select("id")
        out.states.append(state.drop("differs"))
        out.seconds.append(time.time() - began)
        out.work.append(affected.count())
        if i >= max(horizon, p.forced):
            out.moved = out.states[-1].where("changed").count()
            if not out.moved:
                out.converged = True
                return out
            return proceed(out, i + 1)
    return proceed(out, len(out.states)) if len(out.states) <= p.max_iters else out
