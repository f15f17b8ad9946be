"""Edge operations: parse, batch, cancel, validate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import Change, Graph, apply, instances, unmatched_deletes
from .primitives import scan


def parse_ops(lines: DataFrame, weighted: bool = False) -> DataFrame:
    """(seq, op, src, dst, [payload,] reason) of (seq, value) lines; ``reason`` is null for a usable operation.

    Comments (% and #) and unknown letters are reported, use up their place in a
    batch, and are otherwise ignored.
    """
    f = F.split(F.trim("value"), r"\s+")
    want = 4 if weighted else 3
    long = lambda k: F.get(f, F.lit(k)).try_cast("long")
    op = F.get(f, F.lit(0))
    reason = (
        F.when(F.trim("value") == "", "empty").when(F.substring(F.trim("value"), 1, 1).isin("%", "#"), "comment").when(~op.isin("a", "d"), "unknown operation")
        .when(F.size(f) != want, "wrong arity").when(long(1).isNull() | long(2).isNull() | (long(1) < 0) | (long(2) < 0), "bad id")
    )
    return lines.select("seq", op.alias("op"), long(1).alias("src"), long(2).alias("dst"), *[F.get(f, F.lit(3)).alias("payload")] * weighted, reason.alias("reason"))


def batched(ops: DataFrame, size: int, fixed: bool = False) -> DataFrame:
    """Adds ``batch``: ``size`` operations each, in seq order; no task orders all of them.

    Fixed batches hold ``size`` usable operations; unusable ones (``reason``) go with the batch that reads them.
    """
    low, top, n = ops.agg(F.min("seq"), F.max("seq"), F.count(F.lit(1))).first()
    if not fixed and n and top - low + 1 == n:
        return ops.withColumn("batch", F.floor((F.col("seq") - low) / size).cast("long"))
    one = ops.withColumn("_one", F.col("reason").isNull().cast("long") if fixed else F.lit(1).cast("long"))
    return scan(one, "seq", "_one", "_read", inclusive=False).withColumn("batch", F.floor(F.coalesce("_read", F.lit(0)) / size).cast("long")).drop("_one", "_read")


def cancelled(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(left, gone): an addition and a deletion of one (src, dst) annihilate one for one, the latest ones of each kind."""
    number = F.row_number().over(Window.partitionBy("src", "dst", "op").orderBy("seq"))
    pair = Window.partitionBy("src", "dst")
    adds, dels = F.count(F.when(F.col("op") == "a", 1)).over(pair), F.count(F.when(F.col("op") == "d", 1)).over(pair)
    df = ops.withColumns({"_i": number, "_both": F.least(adds, dels), "_own": F.when(F.col("op") == "a", adds).otherwise(dels)})
    keep = F.col("_i") <= F.col("_own") - F.col("_both")
    return df.where(keep).select(*ops.columns), df.where(~keep).select(*ops.columns)


def distinct_ops(ops: DataFrame, symmetric: bool = False) -> DataFrame:
    """The first of equal operations; without direction if symmetric."""
    key = [F.least("src", "dst"), F.greatest("src", "dst")] if symmetric else [F.col("src"), F.col("dst")]
    return ops.withColumn("_i", F.row_number().over(Window.partitionBy("op", *key).orderBy("seq"))).where("_i = 1").drop("_i")


@dataclass(frozen=True)
class Options:
    """``enforce_validity``: deletions of absent edges are reported and taken out; without it they have no effect, unreported."""

    symmetric: bool = False
    simple: bool = False
    enforce_validity: bool = True
    fixed_size: bool = False


def effective(graph: Graph, ops: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(adds, deletes, rejected with reason): what a batch does to ``graph``.

    Existence is judged on the graph before the batch, in the order: comments and
    bad lines, repeats (simple), cancellation (unless fixed_size), range, existence.
    """
    bad = ops.where("reason IS NOT NULL")
    good = ops.where("reason IS NULL")
    rejected = [bad]
    say = lambda df, why: df.withColumn("reason", F.lit(why))
    if options.simple:
        kept = distinct_ops(good, options.symmetric)
        rejected.append(say(good.join(kept.select("seq"), "seq", "left_anti"), "repeated in batch"))
        good = kept
    if not options.fixed_size:
        good, gone = cancelled(good)
        rejected.append(say(gone, "cancelled"))
    n = graph.vertices.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]
    deletes, adds = good.where("op = 'd'"), good.where("op = 'a'")
    out = (F.col("src") >= n) | (F.col("dst") >= n)
    rejected.append(say(deletes.where(out), "out of range"))
    deletes = deletes.where(~out)
    if options.enforce_validity:
        missing = unmatched_deletes(graph.edges, deletes)
        rejected.append(say(missing, "no such edge"))
        deletes = deletes.join(missing.select("seq"), "seq", "left_anti").select(*good.columns)
    if options.simple:
        there = adds.join(graph.edges.select("src", "dst"), ["src", "dst"], "left_semi").select(*good.columns)
        rejected.append(say(there, "edge exists"))
        adds = adds.join(there.select("seq"), "seq", "left_anti").select(*good.columns)
    whole = rejected[0]
    for r in rejected[1:]:
        whole = whole.unionByName(r)
    return adds, deletes, whole


def process_batch(graph: Graph, ops: DataFrame, options: Options = Options()) -> tuple[Change, DataFrame]:
    """(change, rejected): deletions, growth, additions."""
    adds, deletes, rejected = effective(graph, ops, options)
    return apply(graph, adds.drop("seq", "op", "reason"), deletes.select("src", "dst"), options.symmetric), rejected


def replay(ops: DataFrame, size: int, path: str) -> int:
    """Writes operations as one text folder per batch, for a streaming source; returns the number of batches."""
    line = F.concat_ws("\t", "op", "src", "dst", *[c for c in ("payload",) if c in ops.columns])
    rows = batched(ops, size)
    rows.repartition("batch").sortWithinPartitions("batch", "seq").select("batch", line.alias("value")).write.mode("overwrite").partitionBy("batch").text(path)
    return rows.agg(F.coalesce(F.max("batch") + 1, F.lit(0))).first()[0]


__all__ = ["Options", "batched", "cancelled", "distinct_ops", "effective", "instances", "parse_ops", "process_batch", "replay"]
