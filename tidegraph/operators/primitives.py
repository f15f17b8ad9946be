"""Scans, packs, comparisons and counts over tables.

Prefix scans over a whole table are made of blocks: a block's own running sums
need only its rows, and the blocks' totals are few; no task sees all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids to a block.
BLOCK = 1 << 16


def scan(df: DataFrame, order: str, value: str, name: str, how: str = "sum", inclusive: bool = True, backward: bool = False) -> DataFrame:
    """Running sum, min or max of ``value`` in the order of a long column, forward or backward.

    An exclusive scan starts with 0 for sums and null for min and max.
    """
    agg = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    both = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}[how]
    key = F.col(order) if not backward else -F.col(order)
    blocks = df.withColumn("_b", F.floor(F.col(order) / BLOCK))
    side = F.col("_b") if not backward else -F.col("_b")
    totals = blocks.groupBy("_b").agg(agg(value).alias("_t"))
    totals = totals.select("_b", agg("_t").over(Window.orderBy(side).rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inside = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return blocks.join(totals, "_b").withColumn(name, both(F.col("_before"), agg(value).over(inside))).drop("_b", "_before")


def fill_from_right(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """The smallest value at or after each row: fills gaps in offsets."""
    return scan(df, order, value, name, "min", True, True)


def pack(df: DataFrame, keep: Column, order: str) -> DataFrame:
    """The kept rows with their dense positions from 0."""
    kept = df.where(keep).withColumn("_one", F.lit(1))
    return scan(kept, order, "_one", "position", inclusive=False).drop("_one")


def set_bits(df: DataFrame, flag: str) -> DataFrame:
    return df.agg(F.count_if(flag).alias("n"))


def out_neighbours(edges: DataFrame, subset: DataFrame, where: Column | None = None) -> DataFrame:
    """Number of out-edges of a vertex subset, of all or of those that satisfy a condition."""
    e = edges if where is None else edges.where(where)
    return e.join(subset.select(F.col("id").alias("src")), "src", "left_semi").agg(F.count(F.lit(1)).alias("n"))


def active_edges(frontier: DataFrame, degrees: DataFrame) -> DataFrame:
    """Edges that a frontier would push along: its out-degrees' sum."""
    return degrees.join(frontier.select("id").distinct(), "id", "left_semi").agg(F.coalesce(F.sum("out_degree"), F.lit(0)).cast("long").alias("n"))


def compare(a: DataFrame, b: DataFrame, values: list[str], tolerances: int = 6) -> DataFrame:
    """(tolerance, mismatches) for 1, 0.1, …: rows in which some value differs by more, or that one side lacks."""
    left = a.select("id", *[F.col(v).alias(f"_a{k}") for k, v in enumerate(values)], F.lit(True).alias("_in_a"))
    right = b.select("id", *[F.col(v).alias(f"_b{k}") for k, v in enumerate(values)], F.lit(True).alias("_in_b"))
    both = left.join(right, "id", "full_outer")
    worst = F.greatest(*[F.abs(F.col(f"_a{k}") - F.col(f"_b{k}")) for k in range(len(values))], F.lit(0.0))
    lone = F.col("_in_a").isNull() | F.col("_in_b").isNull()
    counts = both.agg(*[F.count_if(lone | (worst > 10.0**-k)).alias(f"t{k}") for k in range(tolerances)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(10.0**-k).alias("tolerance"), F.col(f"t{k}").alias("mismatches")) for k in range(tolerances)])).alias("x")).select("x.*")


def differences(a: DataFrame, b: DataFrame, values: list[str], tolerance: float) -> DataFrame:
    """The rows that differ by more than ``tolerance``."""
    both = a.select("id", *[F.col(v).alias(f"a_{v}") for v in values]).join(b.select("id", *[F.col(v).alias(f"b_{v}") for v in values]), "id", "full_outer")
    far = F.lit(False)
    for v in values:
        far = far | F.coalesce(F.abs(F.col(f"a_{v}") - F.col(f"b_{v}")) > tolerance, F.lit(True))
    return both.where(far)
