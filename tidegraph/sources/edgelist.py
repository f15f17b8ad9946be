"""Edge lists, adjacency files, side files, operation files and result files as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.primitives import scan
from .storage import materialize

HEADERS = {False: "AdjacencyGraph", True: "WeightedAdjacencyGraph"}


def _fields(line: Column) -> Column:
    return F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\s+")


def read_edge_list(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """``src dst [payload]`` lines; lines that start with # are comments. The payload stays a string."""
    f = _fields(F.col("value"))
    df = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(ltrim(value), '#')")
    columns = [F.try_element_at(f, F.lit(1)).try_cast("long").alias("src"), F.try_element_at(f, F.lit(2)).try_cast("long").alias("dst")]
    return df.select(*columns, *[F.try_element_at(f, F.lit(3)).alias("payload")] * weighted).where("src IS NOT NULL AND dst IS NOT NULL")


def in_file_order(lines: DataFrame) -> DataFrame:
    """(seq, value): lines numbered in the order of files, blocks and places; the numbers grow but have gaps.

    ``lines`` has value, file_path and file_block_start; Spark reads files by size, so only these tell the order.
    """
    placed = lines.withColumn("place", F.monotonically_increasing_id())
    return placed.orderBy("file_path", "file_block_start", "place").select(F.monotonically_increasing_id().alias("seq"), "value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, value) of a file or folder of operations."""
    return in_file_order(spark.read.option("recursiveFileLookup", "true").text(path).select("value", "_metadata.file_path", "_metadata.file_block_start"))


def numbered_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(i, t): white-space separated tokens of a file or folder, numbered from 0 in file order.

    Tokens are numbered within a file's blocks and the blocks' totals are added
    up, so a large file is read and numbered by many tasks.
    """
    place = [F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b")]
    lines = spark.read.text(path).select("value", *place, F.monotonically_increasing_id().alias("m"))
    tokens = lines.select("f", "b", "m", F.posexplode(F.split("value", r"\s+")).alias("p", "t")).where("t <> ''")
    tokens = tokens.withColumn("k", F.row_number().over(Window.partitionBy("f", "b").orderBy("m", "p")))
    totals = tokens.groupBy("f", "b").agg(F.count(F.lit(1)).alias("n"))
    totals = totals.select("f", "b", (F.sum("n").over(Window.orderBy("f", "b")) - F.col("n")).alias("before"))
    return tokens.join(totals, ["f", "b"]).select((F.col("before") + F.col("k") - 1).cast("long").alias("i"), "t")


def read_adjacency(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of an adjacency file: header, n, m, n offsets, m targets, and m payloads if weighted.

    A source holds the targets from its offset to the next one; targets are then
    joined by their number.
    """
    tokens = materialize(numbered_tokens(spark, path), "tokens")
    head = {r["i"]: r["t"] for r in tokens.where("i < 3").collect()}
    if head.get(0) not in HEADERS.values():
        raise ValueError(f"unknown header {head.get(0)!r}")
    weighted, n, m = head[0] == HEADERS[True], int(head[1]), int(head[2])
    count = tokens.count()
    if count != 3 + n + m * (2 if weighted else 1):
        raise ValueError(f"{count} tokens do not fit n={n}, m={m}")
    body = tokens.where("i >= 3").select((F.col("i") - 3).cast("long").alias("i"), "t")
    # offsets grow with the source: a target's source is the largest one whose offset is at or before its number. Of
    # sources with one offset only the last has targets; a running maximum carries it on, by blocks
    starts = body.where(F.col("i") < n).groupBy(F.col("t").cast("long").alias("i")).agg(F.max("i").alias("src")).where(F.col("i") < m)
    targets = body.where((F.col("i") >= n) & (F.col("i") < n + m)).select((F.col("i") - n).alias("i"), F.col("t").cast("long").alias("dst"))
    edges = scan(targets.join(starts, "i", "left"), "i", "src", "_src", "max").select(F.col("_src").alias("src"), "i", "dst")
    if weighted:
        edges = edges.join(body.where(F.col("i") >= n + m).select((F.col("i") - n - m).alias("i"), F.col("t").alias("payload")), "i")
    return spark.range(n), edges.drop("i")


def adjacency(edges: DataFrame, payload: str | None = None) -> DataFrame:
    """(id, neighbours): sorted targets, or (target, payload) pairs, of every source."""
    item = F.struct("dst", payload) if payload else F.col("dst")
    return edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(item)).alias("neighbours"))


def offsets(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, offset): exclusive prefix sum of out-degrees in id order.

    Block sums first, so that no single task scans all vertices: ids are grouped
    into ranges, ranges are summed, and the running sums are local to a range.
    """
    size = 1 << 16
    degree = vertices.join(edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree")), "id", "left")
    degree = degree.select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), F.floor(F.col("id") / size).alias("range"))
    before = degree.groupBy("range").agg(F.sum("degree").alias("total"))
    before = before.select("range", (F.sum("total").over(Window.orderBy("range")) - F.col("total")).alias("before"))
    inside = Window.partitionBy("range").orderBy("id")
    run = degree.join(before, "range").withColumn("offset", F.col("before") + F.sum("degree").over(inside) - F.col("degree"))
    return run.select("id", "degree", F.col("offset").cast("long").alias("offset"))


def write_adjacency(vertices: DataFrame, edges: DataFrame, path: str, payload: str | None = None) -> None:
    """One token a line, in the file's order: header, n, m, offsets, targets, payloads."""
    n, m = vertices.count(), edges.count()
    spark = vertices.sparkSession
    head = spark.createDataFrame([(0, 0, 0, HEADERS[payload is not None]), (0, 1, 0, str(n)), (0, 2, 0, str(m))], "part int, a long, b long, token string")
    near = edges.withColumn("b", F.row_number().over(Window.partitionBy("src").orderBy("dst", *[payload] * (payload is not None))).cast("long"))
    parts = [head, offsets(vertices, edges).select(F.lit(1).alias("part"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.col("offset").cast("string").alias("token")), near.select(F.lit(2).alias("part"), F.col("src").alias("a"), "b", F.col("dst").cast("string").alias("token"))]
    if payload:
        parts.append(near.select(F.lit(3).alias("part"), F.col("src").alias("a"), "b", F.col(payload).cast("string").alias("token")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    whole.orderBy("part", "a", "b").select("token").write.mode("overwrite").text(path)


def snap_to_adjacency(spark: SparkSession, source: str, target: str, symmetric: bool = False, weighted: bool = False) -> None:
    """The converter: edge list in, adjacency file out."""
    from ..operators.graph import Graph, symmetrise

    edges = read_edge_list(spark, source, weighted)
    edges = symmetrise(edges) if symmetric else edges
    g = Graph.of(edges)
    write_adjacency(g.vertices, g.edges, target, "payload" if weighted else None)


def write_edges(edges: DataFrame, path: str) -> None:
    """Edges in (src, dst) order, one a line; a payload follows."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    edges.orderBy("src", "dst", *rest).select(F.concat_ws(" ", "src", "dst", *[F.col(c).cast("string") for c in rest])).write.mode("overwrite").text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of a side file (seeds, partition members), separated by white space."""
    return spark.read.text(path).select(F.explode(_fields(F.col("value"))).alias("t")).select(F.col("t").try_cast("long").alias("id")).where("id IS NOT NULL").distinct()


def flagged(vertices: DataFrame, ids: DataFrame, name: str, default: Column | None = None) -> DataFrame:
    """vertices with a boolean column: in ``ids``, else ``default`` (false)."""
    marked = ids.select("id", F.lit(True).alias(name)).distinct()
    return vertices.join(marked, "id", "left").withColumn(name, F.coalesce(F.col(name), default if default is not None else F.lit(False)))


def result_lines(result: DataFrame, values: list[str], flag: str | None = None) -> DataFrame:
    """``id in_degree out_degree [flag] value…`` with 13 decimals for doubles."""
    kinds = dict(result.dtypes)
    text = lambda c: F.format_string("%.13f", c) if kinds[c] == "double" else F.col(c).cast("string")
    columns = [F.col(c).cast("string") for c in ("id", "in_degree", "out_degree")]
    if flag:
        columns.append(F.col(flag).cast("int").cast("string"))
    return result.select(F.col("id"), F.concat_ws(" ", *columns, *map(text, values)).alias("line"))


def write_result(result: DataFrame, path: str, version: int, values: list[str], flag: str | None = None) -> None:
    """Version k of a result; writing it again replaces it."""
    result_lines(result, values, flag).orderBy("id").select("line").write.mode("overwrite").text(f"{path}/version={version}")


def read_result(spark: SparkSession, path: str, version: int, values: list[str], flag: str | None = None) -> DataFrame:
    f = _fields(F.col("value"))
    names = ["id", "in_degree", "out_degree", *([flag] if flag else []), *values]
    kinds = ["long"] * 3 + ["int"] * bool(flag) + ["double"] * len(values)
    return spark.read.text(f"{path}/version={version}").select(*[F.get(f, F.lit(k)).cast(t).alias(c) for k, (c, t) in enumerate(zip(names, kinds, strict=True))])
