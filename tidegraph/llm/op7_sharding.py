"""Sharding by extendible hashing.

A document's place is the bits of md5(doc_id). The directory starts with one
bucket; a bucket whose texts exceed the byte limit is split on the next bit, and
only that one, until every shard fits. Sizes are first summed by prefixes of as many
bits as the total bytes ask for (``SPARE`` more than the logarithm of total / limit);
their ancestors' sums, and of these the shallowest that fit, are tables, so that
nothing but the depths that occur reaches the driver. Prefixes that are still too large
are summed again, ``DEEPER`` bits further, on their own rows alone. The documents are
read twice, without a shuffle of their texts: the directory (about twice total / limit
rows of 30 bytes) is broadcast up to ``MOST_BROADCAST`` rows, beyond it Spark joins by a
shuffle.

A bucket that no further bit can split (one document over the limit, or one
repeated id) is a shard of its own at the deepest level. Null texts have 0
bytes; a null doc_id hashes as the empty string. One row for each row of docs; its
columns travel in a struct, so any names may occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

LIMIT = 32 << 20
#: Bits of the whole hash; bits beyond the least that could do, and of a further look.
DEEPEST, SPARE, DEEPER = 60, 4, 16
MOST_BROADCAST = 2_000_000


def place(doc_id: Column) -> Column:
    """The first 60 bits of md5(doc_id) as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def split(sums: DataFrame, start: int, depth: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Buckets (depth, prefix, bytes) between the depths, and the prefixes (prefix) of ``depth`` that are still too large."""
    levels = sums.select("prefix", "bytes", F.explode(F.sequence(F.lit(start), F.lit(depth))).alias("depth"))
    levels = written(levels.groupBy("depth", F.expr(f"shiftright(prefix, {depth} - depth)").alias("prefix")).agg(F.sum("bytes").alias("bytes")), "levels")
    over, fits = levels.where(F.col("bytes") > limit), levels.where(F.col("bytes") <= limit)
    parents = over.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    halves = fits.withColumn("parent", F.shiftright("prefix", 1)).join(parents, ["depth", "parent"], "left_semi").select("depth", "prefix", "bytes")
    last = over.where(F.col("depth") == depth)
    if depth == DEEPEST:
        return fits.where(F.col("depth") == start).unionByName(halves).unionByName(last), last.where("false").select("prefix")
    return fits.where(F.col("depth") == start).unionByName(halves), last.select("prefix")


def directory(docs: DataFrame, limit: int = LIMIT, spare: int = SPARE) -> DataFrame:
    """(depth, prefix, bytes) of every bucket."""
    rows = docs.select(place(F.col("doc_id")).alias("at"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    start, depth = 0, min(DEEPEST, (total // limit).bit_length() + spare)
    buckets = None
    while True:
        found, large = split(rows.groupBy(F.shiftright("at", DEEPEST - depth).alias("prefix")).agg(F.sum("size").alias("bytes")), start, depth, limit)
        buckets = found if buckets is None else buckets.unionByName(found)
        if depth == DEEPEST or large.isEmpty():
            return written(buckets, "directory")
        rows = rows.join(large, F.shiftright("at", DEEPEST - depth) == F.col("prefix"), "left_semi")
        start, depth = depth, min(DEEPEST, depth + DEEPER)


def assign(docs: DataFrame, limit: int = LIMIT, spare: int = SPARE) -> DataFrame:
    """All rows of ``docs`` with shard (its bits as text), shard_depth and shard_bytes; columns of these names are replaced.

    The buckets' table is joined on (depth, prefix); a row carries its prefix at
    each depth that occurs in the directory, a few dozen at most.
    """
    names = [c for c in docs.columns if c not in ("shard", "shard_depth", "shard_bytes")]
    buckets = directory(docs, limit, spare)
    depths = sorted(r[0] for r in buckets.select("depth").distinct().collect())
    places = [F.struct(F.lit(d).alias("d"), F.shiftright("at", DEEPEST - d).alias("p")) for d in depths] or [F.struct(F.lit(0).alias("d"), F.lit(0).cast("long").alias("p"))]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), place(F.col("doc_id")).alias("at"))
    tried = rows.select("row", F.explode(F.array(*places)).alias("b"))
    if buckets.count() <= MOST_BROADCAST:
        buckets = F.broadcast(buckets)
    out = tried.join(buckets, (F.col("b.d") == F.col("depth")) & (F.col("b.p") == F.col("prefix")))
    shard = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    return out.select(*[F.col(f"row.`{c}`") for c in names], shard.alias("shard"), F.col("depth").alias("shard_depth"), F.col("bytes").alias("shard_bytes"))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Writes one folder for each shard; a shard's rows meet in one task, whose size the limit bounds."""
    df = assign(docs, limit)
    df.repartition("shard").write.partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents")).select("doc_id", "shard", "shard_depth", "shard_bytes")
