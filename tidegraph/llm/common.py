"""What the corpus operators share: shared storage, words, hashes, batches.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; ``bytes.split``
breaks at exactly those, and a UTF-8 continuation byte is never one of them.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy step handles; bounds a Python worker's memory.
GROUP_BYTES = 6_000_000

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where none is set (tests)."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    own = getattr(shared_dir, "own", None)
    if own is None:
        holder = tempfile.TemporaryDirectory(prefix="tidegraph-")
        atexit.register(holder.cleanup)
        own = shared_dir.own = f"file://{holder.name}"
    return own


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` to the shared folder and reads it back.

    A lost executor then costs a reread, not a recomputation, and every later
    use sees the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def repeated_ids(docs: DataFrame) -> bool:
    """Whether some doc_id has several rows; reads the id column alone."""
    return not docs.groupBy("doc_id").count().where("count > 1").isEmpty()


def identified(docs: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, text, carried columns) with one row per doc_id.

    Rows without a doc_id have no identity and are left out. Rows that repeat a
    doc_id count as one document: equal texts once, different texts joined by a
    line break in text order; of a carried column the smallest value stays.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried).where("doc_id IS NOT NULL")
    if not repeated_ids(docs):
        return docs
    return docs.groupBy("doc_id").agg(F.concat_ws("\n", F.sort_array(F.collect_set("text"))).alias("text"), *[F.min(c).alias(c) for c in carried])


def binary(column: pa.Array) -> list[bytes | None]:
    """A string or binary column's values as bytes."""
    return (column if pa.types.is_binary(column.type) else column.cast(pa.binary())).to_pylist()


def groups(batches: Iterable[pa.RecordBatch], limit: int = GROUP_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts) of some documents at a time, from (id, text) batches; a null text is empty."""
    ids: list = []
    texts: list[bytes] = []
    held = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), binary(batch.column(1)), strict=True):
            t = t or b""
            if texts and held + len(t) > limit:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(t)
            held += len(t)
    if texts:
        yield ids, texts


def word_hashes(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring sequences from their hashes."""
    z = x * _A + (y ^ (y >> np.uint64(31))) * _B
    z ^= z >> np.uint64(29)
    return z * _A


def windows(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of ``length`` words, doubling up from single words."""
    if length == 1:
        return h
    half = windows(h, length // 2)
    whole = joined(half[: len(half) - length // 2], half[length // 2 :])
    if length % 2:
        whole = joined(whole[: len(h) - length + 1], h[length - 1 :])
    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
