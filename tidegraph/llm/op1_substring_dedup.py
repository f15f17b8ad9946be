"""Substring dedup by level-wise doubling.

Which windows of ``window`` words start earlier elsewhere is found level by
level. Level 0 looks at windows of half the length, and of those only at
content-chosen ones: the smallest hash among the half-windows inside each full
window, so that equal full windows always look at equal half-windows. Only
half-windows that the corpus repeats are extended to twice their length; the
full windows around them are compared by hash, and every one that is not the
first of its kind is removed. If no half-window repeats, the next level has no
candidate and the documents stay as they are.

Data movement: half-window hashes (a sixth of the words), compressed texts by
doc_id (one exchange, used twice), hashes of candidate windows, and removal
marks. Before each shuffle by hash a task settles what it can alone: of equal
hashes in one batch only one row travels, so the rows of one hash are bounded by
the number of batches, not by the number of copies.

doc_id orders documents; see ``common.identified`` for nulls and repeats. A null
or empty text has no words; a text shorter than the window loses none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary, groups, identified, joined, table, windows, word_hashes

WINDOW = 20


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    done, m = 1, x
    while done * 2 <= width:
        m = np.minimum(m[: len(m) - done], m[done:])
        done *= 2
    return m if done == width else np.minimum(m[: len(m) - (width - done)], m[width - done :])


def _rows(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=names)


def candidates(window: int):
    """Level 0. Rows (key, doc_id, at, sure): ``sure`` ones are known to repeat, others need the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in groups(batches):
            hashes, docs, places = [], [], []
            for i, t in zip(ids, texts, strict=True):
                h = word_hashes(t)
                if len(h) < window:
                    continue
                half = windows(h, window // 2)
                low = sliding_min(half, window - window // 2 + 1)
                chosen = np.unique(low)
                # every place of a chosen hash, so that repeats within the text count
                at = np.flatnonzero(np.isin(half, chosen))
                hashes.append(half[at])
                places.append(at)
                docs.append(np.full(len(at), i, np.int64))
            if not hashes:
                continue
            hashes, docs, places = np.concatenate(hashes), np.concatenate(docs), np.concatenate(places)
            order = np.argsort(hashes, kind="stable")
            hashes, docs, places = hashes[order], docs[order], places[order]
            first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
            size = np.diff(np.append(first, len(hashes)))
            alone = np.repeat(size == 1, size)
            sure = ~alone
            # of a document's equal sure hashes one is enough
            keep = sure & np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])))
            told = first[size > 1]  # tells other tasks that the hash was here
            key = np.concatenate((hashes[alone], hashes[told], docs[keep].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            doc = np.concatenate((docs[alone], docs[told], docs[keep]))
            at = np.concatenate((places[alone], np.full(len(told), -1), places[keep])).astype(np.int32)
            yield _rows(["key", "doc_id", "at", "sure"], pa.array(key.view(np.int64)), pa.array(doc), pa.array(at), pa.array(np.arange(len(key)) >= len(key) - int(keep.sum())))

    return run


def full_windows(window: int):
    """Level 1. From (doc_id, packed text, places): rows (key, doc_id, at, run, sure).

    A sure row says that ``run`` windows from ``at`` on are not first; any other
    row is the first of its hash in the batch and competes with other batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        names = ["key", "doc_id", "at", "run", "sure"]

        def out(hashes, docs, places):
            hashes, docs, places = np.concatenate(hashes), np.concatenate(docs), np.concatenate(places)
            order = np.lexsort((places, docs, hashes))
            h, d, a = hashes[order], docs[order], places[order]
            first = np.concatenate(([True], h[1:] != h[:-1]))
            yield _rows(names, pa.array(h[first].view(np.int64)), pa.array(d[first]), pa.array(a[first].astype(np.int32)), pa.array(np.ones(int(first.sum()), np.int32)), pa.array(np.zeros(int(first.sum()), bool)))
            d, a = d[~first], a[~first]
            if len(d):
                order = np.lexsort((a, d))
                d, a = d[order], a[order]
                new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (a[1:] != a[:-1] + 1))))
                length = np.diff(np.append(new, len(d)))
                key = d[new].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                yield _rows(names, pa.array(key.view(np.int64)), pa.array(d[new]), pa.array(a[new].astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(np.ones(len(new), bool)))

        hashes, docs, places, held = [], [], [], 0
        for batch in batches:
            for i, packed, at in zip(batch.column(0).to_pylist(), binary(batch.column(1)), batch.column(2), strict=True):
                h = word_hashes(unpack(packed))
                at = at.values.to_numpy(zero_copy_only=False)
                at = at[at >= 0]
                if len(h) < window or not len(at):
                    continue
                half = windows(h, window // 2)
                low = sliding_min(half, window - window // 2 + 1)
                start = np.flatnonzero(np.isin(low, half[at]))
                if not len(start):
                    continue
                whole = joined(half[: len(half) - window // 2], half[window // 2 :])
                hashes.append(whole[start])
                docs.append(np.full(len(start), i, np.int64))
                places.append(start)
                held += len(start)
                if held > 1_000_000:
                    yield from out(hashes, docs, places)
                    hashes, docs, places, held = [], [], [], 0
        if hashes:
            yield from out(hashes, docs, places)

    return run


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, packed, carried): texts compressed before they are shuffled.

    The filter is what an inner join would add to its side: with it both joins
    have the same exchange, and Spark shuffles the texts once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield _rows(["doc_id", "packed", "carried"], batch.column(0), pa.array([pack(t or b"") for t in binary(batch.column(1))], pa.binary()), batch.column(2))

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("packed", T.BinaryType()), docs.schema["carried"]])
    return docs.select("doc_id", "text", "carried").mapInArrow(run, schema).where("doc_id IS NOT NULL")


def repeats(docs: DataFrame, packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, runs): array of (at, run), ``run`` windows from word ``at`` on that start earlier elsewhere."""
    if window % 2:
        raise ValueError("the window must be twice a whole number of words")
    rows = docs.select("doc_id", "text").mapInArrow(candidates(window), "key long, doc_id long, at int, sure boolean")
    same = Window.partitionBy("key")
    survive = rows.withColumn("n", F.count(F.lit(1)).over(same)).where("at >= 0 AND (sure OR n > 1)")
    survive = survive.groupBy("doc_id").agg(F.collect_list("at").alias("places"))
    # all of packed's columns, so that this side's exchange is the same as the last join's
    rows = packed.join(survive, "doc_id").select("doc_id", "packed", "places", *packed.columns[2:]).mapInArrow(full_windows(window), "key long, doc_id long, at int, run int, sure boolean")
    first = F.min(F.when(~F.col("sure"), F.struct("doc_id", "at"))).over(same)
    later = rows.withColumn("first", first).where("sure OR struct(doc_id, at) > first")
    return later.groupBy("doc_id").agg(F.collect_list(F.struct("at", "run")).alias("runs"))


def covered(n: int, runs: np.ndarray | None, lengths: np.ndarray | None, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a removed window."""
    delta = np.zeros(n + 1, np.int64)
    if runs is not None and len(runs):
        np.add.at(delta, runs, 1)
        np.add.at(delta, runs + lengths + window - 1, -1)
    return np.cumsum(delta[:-1]) > 0


def dedup(docs: DataFrame, window: int = WINDOW, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept, carried columns) of every identified document.

    ``kept`` is the text itself where nothing was removed, else the kept words
    joined by single spaces. Carried columns travel with the texts, so that a
    caller needs no further join.
    """
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
    if set(carried) & set(names):
        raise ValueError(f"columns of these names are results: {names}")
    # carried columns travel in a struct, so that their names meet no other's
    docs = docs.select("doc_id", "text", (F.struct(*[F.col(f"`{c}`") for c in carried]) if carried else F.struct(F.lit(0).alias("none"))).alias("carried"))
    docs = identified(docs, "carried")
    packed = packed_texts(docs)
    whole = packed.join(repeats(docs, packed, window), "doc_id", "left").select("doc_id", "packed", "runs.at", "runs.run", "carried")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            n, gone, digest, kept = [], [], [], []
            for packed, at, run in zip(binary(batch.column(1)), batch.column(2), batch.column(3), strict=True):
                text = unpack(packed)
                words = text.split()
                n.append(len(words))
                if at.is_valid:
                    out = covered(len(words), at.values.to_numpy(), run.values.to_numpy(), window)
                    words = [w for w, o in zip(words, out.tolist(), strict=True) if not o]
                gone.append(n[-1] - len(words))
                left = b" ".join(words)
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left if gone[-1] else text)
            yield _rows([*names, "carried"], batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary()).cast(pa.string()), batch.column(4))

    kinds = (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.StringType())
    schema = T.StructType([*(T.StructField(c, k) for c, k in zip(names, kinds, strict=True)), docs.schema["carried"]])
    return whole.mapInArrow(run, schema).select(*names, *[F.col(f"carried.`{c}`") for c in carried])


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("kept")
