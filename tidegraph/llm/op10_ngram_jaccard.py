"""Exact Jaccard join of shingle sets by parity sketches.

A document's set is hashed into a wide bit sketch: every shingle flips one bit.
Equal shingles cancel, so the Hamming distance of two sketches is at most the
sets' symmetric difference. Sets with Jaccard j >= t differ in at most
D = (1-t)/(1+t) * (|A|+|B|) shingles, and at t = 0.8 in a ninth of the sizes' sum.

Pigeonhole, per size band: the sketch is cut into P pieces (P depends on the
band alone), of which at least P - D are equal in two similar documents. So under
any common order of piece contents, two similar documents share one of the first
D + 1 pieces of either. The order puts pieces that many documents have last and
pieces with more shingles first, so a passage that a third of the corpus shares
does not become a join key. A piece is kept as the XOR of its shingles' 64-bit
hashes: equal bits give equal XORs, and a chance equality only costs a check.

A document emits D + 1 keys in its own band, and again in the next band where a
partner 1/t times as large would be in it. Within a key every document is checked
against the smallest id. A key whose documents are then still in different
components is open; in rounds, every document of an open key meets about ``PIVOTS``
others of one of its keys, and a key closes when its documents have become one
component. A group of m near copies thus costs a few times m rows, not m * m. When a
round merges hardly anything any more, the pairs of the keys that are still open are
all compared. Before any check a compact parity sketch (its Hamming distance, too, is
at most the difference) rules out inside the join what cannot be similar; the check
compares the whole sets. No link is lost that could join two components: the rounds
only decide in which order links are found.

Equal word sequences are reduced to one representative first; members follow it.

Nulls, empty texts and texts without words have an empty set and are linked with
nothing. Ids: see ``common.identified``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import binary, groups, identified, table, windows, word_hashes, written
from .components import components

SHINGLE = 5
#: Similarity as a fraction of whole numbers.
THRESHOLD = (80, 100)
#: A piece that this many documents share goes last in the order; of such pieces the
#: commonest ``MOST_COMMON`` are told to the tasks (8 bytes each). Any set gives the
#: same result, a good one gives fewer checks.
COMMON, MOST_COMMON = 48, 200_000
#: Parts over which a common key's rows are dealt: at least SALTS, and one for each PART rows counted.
SALTS, PART = 64, 50_000
#: Documents of a key that the others meet in a round, and the share of the open components (one in so many) that a
#: round has to merge for another one to follow.
PIVOTS, WORTH = 16, 100
#: Bits of the compact sketch that filters pairs inside the last join.
BITS = 1024
#: Bytes of rows that a worker gets and keys that it hands back at a time. Such batches lie outside the heap, in the
#: executor as in the worker, and a pair's two whole texts are up to some 100 KB; they change no result.
BATCH_BYTES, BATCH_KEYS = 2_000_000, 100_000
#: The setting behind BATCH_BYTES.
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Steps that run meanwhile hand about BATCH_BYTES at a time to a worker."""
    before = spark.conf.get(BATCH_SETTING, None)
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_SETTING)
        else:
            spark.conf.set(BATCH_SETTING, before)


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; ``text`` is lower case."""
    h = word_hashes(text)
    if not len(h):
        return h
    return np.unique(windows(h, min(size, len(h))))


def furthest(n: int, cap: int | None, threshold: tuple[int, int]) -> int:
    """Most shingles by which a set of n and a similar one, of at most ``cap``, can differ."""
    a, b = threshold
    m = n * b // a
    if cap is not None:
        m = min(m, cap)
    return (b - a) * (n + m) // (a + b)


def pieces_of(band: int, threshold: tuple[int, int]) -> int:
    """Pieces of the band with sizes in [2^band, 2^(band+1))."""
    top = 2 ** (band + 1) - 1
    return max(furthest(top, top, threshold) + 2, -(-top // 3))


def pieces(hashes: np.ndarray, band: int, threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(key, count) of each piece of the band's sketch, empty pieces too."""
    p = pieces_of(band, threshold)
    at = ((hashes >> np.uint64(33)) % np.uint64(p)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    count = np.bincount(at, minlength=p)
    key = np.zeros(p, np.uint64)
    full = np.flatnonzero(count)
    ends = np.cumsum(count)[full] - count[full]
    key[full] = np.bitwise_xor.reduceat(hashes[order], ends)
    salt = (np.arange(p, dtype=np.uint64) + np.uint64(band << 40)) * np.uint64(0x9E3779B97F4A7C15)
    key = (key ^ salt) * np.uint64(0xC2B2AE3D27D4EB4F)
    return key ^ (key >> np.uint64(32)), count


def among(keys: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array ``common``."""
    if not len(common):
        return np.zeros(len(keys), bool)
    return common[np.minimum(np.searchsorted(common, keys), len(common) - 1)] == keys


def emitted(hashes: np.ndarray, common: np.ndarray, threshold: tuple[int, int]) -> Iterator[np.ndarray]:
    """The keys of a set, for its own band and, where a partner may be there, the next."""
    n = len(hashes)
    a, b = threshold
    own = n.bit_length() - 1
    top = 2 ** (own + 1) - 1
    for band, cap in ((own, top), (own + 1, None)):
        if cap is None and n * b // a <= top:
            continue
        take = furthest(n, cap, threshold) + 1
        key, count = pieces(hashes, band, threshold)
        # many shingles first, common pieces after all others, and empty ones, the commonest of all, last
        late = np.where(count == 0, 1 << 41, among(key, common) * (1 << 40)) - count
        order = np.lexsort((key, late))
        yield key[order[:take]]


def signatures(threshold: tuple[int, int], shingle: int):
    """(doc_id, h1, h2, n) of every text; rows with n = -1 count pieces that a batch has often: (null, key, count, -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in groups(batches):
            h1, h2, n, often, seen = [], [], [], [], set()
            for t in texts:
                t = b" ".join(t.lower().split())
                d = xxhash.xxh3_128_intdigest(t)
                s = shingle_set(t, shingle)
                h1.append(d >> 64)
                h2.append(d & 0xFFFFFFFFFFFFFFFF)
                n.append(len(s))
                if len(s) and d not in seen:
                    seen.add(d)
                    often.append(pieces(s, len(s).bit_length() - 1, threshold)[0])
            key, count = np.unique(np.concatenate(often) if often else np.zeros(0, np.uint64), return_counts=True)
            key, count = key[count > 1], count[count > 1]
            names = ["doc_id", "h1", "h2", "n"]
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), signed(h1), signed(h2), pa.array(n, pa.int64())], names=names)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.int64()), signed(key), pa.array(count.astype(np.int64)), pa.array(np.full(len(key), -1))], names=names)

    return run


def lowered(docs: DataFrame) -> DataFrame:
    """(uid, packed): the words in lower case, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(b" ".join((t or b"").lower().split())) for t in binary(batch.column(1))], pa.binary())], names=["uid", "packed"])

    return docs.select("doc_id", "text").mapInArrow(run, "uid long, packed binary")


def sketches(shingle: int):
    """(uid, n, sketch): the set's size and its parity sketch of BITS bits; every shingle flips one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            n, rows = [], []
            for packed in binary(batch.column(1)):
                s = shingle_set(unpack(packed), shingle)
                odd = np.bincount((s >> np.uint64(7)).astype(np.int64) % BITS, minlength=BITS) & 1
                n.append(len(s))
                rows.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            ends = np.arange(len(n) + 1, dtype=np.int32) * (BITS // 64)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), lists], names=["uid", "n", "sketch"])

    return run


def keys(common, threshold: tuple[int, int], shingle: int):
    """(key, salt, uid) of every emitted piece. Common keys are dealt over the parts from 1 on, others have part 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        late, parts = common.value

        def dealt(out: list[np.ndarray], uids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            keys, owners = np.concatenate(out), np.concatenate(uids)
            for at in range(0, len(keys), BATCH_KEYS):
                key, uid = keys[at : at + BATCH_KEYS], owners[at : at + BATCH_KEYS]
                salt = np.zeros(len(key), np.int64)
                often = among(key, late)
                part = (uid[often].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
                salt[often] = part % parts[np.searchsorted(late, key[often])] + np.uint64(1)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(uid)], names=["key", "salt", "uid"])

        out, uids, held = [], [], 0
        for batch in batches:
            for uid, packed in zip(batch.column(0).to_pylist(), binary(batch.column(1)), strict=True):
                s = shingle_set(unpack(packed), shingle)
                if len(s):
                    for k in emitted(s, late, threshold):
                        out.append(k)
                        uids.append(np.full(len(k), uid, np.int64))
                        held += len(k)
                if held >= BATCH_KEYS:
                    yield from dealt(out, uids)
                    out, uids, held = [], [], 0
        if out:
            yield from dealt(out, uids)

    return run


def verified(pairs: DataFrame, texts: DataFrame, threshold: tuple[int, int], shingle: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    a, b = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        last, kept = None, None
        for batch in batches:
            good = []
            lefts, packed = batch.column(0).to_pylist(), binary(batch.column(2))
            for left, x, y in zip(lefts, packed, binary(batch.column(3)), strict=True):
                if left != last:
                    last, kept = left, shingle_set(unpack(x), shingle)
                other = shingle_set(unpack(y), shingle)
                both = len(np.intersect1d(kept, other, assume_unique=True))
                good.append(b * both >= a * (len(kept) + len(other) - both))
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    # the partner's text first: the one with many partners joins last and stays in place
    sided = pairs.join(texts.select(F.col("uid").alias("b"), F.col("packed").alias("right")), "b")
    sided = sided.join(texts.select(F.col("uid").alias("a"), F.col("packed").alias("left")), "a")
    return sided.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


STRETCHES = [f"s{k}" for k in range(BITS // 64)]


def near(threshold: tuple[int, int]) -> Column:
    """Whether the rows ``_a`` and ``_b`` are of different components and may be similar, by size and compact sketch."""
    t, u = threshold
    apart = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in STRETCHES), F.lit(0))
    return (
        (F.col("component_a") != F.col("component_b")) & (F.least("n_a", "n_b") * u >= F.greatest("n_a", "n_b") * t)
        & (apart * (t + u) <= (F.col("n_a") + F.col("n_b")) * (u - t))
    )


def sided(rows: DataFrame, side: str) -> DataFrame:
    """The rows' columns with a suffix; the key of side a is called k."""
    return rows.select(F.col("key").alias("k" if side == "a" else "key"), *[F.col(c).alias(f"{c}_{side}") for c in ("uid", "component", "n", *STRETCHES)])


def still_open(placed: DataFrame) -> DataFrame:
    """(key, uid, component, size) of keys whose documents lie in different components; size: the key's rows."""
    several = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("size")).where("x <> y")
    return written(placed.join(several.select("key", "size"), "key"), "open")


def met(rows: DataFrame, drawn: DataFrame, turn: int, threshold: tuple[int, int]) -> DataFrame:
    """(a, component_a, b, component_b): every document of an open key with pivots of one of its keys that may be similar.

    The key is drawn at random, a key of twice the rows twice as likely; a pivot is a document whose hash falls into one
    of size / PIVOTS classes. Both depend on the round alone, so a repeated task gives the same rows.
    """
    chance = (F.pmod(F.xxhash64("key", "uid", F.lit(turn)), F.lit(1 << 20)) + 0.5) / (1 << 20)
    mine = rows.groupBy("uid").agg(F.max_by("key", F.col("size") / -F.log(chance)).alias("key"), F.first("component").alias("component"))
    pivots = rows.where(F.pmod(F.xxhash64("uid", F.lit(turn)), F.greatest(F.lit(1), F.floor(F.col("size") / PIVOTS))) == 0).drop("size")
    pairs = sided(mine.join(drawn, "uid"), "a").join(sided(pivots.join(drawn, "uid"), "b"), (F.col("k") == F.col("key")) & near(threshold))
    return pairs.select(F.col("uid_a").alias("a"), "component_a", F.col("uid_b").alias("b"), "component_b").distinct()


def similar_groups(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every identified document."""
    with small_batches(docs.sparkSession):
        return _similar_groups(docs, threshold, shingle)


def _similar_groups(docs: DataFrame, threshold: tuple[int, int], shingle: int) -> DataFrame:
    spark = docs.sparkSession
    docs = identified(docs)
    signed = written(docs.mapInArrow(signatures(threshold, shingle), "doc_id long, h1 long, h2 long, n long"), "signatures")
    often = signed.where("n = -1").groupBy("h1").agg(F.sum("h2").alias("c")).where(F.col("c") >= COMMON)
    often = often.orderBy(F.desc("c"), "h1").limit(MOST_COMMON).toPandas()
    late = often["h1"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(late)
    common = spark.sparkContext.broadcast((late[order], (SALTS + often["c"].to_numpy(np.int64) // PART).astype(np.uint64)[order]))

    signed = signed.where("n >= 0")
    heads = signed.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("uid"))
    texts = written(lowered(docs).join(heads.select("uid"), "uid"), "texts")

    part = Window.partitionBy("key", "salt")
    rows = texts.mapInArrow(keys(common, threshold, shingle), "key long, salt int, uid long")
    rows = rows.withColumns({"head": F.min("uid").over(part), "n": F.count(F.lit(1)).over(part)})
    # alone in a part of a common key is not alone in the key
    rows = written(rows.where("n > 1 OR salt > 0").select("key", "uid", "head"), "keys")

    # heads of a salted key's parts against the key's smallest
    tops = rows.groupBy("key").agg(F.min("head").alias("a"), F.max("head").alias("z")).where("a <> z").select("key", "a")
    across = rows.select("key", F.col("head").alias("b")).distinct().join(tops, "key").select("a", "b")
    pairs = rows.select(F.col("head").alias("a"), F.col("uid").alias("b")).union(across).where("a <> b").distinct()
    links = written(verified(written(pairs, "pairs"), texts, threshold, shingle), "links")
    first = components(links)

    def checked(found: DataFrame) -> DataFrame:
        """(component_a, component_b) of the found pairs that are similar."""
        found = written(found, "met")
        good = verified(found.select("a", "b"), texts, threshold, shingle)
        return written(found.join(good, ["a", "b"], "left_semi").select("component_a", "component_b").distinct(), "merged")

    placed = rows.select("key", "uid").distinct().join(first, F.col("uid") == F.col("id"), "left").select("key", "uid", F.coalesce("component", "uid").alias("component"))
    placed = still_open(placed)
    drawn = texts.join(placed.select("uid").distinct(), "uid", "left_semi").mapInArrow(sketches(shingle), "uid long, n long, sketch array<long>")
    # one column for each 64 bits: the distance is then compiled code
    drawn = written(drawn.select("uid", "n", *[F.get("sketch", F.lit(k)).alias(c) for k, c in enumerate(STRETCHES)]), "sketches")
    bonds, turn = links, 0
    while n_open := placed.select("component").distinct().count():
        turn += 1
        more = checked(met(placed, drawn, turn, threshold))
        merged = components(more)
        bonds = bonds.union(more)
        moved = merged.select(F.col("id").alias("component"), F.col("component").alias("joined"))
        placed = still_open(placed.join(moved, "component", "left").select("key", "uid", F.coalesce("joined", "component").alias("component")))
        if merged.where("id <> component").count() * WORTH < n_open:
            last = placed.drop("size").join(drawn, "uid")
            last = sided(last, "a").join(sided(last, "b"), (F.col("k") == F.col("key")) & (F.col("uid_a") < F.col("uid_b")) & near(threshold))
            bonds = bonds.union(checked(last.select(F.col("uid_a").alias("a"), "component_a", F.col("uid_b").alias("b"), "component_b").distinct()))
            break
    if turn:
        first = components(bonds)

    named = heads.join(first, F.col("uid") == F.col("id"), "left").select("h1", "h2", F.coalesce("component", "uid").alias("component_id"))
    # equal word sequences have one representative; documents without words have none
    return signed.join(named, ["h1", "h2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))
