"""Bounded-space online packing of documents into token windows.

Every partition keeps a fixed number of open windows. A document's full
stretches of ``size`` tokens become windows of their own; what is left is placed
best-fit: in the open window with the least room that still holds it. When none
fits and all places are taken, the fullest window is emitted and a new one is
opened. At the end of its partition each open window is a leftover; leftovers
are merged in groups of partitions in the same way, as whole windows, so no task
ever sees more than a bounded number of them per partition.

The token ids never leave the task that made them, except in ``keep_ids`` mode:
a shuffle moves only leftovers' piece rows.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, table, written
from .tokens import ODD_SPACE, Memo, leading_chunks

SIZE, OPEN, END_ID = 2048, 64, 1
#: Partitions whose leftovers are merged together.
MERGED = 16
#: Sequences that one task can number.
ROOM = 1 << 36

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
FIELDS = [f.split()[0] for f in PIECE.split(", ")]


class OpenWindows:
    """At most ``most`` windows of ``size`` that still take items, best fit first."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.room: list[tuple[int, int]] = []  # (free, key), ascending
        self.items: dict[int, list] = {}
        self.next = 0

    def place(self, length: int, item) -> list | None:
        """Places an item of ``length``; returns the items of a window that had to go."""
        done = None
        at = bisect_left(self.room, (length, -1))
        if at < len(self.room):
            free, key = self.room.pop(at)
        else:
            if len(self.room) >= self.most:
                done = self.items.pop(self.room.pop(0)[1])  # the fullest
            free, key, self.next = self.size, self.next, self.next + 1
            self.items[key] = []
        self.items[key].append((self.size - free, item))
        if free > length:
            insort(self.room, (free - length, key))
            return done
        full = self.items.pop(key)
        if done is None:
            return full
        self.items[key] = full  # two are ready: this one goes with the next call
        insort(self.room, (0, key))
        return done

    def rest(self) -> Iterator[tuple[int, list]]:
        for free, key in self.room:
            yield self.size - free, self.items[key]


def encoder(path: str, ranks: tuple[str, str] | None = None):
    """text -> ids as bytes, four little-endian bytes each."""

    def packed(ids: list[int]) -> bytes:
        a = array("I", ids)
        if sys.byteorder == "big":
            a.byteswap()
        return a.tobytes()

    memo = Memo(path, packed, ranks)

    def ids(text: str) -> bytes:
        return memo.whole(text) if ODD_SPACE.search(text) else b"".join(memo.of(leading_chunks(text)))

    return ids


def pack(docs: DataFrame, path: str, size: int = SIZE, most_open: int = OPEN, keep_ids: bool = False, ranks: tuple[str, str] | None = None) -> DataFrame:
    """One row per piece: PIECE's columns, and with ``keep_ids`` its ids as binary.

    ``ranks`` names the vocabulary's rank file and pattern, a faster way to the same ids.
    A null text is empty and still yields its end id. Repeated rows and repeated
    doc_ids are packed each for itself. An empty table gives no rows.
    """
    schema = f"{PIECE}, used long, task long" + ", ids binary" * keep_ids
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.int64()] * 9 + [pa.binary()] * keep_ids
    end = array("I", [END_ID]).tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, open_, task, number = encoder(path, ranks), OpenWindows(size, most_open), TaskContext.get().partitionId(), 0
        rows: list[tuple] = []

        def close(items: list, used: int) -> None:
            nonlocal number
            for offset, piece in items:
                rows.append((*piece[:5], task * ROOM + number, offset, used, task, *piece[5:]))
            number += 1

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), binary(batch.column(1)), strict=True):
                ids = ids_of((raw or b"").decode()) + end
                n = len(ids) // 4
                for start in range(0, n, size):
                    part = ids[4 * start : 4 * (start + size)]
                    piece = (doc, start, len(part) // 4, zlib.crc32(part), n, *[part] * keep_ids)
                    if piece[2] == size:
                        close([(0, piece)], -1)
                    elif gone := open_.place(piece[2], piece):
                        close(gone, -1)
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []
        for used, items in open_.rest():
            close(items, used)  # a leftover: used is known
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def merge(left: pa.Table) -> pa.Table:
        """Whole leftover windows, fullest first, placed best-fit under new windows."""
        import numpy as np

        left = left.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        seq, used = left.column("sequence_id").to_numpy(), left.column("used").to_numpy()
        heads, back = np.unique(seq, return_index=True)
        open_ = OpenWindows(size, len(heads) + 1)
        moved: dict[int, tuple[int, int]] = {}

        def note(items: list) -> None:
            for offset, old in items:
                moved[old] = (items[0][1], offset)

        for length, old in sorted(((int(used[i]), int(s)) for s, i in zip(heads, back, strict=True)), key=lambda x: (-x[0], x[1])):
            if gone := open_.place(length, old):
                note(gone)
        for _, items in open_.rest():
            note(items)
        to = [moved[int(s)] for s in seq]
        offset = [o + m for o, (_, m) in zip(left.column("offset").to_pylist(), to, strict=True)]
        left = left.set_column(left.schema.get_field_index("sequence_id"), "sequence_id", pa.array([s for s, _ in to], pa.int64()))
        left = left.set_column(left.schema.get_field_index("offset"), "offset", pa.array(offset, pa.int64()))
        return left.select(names)

    pieces = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(first, schema), "packed")
    closed = pieces.where("used < 0")
    merged = pieces.where("used >= 0").groupBy(F.floor(F.col("task") / MERGED).alias("lot")).applyInArrow(merge, schema)
    return closed.unionByName(merged).drop("used", "task")


def pack_documents(docs: DataFrame) -> DataFrame:
    """With the production vocabulary."""
    import public_tokenizers as p

    return pack(docs, p.path("byte_bpe_50k.json"), ranks=(p.path("byte_bpe_50k.tiktoken"), p.PATTERN))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
