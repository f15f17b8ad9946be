"""Benchmark decontamination by latent semantic retrieval.

The benchmark is the stated query set; it is taken in blocks of at most ``BLOCK``
items, so what is broadcast has a fixed bound. For a block:

1. document frequencies of the block's words over all documents (one pass; each
   task sends one count per word);
2. passages: windows of ``SPAN`` words, every ``STEP`` words, of every whole text. A
   passage enters the space if a share ``IN_SPACE`` of its squared TF-IDF weight lies on
   the block's words; with less, its direction is that of a few chance words;
3. a distributed randomised SVD of the TF-IDF matrix of the items and all of those
   passages: random projection, power iterations of A'A in the tasks, small
   orthogonalisations in the driver (words x rank numbers, bounded by the block);
4. cosine search of all passages against all items in the latent space, where every
   passage of at least ``COSINE`` to an item is a candidate for it;
5. the document's words in an item's candidate passages are compared with the item's by
   longest common subsequence, shared weight, and the item's answer (its last sentence):
   a copy, or a paraphrase that keeps the answer, is contaminated. Before that, stretches
   fall away that have too few of the item's words for any common subsequence that the
   check accepts, or whose words of the item weigh too little: the check would refuse
   them all.

A document's passages are one row (cut, with an overlap that holds any item's stretch, at
``ROW`` passages), so search and check are one step without a shuffle. The row has each word
that its passages cover once; overlapping passages are sums over shared pieces (``Pieces``).

Words are split at ASCII white space and punctuation, A-Z lower-cased. Null or empty
texts and items match nothing; for ids see ``common.identified``. Equal items of one id
count once; items of any length are searched by several vectors (``vectors_of``). An empty
benchmark gives no rows; columns other than the ids and texts are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import groups, identified, table, written

SPAN, STEP = 24, 8
#: Items to a block.
BLOCK = 2000
#: Items of more words have, besides their own vector, one for each PIECE words, every SPAN words: each span of an
#: item lies wholly in one of them.
WHOLE, PIECE = 64, 2 * SPAN
RANK, SPARE, POWERS, SEED = 72, 8, 2, 20
#: Candidate search: least cosine in the latent space, and least share of a passage's squared weight inside it.
COSINE, IN_SPACE = 0.47, 0.22
#: Passages to a row of a long document.
ROW = 4096
#: Words of the stretches that the check looks at in one step.
STRETCHES = 1_000_000
#: Rows that ``sums`` adds up one after the other; longer sums are sums of sums.
LAYERS = 16
#: What a square counts in ``passages``: whole numbers, so that a passage's share does not depend on the texts before it.
UNIT = 2**24
#: Verification: shares of an item's words and weight for a copy, and for a paraphrase with its answer.
COPY, PARAPHRASE, ANSWER = 0.75, 0.55, 0.8

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
OTHER = -1


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def answer_of(text: str) -> str:
    """The last sentence."""
    parts = [p for p in text.replace("\n", " ").replace("?", ".").replace("!", ".").split(".") if p.strip()]
    return parts[-1] if parts else ""


class Block:
    """A block of items: its words' numbers, the items as number sequences, their answers."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        words = [words_of(t.encode()) for _, t in items]
        self.number = {w: k for k, w in enumerate(sorted(set().union(*words)))}
        self.items = [np.array([self.number[w] for w in ws], np.int32) for ws in words]
        self.answers = [[self.number[w] for w in words_of(answer_of(t).encode())] for _, t in items]
        self.weight = np.ones(len(self.number))

    def weigh(self, n_docs: int, frequency: np.ndarray) -> None:
        self.weight = np.log((n_docs + 1) / (frequency + 1)) + 0.05
        #: A word outside the block weighs like the block's mean word.
        self.other = float(self.weight.mean()) if len(self.weight) else 1.0

    def numbers(self, text: bytes) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.number.get, words, repeat(OTHER)), np.int32, len(words))


def frequencies(docs: DataFrame, block) -> tuple[int, np.ndarray]:
    """Number of documents, and of those that hold each word."""
    known = block.value.number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = block.value.number
        among, found, n = frozenset(number), Counter(), 0
        for _, texts in groups(batches):
            for t in texts:
                n += 1
                found.update(among.intersection(words_of(t)))
        count = np.zeros(len(number) + 1, np.int64)
        for w, k in found.items():
            count[number[w]] = k
        count[-1] = n
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at])], names=["word", "n"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n")).collect()
    out = np.zeros(len(known) + 1)
    for w, n in rows:
        out[w] = n
    return int(out[-1]), out[:-1]


def span_starts(n: int) -> np.ndarray:
    """Where the spans of a text of n words start: every STEP, and the last one at the end."""
    return np.minimum(np.arange(int(span_counts(np.array([n]))[0])) * STEP, max(n - SPAN, 0))


def span_counts(n: np.ndarray) -> np.ndarray:
    """How many spans texts of n words have."""
    return np.where(n > SPAN, -(-(n - SPAN) // STEP) + 1, np.minimum(n, 1))


def spread(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of every range (``length`` of them from ``first`` on), one range after the other."""
    return np.arange(int(length.sum())) + np.repeat(first - (np.cumsum(length) - length), length)


def passages(docs: DataFrame, block) -> DataFrame:
    """(doc_id, starts, terms): the passages of a document that enter the space.

    ``terms`` are the numbers of the words that they cover, each once and in order, OTHER for foreign words; all passages
    of a row are equally long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        square = np.rint(np.append(b.weight**2, b.other**2) * UNIT).astype(np.int64)  # the last one is OTHER's
        # passages that a row repeats from the row before: any stretch that the check looks at lies in one row
        again = -(-2 * max(map(len, b.items), default=0) // STEP) + SPAN // STEP
        for ids, texts in groups(batches):
            x = [b.numbers(t) for t in texts]
            size = np.array([len(t) for t in x])
            x, begin, many = np.concatenate(x), np.cumsum(size) - size, span_counts(size)
            w = square[x]
            total = np.concatenate(([0], np.cumsum(w)))
            own = np.concatenate(([0], np.cumsum(np.where(x >= 0, w, 0))))
            doc = np.repeat(np.arange(len(size)), many)
            start = np.minimum(spread(np.zeros(len(many), np.int64), many) * STEP, np.maximum(size - SPAN, 0)[doc])
            low = begin[doc] + start
            high = np.minimum(low + SPAN, (begin + size)[doc])
            enters = own[high] - own[low] >= IN_SPACE * (total[high] - total[low])
            doc, start = doc[enters], start[enters]
            # rows: of every document ROW passages after the other, and those repeated
            many = np.bincount(doc, minlength=len(size))
            rows = -(-many // ROW)
            of = np.repeat(np.arange(len(size)), rows)
            skip = spread(np.zeros(len(rows), np.int64), rows) * ROW
            length = np.minimum(many[of] - skip, ROW + again)
            start = start[spread((np.cumsum(many) - many)[of] + skip, length)]
            if not len(start):
                continue
            ends = np.cumsum(length)
            taken = np.minimum(np.append(np.diff(start), 0), np.repeat(np.minimum(size[of], SPAN), length))
            taken[ends - 1] = np.minimum(size[of], SPAN)
            terms = x[spread(np.repeat(begin[of], length) + start, taken)]
            covered = np.concatenate(([0], np.cumsum(taken)))
            lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(c.astype(np.int32))) for at, c in ((np.append(0, ends), start), (covered[np.append(0, ends)], terms))]
            yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in of.tolist()], pa.int64()), *lists], names=["doc_id", "starts", "terms"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, starts array<int>, terms array<int>")


def spans_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, begin, end, terms) of all passages of a batch of rows; passage p is ``terms[begin[p] : end[p]]``."""
    starts, terms = batch.column(batch.schema.get_field_index("starts")), batch.column(batch.schema.get_field_index("terms"))
    n, bounds = np.diff(starts.offsets.to_numpy()), terms.offsets.to_numpy()
    row, start = np.repeat(np.arange(len(n)), n), starts.flatten().to_numpy()
    size = np.minimum(np.diff(bounds), SPAN)[row]
    ahead = np.where(np.diff(row, append=-1) == 0, np.minimum(np.diff(start, append=0), size), size)
    end = np.cumsum(ahead) - ahead + size
    return row, start, end - size, end, terms.flatten().to_numpy()


def sums(rows: np.ndarray, first: np.ndarray, n: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """For every k the sum of the n[k] rows from first[k] on, or of the rows that ``at`` has there."""
    most = int(n.max(initial=0))
    if most > LAYERS:
        parts = -(-n // LAYERS)
        k, skip = np.repeat(np.arange(len(n)), parts), spread(np.zeros(len(n), np.int64), parts) * LAYERS
        return sums(sums(rows, first[k] + skip, np.minimum(n[k] - skip, LAYERS), at), np.cumsum(parts) - parts, parts)
    order = np.argsort((most - n).astype(np.uint8), kind="stable")
    first = first[order]
    out = np.zeros((len(n), rows.shape[1]), rows.dtype)
    for j, m in enumerate((len(n) - np.cumsum(np.bincount(n, minlength=most + 1)))[:most].tolist()):
        k = first[:m] + j
        out[:m] += rows.take(k if at is None else at[k], axis=0)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out.take(back, axis=0)


class Pieces:
    """Passages cut every STEP words, and where another one begins or ends: each piece's words are added up once for all."""

    def __init__(self, begin: np.ndarray, end: np.ndarray, terms: np.ndarray):
        self.marks = np.minimum(begin[:, None] + np.arange(0, SPAN + 1, STEP), end[:, None])
        self.marks[:, -1] = end
        cut = np.zeros(len(terms) + 1, bool)
        cut[self.marks] = True
        #: Pieces at whose beginning a passage's marks are.
        self.marks = (np.cumsum(cut) - 1)[self.marks]
        own = terms >= 0
        self.words = terms[own]
        seen = np.concatenate(([0], np.cumsum(own)))[cut]
        self.first, self.n = seen[:-1], np.diff(seen)

    def rows(self, by_word: np.ndarray) -> np.ndarray:
        """Sums of the words' rows, by piece."""
        return sums(by_word, self.first, self.n, self.words)

    def passages(self, by_piece: np.ndarray, mark: int = 0, until: int = -1) -> np.ndarray:
        """Sums of the pieces' rows, by passage, from one mark to another."""
        return sums(by_piece, self.marks[:, mark], self.marks[:, until] - self.marks[:, mark])

    def add_back(self, total: np.ndarray, by_passage: np.ndarray) -> None:
        """Adds every passage's row to those of its words."""
        k = np.arange(len(self.n))
        low, high = np.searchsorted(self.marks[:, -1], k, "right"), np.searchsorted(self.marks[:, 0], k, "right")
        by_piece = sums(by_passage, low, high - low)
        # numbers of 16 bits are sorted by radix
        order = np.argsort(self.words.astype(np.uint16) if len(total) <= 2**16 else self.words, kind="stable")
        word = self.words[order]
        first = np.flatnonzero(np.diff(word, prepend=-1))
        total[word[first]] += sums(by_piece, first, np.diff(first, append=len(word)), np.repeat(k, self.n)[order])


def _blocks(begin: np.ndarray, end: np.ndarray, terms: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first passage, begin, end, terms) of stretches short enough for their numbers to stay in the cache."""
    for k in range(0, len(begin), most):
        x, y = begin[k : k + most], end[k : k + most]
        yield k, x - x[0], y - x[0], terms[x[0] : y[-1]]


def weighted(b: Block, basis: np.ndarray) -> np.ndarray:
    """The rows that a passage's words add to its product with ``basis``, but for the passage's own norm."""
    return (basis * b.weight[:, None]).astype(np.float32)


def add_gram(total: np.ndarray, begin: np.ndarray, end: np.ndarray, terms: np.ndarray, by_word: np.ndarray, square: np.ndarray) -> None:
    """Adds A'A times the basis of ``by_word``, but for the words' weights, for A's rows of these passages."""
    for _, x, y, t in _blocks(begin, end, terms, 1000):
        pieces, seen = Pieces(x, y, t), np.concatenate(([0.0], np.cumsum(square[t])))
        z = pieces.passages(pieces.rows(by_word))
        pieces.add_back(total, z / (seen[y] - seen[x] + 1e-12).astype(np.float32)[:, None])


def gram(found: DataFrame, block, basis) -> np.ndarray:
    """A'A times ``basis``; tasks add up their passages, slices of the words are added up apart."""
    slices = 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, q = block.value, basis.value
        by_word, square = weighted(b, q), np.append(b.weight**2, b.other**2)
        total = np.zeros(q.shape, np.float32)
        for batch in batches:
            add_gram(total, *spans_of(batch)[2:], by_word, square)
        cut = [x.tobytes() for x in np.array_split(weighted(b, total), slices)]
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array(cut, pa.binary())], names=["slice", "part"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float32) for x in t.column("part").to_pylist())
        return pa.table({"slice": t.column("slice")[:1], "part": pa.array([total.tobytes()], pa.binary())})

    parts = found.select("starts", "terms").mapInArrow(run, "slice int, part binary").groupBy("slice").applyInArrow(add, "slice int, part binary").collect()
    q = basis.value
    if not parts:
        return np.zeros(q.shape)
    return np.concatenate([np.frombuffer(bytes(p), np.float32) for _, p in sorted(parts, key=lambda r: r[0])]).reshape(q.shape).astype(np.float64)


def latent_basis(spark: SparkSession, found: DataFrame, block) -> np.ndarray:
    """Right singular vectors (words x rank) of the passages' and items' TF-IDF matrix."""
    b = block.value
    n = len(b.number)
    width = min(n, RANK + SPARE)
    terms = np.concatenate([*b.items, np.zeros(0, np.int32)])
    ends = np.cumsum([0, *map(len, b.items)])
    square = np.append(b.weight**2, b.other**2)
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((n, width)))[0]
    for step in range(POWERS):
        shared = spark.sparkContext.broadcast(q.astype(np.float32))
        y = gram(found, block, shared)
        items = np.zeros(q.shape, np.float32)
        add_gram(items, ends[:-1], ends[1:], terms, weighted(b, shared.value), square)
        y += weighted(b, items)
        shared.unpersist()
        if step == POWERS - 1:
            small = q.T @ y
            vectors = np.linalg.eigh((small + small.T) / 2)[1][:, ::-1]
            return (q @ vectors[:, : min(RANK, width)]).astype(np.float32)
        q = np.linalg.qr(y)[0]
    raise AssertionError


def vectors_of(item: np.ndarray) -> list[np.ndarray]:
    """The word sequences whose vectors stand for an item in the search."""
    if len(item) <= WHOLE:
        return [item]
    return [item, *(item[k : k + PIECE] for k in range(0, len(item) - SPAN, SPAN))]


class Search:
    """What a task needs to find a block's items: their vectors, and which of them have which words (BLOCK x words bytes)."""

    def __init__(self, b: Block, basis: np.ndarray):
        self.by_word = weighted(b, basis)
        vectors = [vectors_of(x) for x in b.items]
        parts = [x for vs in vectors for x in vs]
        ends, terms = np.cumsum([0, *map(len, parts)]), np.concatenate(parts)
        self.vectors = unit(sums(self.by_word, ends[:-1], np.diff(ends), terms)).T.copy()
        self.heads = np.cumsum([0, *map(len, vectors)])[:-1] if len(parts) > len(vectors) else None
        self.has = np.zeros((len(b.number) + 1, len(b.items)), np.uint8)  # the last row is OTHER's
        for k, x in enumerate(b.items):
            self.has[x, k] = 1
        self.words = np.array([len(x) for x in b.items])
        self.weight, self.total = np.append(b.weight, 0.0), np.array([b.weight[x].sum() for x in b.items])
        self.wanted = [Wanted(x.tolist(), a, b.weight) for x, a in zip(b.items, b.answers, strict=True)]

    def hits(self, ends: np.ndarray, terms: np.ndarray, begin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, words) of pairs whose latent cosine reaches COSINE for one of the item's vectors; words: how many of the passage's first 8, 16 and 24 the item has.

        Passages lie one after the other between ``ends``, or begin at ``begin`` and overlap.
        """
        begin, end = (ends[:-1], ends[1:]) if begin is None else (begin, ends)
        found = []
        for k, x, y, t in _blocks(begin, end, terms, 500):
            pieces = Pieces(x, y, t)
            cosine = unit(pieces.passages(pieces.rows(self.by_word))) @ self.vectors
            if self.heads is not None:
                cosine = np.maximum.reduceat(cosine, self.heads, axis=1)
            pair = np.flatnonzero(cosine >= COSINE)
            if not len(pair):
                continue
            has = pieces.rows(self.has)
            words = [pieces.passages(has, j, j + 1).ravel()[pair] for j in range(SPAN // STEP)]
            at, item = np.divmod(pair, len(self.words))
            found.append((at + k, item, np.cumsum(words, axis=0, dtype=np.uint8).T))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros((0, SPAN // STEP), int))

    def best(self, value: np.ndarray, begin: np.ndarray, item: np.ndarray) -> np.ndarray:
        """The largest sum in a window of the check's length, for stretches that start at ``begin``; ``value``: of every word of all stretches."""
        size = np.diff(np.append(begin, len(value)))
        seen = np.concatenate(([0], np.cumsum(value, dtype=np.int32 if value.dtype == bool else float)))
        reach = np.ceil(1.5 * self.words[item]).astype(np.int64)
        # a window that the stretch's end cuts has no more than the last whole one
        until = np.minimum(np.arange(len(value)) + np.repeat(reach, size), np.repeat(begin + size, size))
        return np.maximum.reduceat(seen[until] - seen[:-1], begin)

    def enough(self, region: np.ndarray, inside: np.ndarray, begin: np.ndarray, item: np.ndarray) -> np.ndarray:
        """The stretches of which some window has enough of the item's words for the check, in number and in weight.

        ``inside`` tells of every word of all stretches whether its stretch's item has it.
        """
        some = np.flatnonzero(self.best(inside, begin, item) >= PARAPHRASE * self.words[item])
        if not len(some):
            return some
        n = np.diff(np.append(begin, len(region)))[some]
        at = spread(begin[some], n)
        weight = self.best(np.where(inside[at], self.weight[region[at]], 0.0), np.cumsum(n) - n, item[some])
        return some[weight >= PARAPHRASE * self.total[item[some]] - 1e-6]  # sums of many weights are not exact


def unit(z: np.ndarray) -> np.ndarray:
    return z / (np.linalg.norm(z, axis=1, keepdims=True) + 1e-9)


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence (bit-parallel: one big integer, a step for each of b's words)."""
    places: dict[int, int] = {}
    for k, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & places.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Wanted:
    """An item as the check needs it: words, how often and how much each weighs, answer."""

    def __init__(self, item: list[int], answer: list[int], weight: np.ndarray):
        self.item, self.answer, self.count = item, answer, dict(Counter(item))
        self.weight = {w: float(weight[w]) for w in self.count}
        self.total = float(weight[item].sum())

    def verdict(self, region: np.ndarray, inside: np.ndarray) -> tuple[int, float, bool, bool]:
        """(common subsequence, shared weight, answer found, contaminated) of the item and the best window of a region.

        ``inside`` tells which of the region's words the item has. A window whose words in common are too few, or
        weigh too little, is passed over before the subsequence is computed.
        """
        item, answer, n = self.item, self.answer, len(self.item)
        reach, step = math.ceil(1.5 * n), max(1, n // 4)
        best = (0, 0.0, False, False)
        places = np.flatnonzero(inside)
        words = region[places].tolist()
        at = np.arange(0, max(1, len(region) - reach + step), step)
        low, high = np.searchsorted(places, at), np.searchsorted(places, at + reach)
        some = high - low >= PARAPHRASE * n
        # windows that hold the same words of the item are one
        for x, y in dict.fromkeys(zip(low[some].tolist(), high[some].tolist(), strict=True)):
            part = words[x:y]
            both = {w: min(c, self.count[w]) for w, c in Counter(part).items()}
            if sum(both.values()) < PARAPHRASE * n:
                continue
            shared = sum(self.weight[w] * c for w, c in both.items()) / self.total
            if shared < PARAPHRASE:
                continue
            share = (common := lcs(item, part)) / n
            answered = bool(answer) and lcs(answer, part) >= ANSWER * len(answer)
            bad = min(share, shared) >= COPY or (answered and min(share, shared) >= PARAPHRASE)
            best = max(best, (common, shared, answered, bad), key=lambda x: (x[3], x[0]))
        return best


def verdict(item: list[int], answer: list[int], region: list[int], weight: np.ndarray) -> tuple[int, float, bool, bool]:
    """``Wanted.verdict`` of one item and any text."""
    return Wanted(item, answer, weight).verdict(np.array(region, np.int32), np.isin(region, item))


RESULT = "doc_id long, item_id long, item_words long, lcs_words long, answer_found boolean"


def leaks(found: DataFrame, block, basis) -> DataFrame:
    """The contaminated (document, item) pairs: latent search, then the check of the candidates."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, search, rows = block.value, None, []
        for batch in batches:
            search = search or Search(b, basis.value)
            row, start, begin, end, terms = spans_of(batch)
            at, item, words = search.hits(end, terms, begin)
            # passages come in order already
            order = np.argsort(row[at] * len(b.items) + item, kind="stable")
            at, item, words = at[order], item[order], words[order]
            ids = batch.column(0).to_pylist()
            if not len(at):
                continue
            # stretches: passages of one row that are candidates for one item and overlap or touch
            same = (row[at][1:] == row[at][:-1]) & (item[1:] == item[:-1])
            gap = start[at][1:] - start[at][:-1]
            size = (end - begin)[at]
            same &= gap <= size[:-1]
            cuts = np.flatnonzero(np.append(True, ~same))
            # a stretch's words: of every passage those before the next one
            ahead = np.where(np.append(same, False), np.append(gap, 0), SPAN)
            common = words[np.arange(len(at)), np.minimum(-(-ahead // STEP), SPAN // STEP) - 1].astype(np.int32)
            worth = np.flatnonzero(np.add.reduceat(common, cuts) >= PARAPHRASE * search.words[item[cuts]])
            if not len(worth):
                continue
            taken = np.minimum(ahead, size)
            several, length = np.diff(np.append(cuts, len(at)))[worth], np.add.reduceat(taken, cuts)[worth]
            step = np.cumsum(length) // STRETCHES
            for some in np.split(np.arange(len(worth)), np.flatnonzero(np.diff(step)) + 1):
                x, n = cuts[worth[some]], length[some]
                p = spread(x, several[some])
                region = terms[spread(begin[at[p]], taken[p])]
                head = np.cumsum(n) - n
                inside = search.has[region, np.repeat(item[x], n)] > 0
                for k in search.enough(region, inside, head, item[x]).tolist():
                    i, cut = int(item[x[k]]), slice(head[k], head[k] + n[k])
                    best = search.wanted[i].verdict(region[cut], inside[cut])
                    if best[3]:
                        rows.append((ids[row[at[x[k]]]], b.ids[i], len(b.items[i]), best[0], best[2]))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[f.split()[0] for f in RESULT.split(", ")])

    # the rows of a long document overlap, and equal items of one id count once
    best = found.mapInArrow(run, RESULT).groupBy("doc_id", "item_id").agg(F.max(F.struct("lcs_words", "answer_found", "item_words")).alias("best"))
    return best.select("doc_id", "item_id", "best.item_words", "best.lcs_words", "best.answer_found")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_words, lcs_words, answer_found) of every pair found."""
    spark = docs.sparkSession
    docs = identified(docs)
    out = spark.createDataFrame([], RESULT)
    last = None
    while True:
        items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
        if last is not None:
            items = items.where(F.col("item_id") > last)
        chosen = items.orderBy("item_id", "text").limit(BLOCK).collect()
        if not chosen:
            return out
        # a repeated id must not be torn apart by the block's end
        last = chosen[-1][0]
        if len(chosen) == BLOCK:
            chosen = [r for r in chosen if r[0] != last] + items.where(F.col("item_id") == last).collect()
        rows = [(i, t) for i, t in dict.fromkeys(map(tuple, chosen)) if words_of(t.encode())]
        if not rows:
            continue
        block = Block(rows)
        block.weigh(*frequencies(docs, spark.sparkContext.broadcast(block)))
        block = spark.sparkContext.broadcast(block)
        found = written(passages(docs, block), "passages")
        basis = spark.sparkContext.broadcast(latent_basis(spark, found, block))
        out = out.unionByName(written(leaks(found, block, basis), "leaks"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
