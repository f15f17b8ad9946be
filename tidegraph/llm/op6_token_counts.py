"""Token counts by prefix dynamic programming.

For a text of pieces c1..cn that the tokenizer never joins the table T holds the exact
token count of every prefix that ends at a piece: T[0] = 0 and T[i] = T[i-1] +
tokens(c_i); the count of any other prefix is T[i] plus the tokens of what lies beyond
piece i, at most one piece. So the table answers for every prefix: totals, truncation
("how much text fits in a budget?") and allotment ("how many tokens does this prefix
have?") without encoding the text again. Pieces are chunks between ASCII white space,
whose counts are memoised; where other white space occurs, and inside a chunk, they are
the tokenizer's own words.

Nulls and empty texts have no piece and count 0. One row for each row, repeated rows too;
other columns are ignored. Row-local: no shuffle.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import cached_property
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, table
from .tokens import ODD_SPACE, Memo

LIMIT = 2048


#: Pieces up to this many characters are cut at every one of their prefixes, longer ones near the token that the budget names.
LONG = 512


class PrefixCounts:
    """The table of one text: ``ends`` in code points, ``counts`` in tokens."""

    def __init__(self, text: str | None, memo: Memo):
        self.text, self._memo = text or "", memo
        self._odd = bool(ODD_SPACE.search(self.text))
        if self._odd:
            self.total = memo.whole(self.text)
        else:
            self._chunks = self.text.split()
            self._sums = [0, *accumulate(memo.of(self._chunks))]
            self.total = self._sums[-1]

    def _words(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """(ends, counts) of the tokenizer's words in a text, and where each token ends."""
        e = self._memo.tokens.encode(text, add_special_tokens=False)
        ends, counts, last = [0], [0], len(e.ids) - 1
        for k, (word, (_, end)) in enumerate(zip(e.word_ids, e.offsets, strict=True)):
            if k < last and word is not None and e.word_ids[k + 1] == word:
                continue
            if end > ends[-1]:
                ends.append(end)
                counts.append(k + 1)
            else:  # one character gave several words
                counts[-1] = k + 1
        return ends, counts, [end for _, end in e.offsets]

    @cached_property
    def table(self) -> tuple[list[int], list[int]]:
        if self._odd:
            return self._words(self.text)[:2]
        ends, at = [0], 0
        for c in self._chunks:
            at = self.text.index(c, at) + len(c)
            ends.append(at)
        return ends, self._sums

    def _count(self, text: str) -> int:
        return len(self._memo.tokens.encode(text, add_special_tokens=False).ids)

    def upto(self, end: int) -> int:
        """Tokens of the first ``end`` code points."""
        if end <= 0:
            return 0
        ends, counts = self.table
        k = bisect_right(ends, end) - 1
        return counts[k] + (self._count(self.text[ends[k] : end]) if end > ends[k] else 0)

    def fits(self, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens."""
        if budget < 0:
            return 0
        if self.total <= budget:
            return len(self.text)
        ends, counts = self.table
        k = bisect_right(counts, budget) - 1
        base, left = ends[k], budget - counts[k]
        rest = self.text[base : ends[k + 1] if k + 1 < len(ends) else None]
        words, sums, tokens = self._words(rest)
        j = bisect_right(sums, left) - 1
        start, left = words[j], left - sums[j]
        piece = rest[start : words[j + 1] if j + 1 < len(words) else None]
        top = len(piece) - 1 if len(piece) <= LONG else min(len(piece) - 1, tokens[sums[j] + left] - start + 64)
        for n in range(top, 0, -1):
            if self._count(piece[:n]) <= left:
                return base + start + n
        return base + start


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, keep_table: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars (code points of the longest prefix within the limit); with ``keep_table`` also prefix_ends and prefix_tokens.

    One row for each row of ``docs`` (repeated rows too); other columns are ignored.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + ", prefix_ends array<int>, prefix_tokens array<int>" * keep_table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(path, len)
        for batch in batches:
            size, total, fit, ends, counts = [], [], [], [], []
            for raw in binary(batch.column(1)):
                t = PrefixCounts((raw or b"").decode(), memo)
                size.append(len(raw or b""))
                total.append(t.total)
                fit.append(t.fits(limit))
                if keep_table:
                    ends.append(t.table[0])
                    counts.append(t.table[1])
            columns = [batch.column(0), pa.array(size, pa.int64()), pa.array(total, pa.int64()), pa.array([n > limit for n in total], pa.bool_()), pa.array(fit, pa.int64())]
            if keep_table:
                columns += [pa.array(ends, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
