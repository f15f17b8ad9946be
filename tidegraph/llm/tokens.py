"""Exact token ids and counts, memoised by chunk.

Natural text repeats its chunks (a word with the white space before it), so each
distinct chunk is encoded once per worker and looked up afterwards. A cut is
made only where the tokenizer itself always cuts, in front of white space that
follows other characters, so the pieces' ids are the whole text's ids. Texts
with white space on which the regular expression engines may disagree are
encoded whole.
"""

from __future__ import annotations

import os
import re

#: White space outside ASCII's usual six, or read differently by some engines.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​ -  ⁠　﻿]")
CHUNK = re.compile(r"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
#: Chunks longer than this are not kept, and the memory is emptied when full.
LONGEST_KEPT, MOST_KEPT = 64, 400_000

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _loaded:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def rank_encoder(path: str, pattern: str):
    """The byte-level vocabulary's rank file: the same ids as its JSON file for text without special strings."""
    if path not in _loaded:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path].encode_ordinary


class Memo:
    """``value(ids)`` of any chunk, encoded at most once while it is kept.

    With ``ranks`` (rank file, pattern), chunks that cannot hold a special string
    go through the faster rank encoder.
    """

    def __init__(self, path: str, value, ranks: tuple[str, str] | None = None):
        self.tokens = tokenizer(path)
        self.batch = self.tokens.encode_batch_fast
        self.ranks = rank_encoder(*ranks) if ranks else None
        self.value = value
        self.kept: dict[str, object] = {}

    def encode(self, chunks: list[str]) -> list[list[int]]:
        if self.ranks is None:
            return [e.ids for e in self.batch(chunks, add_special_tokens=False)]
        return [self.ranks(c) if "<|" not in c else self.batch([c], add_special_tokens=False)[0].ids for c in chunks]

    def whole(self, text: str):
        return self.value(self.batch([text], add_special_tokens=False)[0].ids)

    def of(self, chunks: list[str]) -> list:
        """The values of ``chunks``, in order."""
        kept = self.kept
        new = [c for c in set(chunks) if c not in kept]
        if new:
            if len(kept) + len(new) > MOST_KEPT:
                kept.clear()
                new = list(set(chunks))
            for c, ids in zip(new, self.encode(new), strict=True):
                kept[c] = self.value(ids)
        out = [kept[c] for c in chunks]
        for c in new:
            if len(c) > LONGEST_KEPT:
                del kept[c]
        return out


def leading_chunks(text: str) -> list[str]:
    """Chunks that start with the white space in front of a word."""
    return CHUNK.findall(text)
