"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

The ids of a piece (a stretch between two cuts of the vocabulary's split pattern)
are found by dynamic programming over its prefixes. For each prefix there is one
token only that can end its encoding: among the vocabulary's strings that are
suffixes of the prefix (given by an automaton over the vocabulary) it is the one
that is compatible with the last token of the prefix before it. Two tokens are
compatible if BPE, given their bytes side by side, would leave just these two.
Following the stored tokens backwards yields the ids. Work and memory grow in
proportion to a piece's length, also for very long ones.

Pieces repeat, so each worker keeps those it has met (at most ``MEMO`` of them;
the memory is emptied when full, which changes no result).

Null and empty texts give an empty list. Strings that look like special tokens are
ordinary text. Rows and their order within a partition are kept; equal rows stay.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary files are; a parameter of every function that reads them.
VOCABULARY_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"

#: The split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

MEMO = 1 << 17
MEMO_BYTES = 64
OUT_ROWS = 512


class PrefixEncoder:
    """Exact BPE ids by one stored token per prefix."""

    def __init__(self, folder: str, name: str) -> None:
        import ahocorasick
        import regex

        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            rank = {base64.b64decode(token): int(number) for token, number in map(bytes.split, f)}
        self.rank = rank
        self.length = {number: len(token) for token, number in rank.items()}
        self.halves, self.joined = self._merges(folder, name)
        self.automaton = ahocorasick.Automaton()
        for token, number in rank.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), number))
        self.automaton.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.compatible: dict[int, bool] = {}
        self.memo: dict[str, list[int]] = {}

    def _merges(self, folder: str, name: str) -> tuple[dict[int, tuple[int, int]], dict[tuple[int, int], int]]:
        """The two halves each token was last joined from, and the token that two halves join to."""
        path = os.path.join(folder, f"{name}.json")
        shown = _shown_bytes()
        halves: dict[int, tuple[int, int]] = {}
        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        for merge in merges:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = bytes(shown[c] for c in left), bytes(shown[c] for c in right)
            halves[self.rank[a + b]] = (self.rank[a], self.rank[b])
        return halves, {pair: token for token, pair in halves.items()}

    def _fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves exactly (left, right) of their bytes.

        The last joins on either side of the border are undone from the latest
        to the earliest. At each step the two tokens that touch at the border
        must not have had a join of their own that BPE would have made sooner.
        """
        key = left << 32 | right
        known = self.compatible.get(key)
        if known is not None:
            return known
        limit = 1 << 62
        a, b = left, right
        while True:
            if self.joined.get((a, b), limit) < limit:
                verdict = False
                break
            undo_a, undo_b = self.halves.get(a), self.halves.get(b)
            if undo_a is None and undo_b is None:
                verdict = True
                break
            if undo_b is None or (undo_a is not None and a > b):
                limit, a = a, undo_a[1]
            else:
                limit, b = b + 1, undo_b[0]
        if len(self.compatible) >= 1 << 20:
            self.compatible.clear()
        self.compatible[key] = verdict
        return verdict

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        length, fits = self.length, self._fits
        last = [-1] * (len(piece) + 1)
        at = 0
        for end, (size, token) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if end != at:
                at = end
            elif last[end] >= 0:
                continue
            start = end - size
            before = last[start]
            if start == 0 or (before >= 0 and fits(before, token)):
                last[end] = token
        ids, end = [], len(piece)
        while end:
            token = last[end]
            ids.append(token)
            end -= length[token]
        ids.reverse()
        return ids

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        if not text:
            return ids
        memo = self.memo
        for piece in self.split(text):
            found = memo.get(piece)
            if found is None:
                found = self.encode_piece(piece.encode())
                if len(piece) <= MEMO_BYTES:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = found
            ids += found
        return ids


def _shown_bytes() -> dict[str, int]:
    """The printable character by which the vocabulary's file shows each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@cache
def encoder(folder: str = VOCABULARY_DIR, name: str = VOCABULARY) -> PrefixEncoder:
    """One encoder per process and vocabulary."""
    return PrefixEncoder(folder, name)


def with_ids(df: DataFrame, text: str = "text", ids: str = "ids", folder: str = VOCABULARY_DIR, name: str = VOCABULARY) -> DataFrame:
    """``df`` without ``text``, with the token ids as ``ids`` (an existing column of that name is replaced)."""
    return _encoded(df, text, ids, "array<bigint>", pa.list_(pa.int64()), lambda e: e.encode, folder, name)


def with_token_count(df: DataFrame, text: str = "text", count: str = "n_tokens", folder: str = VOCABULARY_DIR, name: str = VOCABULARY) -> DataFrame:
    """``df`` without ``text``, with the number of its tokens; 0 for null and empty texts."""
    return _encoded(df, text, count, "bigint", pa.int64(), lambda e: lambda t: len(e.encode(t)), folder, name)


def _encoded(df: DataFrame, text: str, out: str, kind: str, arrow: pa.DataType, work, folder: str, name: str) -> DataFrame:
    kept = [c for c in df.columns if c not in (text, out)]
    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), f"`{out}` {kind}"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = work(encoder(folder, name))
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(at, OUT_ROWS)
                made = pa.array(map(encode, part.column(text).to_pylist()), arrow)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), made], names=[*kept, out])

    return df.select(*kept, text).mapInArrow(kernel, schema)
