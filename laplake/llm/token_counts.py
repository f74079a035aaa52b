"""Token counts without tokens.

A pre-token's symbols form a linked list; a heap holds the rank and place of
every adjacent pair. The lowest rank is popped and merged until none is left.
The count is the number of symbols less the number of merges, so no identifier
is ever put out. Each distinct pre-token is merged once per worker.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField

from laplake.llm.frames import attach
from laplake.llm.text import per_worker, row_slices
from laplake.llm.tokens import ByteTokenizer, byte_letters, vocabulary_path


class PairMerger:
    """Ranks of symbol pairs, and the symbol that each merge makes."""

    def __init__(self, spec: dict):
        vocabulary = spec["model"]["vocab"]
        self.first = [vocabulary[c] for c in byte_letters()]
        self.base = max(vocabulary.values()) + 1
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for pair in spec["model"]["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocabulary[left] * self.base + vocabulary[right]] = len(self.made)
            self.made.append(vocabulary[left + right])

    def count(self, word: bytes) -> int:
        """Number of symbols that are left of ``word`` after all merges."""
        symbols = [self.first[b] for b in word]
        n = len(symbols)
        if n == 1:
            return 1
        rank, base, made = self.rank, self.base, self.made
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [
            (r, i) for i in range(n - 1) if (r := rank.get(symbols[i] * base + symbols[i + 1])) is not None]
        heapify(heap)
        merges = 0
        while heap:
            r, i = heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= n or rank.get(symbols[i] * base + symbols[j]) != r:
                continue
            symbols[i], symbols[j] = made[r], -1
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (found := rank.get(symbols[i] * base + symbols[k])) is not None:
                    heappush(heap, (found, i))
            h = before[i]
            if h >= 0 and (found := rank.get(symbols[h] * base + symbols[i])) is not None:
                heappush(heap, (found, h))
        return n - merges


class TokenCounter:
    """Token counts of text columns; special strings in a text count as one token each."""

    def __init__(self, path: str):
        self.words = ByteTokenizer(path, word_values=lambda word: [self.merger.count(word)])
        self.merger = PairMerger(self.words.spec)
        added = self.words.spec.get("added_tokens", [])
        odd = any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word", "normalized"))
        model = self.words.spec["model"]
        if not self.words.plain or odd or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-level pair vocabulary")
        self.special = re.compile("|".join(
            re.escape(t) for t in sorted(self.words.special, key=len, reverse=True)) or r"(?!)")
        self.words.special = []

    def column(self, column: pa.Array) -> np.ndarray:
        column = pc.fill_null(column, "")
        extra = np.zeros(len(column), dtype=np.int64)
        rare = np.flatnonzero(pc.match_substring_regex(column, self.special.pattern).to_numpy(zero_copy_only=False)) \
            if self.special.pattern != "(?!)" else []
        for i in rare:
            pieces = self.special.split(column[int(i)].as_py())
            extra[i] = len(pieces) - 1 + int(self._plain(pa.array(pieces, pa.string())).sum())
        counts = self._plain(column)
        counts[rare] = extra[rare]
        return counts

    def _plain(self, column: pa.Array) -> np.ndarray:
        values, bounds = self.words.column(column)
        total = np.zeros(len(values) + 1, dtype=np.int64)
        np.cumsum(values, out=total[1:])
        return total[bounds[1:]] - total[bounds[:-1]]


def count_tokens(documents: DataFrame, text: str = "text", path: str | None = None,
                 n_bytes: str = "n_bytes", n_tokens: str = "n_tokens") -> DataFrame:
    """Documents with their UTF-8 size and number of tokens.

    Null and empty texts have 0 of both. Rows stay as they are, repeated or not.
    No begin, end or padding token counts; special strings inside a text do, as one.
    """

    def run(batch):
        where = vocabulary_path(path)
        counter = per_worker(f"counter:{where}", lambda: TokenCounter(where))
        column = batch.column(text)
        found = [counter.column(column.slice(at, to - at)) for at, to in row_slices(column)]
        size = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
        return [size, pa.array(np.concatenate(found) if found else [], pa.int64())]

    return attach(documents, [StructField(n_bytes, LongType()), StructField(n_tokens, LongType())], run)
