"""Packing documents into sequences of fixed capacity.

Each document's ids are cut into full windows and a remainder. Remainders wait
in a pool; whenever it is full, windows are filled by minimum bin slack: the
longest waiting remainder goes first, and a subset-sum over the multiset of the
other lengths, kept as the bits of one integer, finds the filling closest to the
capacity; backtracking gives how many of each length it takes. Slack that is
left is closed by cutting one more remainder, and what is over at the end of a
task is cut to powers of two, so nothing is padded.

Each task packs its own documents in one pass with a pool of bounded size:
there is no shuffle, no collected plan, and no state between tasks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from laplake.llm.frames import binary_array
from laplake.llm.tokens import append_id, token_slices

CAPACITY = 2048
POOL_WINDOWS = 2048  # windows' worth of ids that may wait in a task's pool
SEQUENCES = 1 << 33  # sequence ids set aside for each task


def best_filling(lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length fill ``capacity`` with the least slack.

    ``lengths`` are the distinct lengths, longest first. Bit s of the integer says
    that the sum s can be reached; the multiples of one length enter by doubling.
    """
    reach, steps = 1, []
    mask, goal = (1 << (capacity + 1)) - 1, 1 << capacity
    for length in lengths:
        left, times = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(times, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            times *= 2
            if reach & goal:
                left = 0
        if reach & goal:
            break
    at = reach.bit_length() - 1
    chosen: dict[int, int] = defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] += take
            at -= length * take
    return dict(chosen)


class Pool:
    """Remainders by length, and the windows made of them."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.waiting: dict[int, list] = defaultdict(list)
        self.total = 0

    def put(self, length: int, piece) -> None:
        self.waiting[length].append(piece)
        self.total += length

    def take(self, length: int):
        held = self.waiting[length]
        piece = held.pop()
        if not held:
            del self.waiting[length]
        self.total -= length
        return piece

    def windows(self, down_to: int) -> Iterator[list[tuple[int, tuple]]]:
        """Full windows, as (length, piece) lists, while enough ids wait."""
        while self.total >= max(self.capacity, down_to):
            lengths = sorted(self.waiting, reverse=True)
            longest, room = lengths[0], self.capacity - lengths[0]
            counts = {n: len(held) for n, held in self.waiting.items()}
            counts[longest] -= 1
            chosen = best_filling([n for n in lengths if n <= room and counts[n]], counts, room) if room else {}
            chosen[longest] = chosen.get(longest, 0) + 1
            slack = self.capacity - sum(n * m for n, m in chosen.items())
            # The same filling serves as often as its lengths last.
            times = 1 if slack else min((counts[n] + (n == longest)) // m for n, m in chosen.items())
            for _ in range(min(times, max(1, (self.total - down_to) // self.capacity))):
                window = [(n, self.take(n)) for n, m in chosen.items() for _ in range(m)]
                yield [*window, *self.cut(slack)]

    def cut(self, length: int) -> list[tuple[int, tuple]]:
        """Pieces of ``length`` ids in all, cut off what waits."""
        out = []
        while length:
            n = max(self.waiting)
            row, start, ids = self.take(n)
            part = min(n, length)
            out.append((part, (row, start, ids[:part])))
            if part < n:
                self.put(n - part, (row, start + part, ids[part:]))
            length -= part
        return out

    def rest(self) -> Iterator[list[tuple[int, tuple]]]:
        """The last ids of a task, cut to powers of two."""
        while self.total:
            yield self.cut(min(self.capacity, 1 << (self.total.bit_length() - 1)))


def pack(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", end_id: int = 1,
         capacity: int = CAPACITY, path: str | None = None, pool_windows: int = POOL_WINDOWS) -> DataFrame:
    """Pieces of documents in sequences: (doc id, start, length, ids, doc_tokens, sequence_id, offset).

    ``ids`` are little-endian unsigned 32-bit values. A null or empty text is its
    end id alone. Repeated rows are packed each for itself, null ids stay null.
    ``path`` names the tokenizer file. ``capacity`` must be a power of two. The
    documents should come from files: a lost task then meets the same rows again.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    longs = ("start", "length", "doc_tokens", "sequence_id", "offset")
    schema = StructType([
        StructField(doc_id, documents.schema[doc_id].dataType), *(StructField(n, LongType()) for n in longs),
        StructField("ids", BinaryType())])

    def rows(windows, sequence: int):
        found, values = [], []
        for window in windows:
            at = 0
            for length, ((name, tokens), start, ids) in window:
                found.append((name, start, length, tokens, sequence, at))
                values.append(ids)
                at += length
            sequence += 1
        if found:
            names, start, length, tokens, owner, offset = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([
                pa.array(names, kind[0]), *(pa.array(v, pa.int64()) for v in (start, length, tokens, owner, offset)),
                binary_array(np.concatenate(values).astype("<u4"), length)], names=schema.names)
        return sequence

    kind: list[pa.DataType] = []

    def run(batches):
        sequence = TaskContext.get().partitionId() * SEQUENCES
        pool = Pool(capacity)
        for part, ids, bounds in token_slices(batches, text, path):
            names = part.column(doc_id)
            if not kind:
                kind.append(names.type)
            ids, bounds = append_id(ids, bounds, end_id)
            full = []
            for i, (name, a, b) in enumerate(zip(
                    names.to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                row, size = (name, b - a), b - a
                for start in range(0, size - capacity + 1, capacity):
                    full.append([(capacity, (row, start, ids[a + start:a + start + capacity]))])
                if left := size % capacity:
                    pool.put(left, (row, size - left, ids[b - left:b].copy()))
            sequence = yield from rows(full, sequence)
            if pool.total > pool_windows * capacity:
                sequence = yield from rows(pool.windows(pool_windows * capacity // 4), sequence)
        sequence = yield from rows(pool.windows(0), sequence)
        yield from rows(pool.rest(), sequence)

    return documents.select(doc_id, text).mapInArrow(run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences: (sequence_id, length, ids), pieces joined in order."""
    held = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.aggregate(held, F.lit(b""), lambda out, piece: F.concat(out, piece["ids"])).alias("ids"))
