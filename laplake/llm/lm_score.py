"""Language-model scores by online logistic context mixing.

A text is its lower-cased words and an end mark; each is spelled as bytes, each
byte as the bits of a fixed prefix code. Several predictors give every bit a log
odds: from hashed tables of bit counts by the last two and four bytes of the
word, and by the whole beginning of the word. Weights, chosen by how often the
two longest contexts were seen, mix the log odds; corrections of the weights are
refined after every bit, from the bits already seen.

All counts come from all training texts. Words are counted per block of texts,
summed per hash shard, and sent back to their blocks, so no task holds more than
a block or a shard and frequent words cost one entry per block. The predictors'
tables are sums over all distinct training words; their size is a parameter, so
they can be sent to all tasks. A bit depends on its own word only, so the first
weights, too, are fitted on every bit of every training text by going through the
distinct training words with their counts. Words share the bits of a common
beginning, which are worked out once for all of them.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from laplake.llm.frames import attach, staged
from laplake.llm.text import (
    SPAN,
    _powers,
    blank_class,
    flat_bytes,
    lowered,
    mix,
    per_worker,
    row_slices,
    span_hashes,
    word_bounds,
)
from laplake.llm.token_files import canonical_codes, code_lengths
from laplake.operators.groups import join_on

WORD_END, TEXT_END = 0x20, 0x0A
TABLE_BITS = (19, 21)  # slots of the tables for two and four bytes
REACH = (2, 4)
START_BITS = 24  # slots of the table for word beginnings
RANGE_BITS = 14  # slots of a table that one group sums
INPUTS = len(REACH) + 2  # and a constant
START_LEVELS, REACH_LEVELS = 8, 4
GATES = START_LEVELS * REACH_LEVELS
FIRST_WEIGHTS = [0.3] * (INPUTS - 1) + [0.0]
SCALE = 8.0  # a stored count is this many times log2(count + 1)
LANE = 4096  # bits after which corrections start anew
STEPS = 16  # bits of every lane that are fetched at a time
RATE = 0.002
LIMIT = 14.0  # no bit is thought surer than this log odds
PRIOR_BITS = 50.0  # strength of the first weights against those that are fitted
FIT_STEPS = 2
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 8 << 20
PIECE = 1 << 15  # letters that are spelled at a time, so that working arrays stay in the cache
HELD_BITS = 2 << 20  # bits of word beginnings after which a shard's counts are put out
ROW = 8  # numbers set aside for a bit; with fewer, look-ups take longer


def byte_code() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code length of each byte, its bits, and the tree node before each bit."""
    weight = np.ones(256, dtype=np.int64)
    weight[0x61:0x7B], weight[0x80:], weight[0x30:0x3A], weight[WORD_END] = 40, 3, 4, 700
    weight[np.frombuffer(b"etaonihsrdlu", dtype=np.uint8)] = 250
    lengths = code_lengths(weight).astype(np.int64)
    codes = canonical_codes(lengths).astype(np.int64)
    longest = int(lengths.max())
    bits = np.zeros((256, longest), dtype=np.int8)
    nodes = np.zeros((256, longest), dtype=np.int64)
    for b in range(256):
        for k in range(lengths[b]):
            bits[b, k] = codes[b] >> (lengths[b] - k - 1) & 1
            nodes[b, k] = (1 << k) + (codes[b] >> (lengths[b] - k))
    return lengths, bits, nodes


#: A hash of each node of the code's tree; nodes have fewer than 2**16 numbers.
NODE_HASH = (mix(np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
SCATTER = np.uint32(0x9E3779B1)


def letter_codes() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code length of each byte, where its bits begin among all bytes' bits, these bits, and the hashed nodes before them."""
    lengths, bits, nodes = byte_code()
    used = np.arange(bits.shape[1]) < lengths[:, None]
    return lengths, np.cumsum(lengths) - lengths, bits[used], NODE_HASH[nodes[used]] * SCATTER


class Letters:
    """Words as letters, each word with its end, and hashes of the words' beginnings."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, end_mark: bool = False):
        size = ends - starts + 1
        first = np.cumsum(size) - size
        total = int(size.sum())
        letters = data.take(np.repeat(starts - first, size) + np.arange(total), mode="clip")
        letters[first + size - 1] = WORD_END
        if end_mark:
            # The end of a text is one more word, of the end mark alone.
            letters = np.append(letters, np.uint8(TEXT_END))
            first, size = np.append(first, total), np.append(size, 1)
        self.letters, self.first, self.size = letters, first, size
        self.place = np.arange(len(letters)) - np.repeat(first, size)
        self.begun = self._begun()

    def _begun(self) -> np.ndarray:
        """Hash of the letters of its word up to each letter."""
        letters, first, size = self.letters, self.first, self.size
        out = np.empty(len(letters), dtype=np.uint64)
        ends = first + size
        at = 0
        while at < len(first):
            begin = int(first[at])
            to = max(at + 1, int(np.searchsorted(ends, begin + SPAN, side="right")))
            stop = int(ends[to - 1])
            up, down, table = _powers(stop - begin + 1)
            sums = np.zeros(stop - begin + 1, dtype=np.uint64)
            np.cumsum(table[letters[begin:stop]] * up[:stop - begin], out=sums[1:])
            own = first[at:to] - begin
            np.subtract(sums[1:], np.repeat(sums[own], size[at:to]), out=out[begin:stop])
            out[begin:stop] *= np.repeat(down[own], size[at:to])
            at = to
        return out

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """For every letter the number of the beginning that ends with it, and a place of each distinct beginning."""
        codes, keys = pd.factorize(self.begun)
        at = np.empty(len(keys), dtype=np.int64)
        at[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        return codes, at


class Spelling:
    """Letters of words as bits: for every bit its value and its slot in each table."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, end_mark: bool = False):
        known = Letters(data, starts, ends, end_mark)
        self._spell(known, np.arange(len(known.letters)))
        # Bits of each word.
        self.bounds = self.bounds[np.append(known.first, len(known.letters))]

    @classmethod
    def of(cls, known: Letters, at: np.ndarray) -> Spelling:
        """The letters at some places; ``bounds`` are those of the letters."""
        out = cls.__new__(cls)
        out._spell(known, at)
        return out

    def _spell(self, known: Letters, at: np.ndarray) -> None:
        letters, place = known.letters.take(at), known.place.take(at)
        lengths, code_starts, code_bits, code_nodes = per_worker("letter_codes", letter_codes)
        number = lengths.take(letters)
        self.bounds = np.zeros(len(at) + 1, dtype=np.int64)
        np.cumsum(number, out=self.bounds[1:])
        step = np.repeat(code_starts.take(letters) - self.bounds[:-1], number)
        step += np.arange(len(step))
        self.bits = code_bits.take(step)
        node = code_nodes.take(step)
        self.slots = []
        context = np.zeros(len(at), dtype=np.uint64)
        back = 0
        for reach, width in zip(REACH, TABLE_BITS, strict=True):
            while back < reach:
                back += 1
                before = known.letters.take(at - back, mode="clip")
                before[place < back] = 0
                context = context * np.uint64(257) + before
            self.slots.append(self._slot(mix(context + np.uint64(reach << 56)), number, node, width))
        begun = known.begun.take(at - 1, mode="clip")
        begun[place == 0] = 0
        self.slots.append(self._slot(mix(begun), number, node, START_BITS))

    @staticmethod
    def _slot(key: np.ndarray, number: np.ndarray, node: np.ndarray, width: int) -> np.ndarray:
        slot = np.repeat((key >> np.uint64(32)).astype(np.uint32) * SCATTER, number)
        slot += node
        slot >>= np.uint32(32 - width)
        return slot


def spelled_once(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, times: np.ndarray) -> tuple[Spelling, np.ndarray]:
    """Each distinct beginning's last letter as bits, and how often each bit occurs in words that occur ``times`` times."""
    known = Letters(data, starts, ends)
    codes, at = known.distinct()
    spelled = Spelling.of(known, at)
    return spelled, np.repeat(np.bincount(codes, np.repeat(times, known.size), len(at)), np.diff(spelled.bounds))


def pieces(size: np.ndarray):
    """Ranges of words of about ``PIECE`` letters together."""
    total = np.cumsum(size + 1)
    at = 0
    while at < len(size):
        before = int(total[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + PIECE, side="right")))
        yield at, to
        at = to


def spelled_out(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The letters of words, one word after the other."""
    total = np.cumsum(size)
    return data[np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - size), size)]


def counted_on(values: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Whole numbers that go up by one, but for given values at given places, of which the first is 0."""
    out = np.ones(size, dtype=np.int32 if size < 1 << 30 else np.int64)
    out[places[:1]] = values[:1]
    out[places[1:]] = 1 + np.diff(values) - np.diff(places)
    return np.cumsum(out, dtype=out.dtype, out=out)


def stored(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale of one byte; small ones can be told apart."""
    return np.minimum(255, np.rint(np.log2(counts + 1.0) * SCALE)).astype(np.uint8)


def counted() -> np.ndarray:
    """The count behind each stored byte."""
    return np.exp2(np.arange(256) / SCALE) - 1


def paired(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Stored counts of zeros and of ones side by side, so that one look-up gives both."""
    return zeros.astype(np.uint16) << 8 | ones


def add_end_marks(tables: list[np.ndarray], texts: int) -> None:
    """Count the end mark of ``texts`` texts in the paired counts."""
    mark = end_mark()
    for table, slots in zip(tables, mark.slots, strict=True):
        sides = [table[slots] >> 8, table[slots] & 255]
        for value, side in enumerate(sides):
            mine = mark.bits == value
            side[mine] = stored(counted()[side[mine]] + texts)
        table[slots] = paired(*sides)


def end_mark() -> Spelling:
    none = np.zeros(0, dtype=np.int64)
    return Spelling(np.zeros(0, dtype=np.uint8), none, none, end_mark=True)


def _pair_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every pair of stored counts (zeros, then ones) the log odds, and what the sum
    adds to the number of the gate for the longest reach and for the beginning."""
    count = counted()
    zeros, ones = np.repeat(count, 256), np.tile(count, 256)
    level = np.log2(zeros + ones + 1.01).astype(np.uint8)
    return (np.log((ones + 0.4) / (zeros + 0.4)).astype(np.float32), np.minimum(REACH_LEVELS - 1, level // 2),
            np.minimum(START_LEVELS - 1, level) * np.uint8(REACH_LEVELS))


def _less_table() -> np.ndarray:
    """Every pair of stored counts with one zero taken off, then every pair with one one taken off."""
    all_counts = np.arange(256, dtype=np.uint8)
    less = stored(np.maximum(0, counted() - 1))
    return np.append(paired(np.repeat(less, 256), np.tile(all_counts, 256)), paired(np.repeat(all_counts, 256), np.tile(less, 256)))


class Mixer:
    """Tables, first weights, and the scoring of texts."""

    def __init__(self, tables: list, weights: np.ndarray | None = None):
        # Each table is one array of paired counts, or two arrays of stored counts.
        self.tables = [t if isinstance(t, np.ndarray) else paired(*t) for t in tables]
        self.weights = np.tile(np.array(FIRST_WEIGHTS, dtype=np.float32), (GATES, 1)) if weights is None else weights

    def inputs(self, spelled: Spelling, leave_out: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of every predictor for every bit (one row per predictor), and the gate of every bit.

        ``leave_out`` takes the bit itself off the counts, for texts that were counted.
        """
        odds, *levels = per_worker("pair_tables", _pair_tables)
        x = np.ones((INPUTS, len(spelled.bits)), dtype=np.float32)
        gate = np.zeros(len(spelled.bits), dtype=np.uint8)
        for i, (table, slots) in enumerate(zip(self.tables, spelled.slots, strict=True)):
            pair = table.take(slots)
            if leave_out:
                pair = per_worker("less_table", _less_table).take(pair + (spelled.bits.astype(np.int64) << 16))
            pair = pair.astype(np.int64)
            x[i] = odds.take(pair)
            if i >= len(REACH) - 1:
                gate += levels[i - len(REACH) + 1].take(pair)
        return x, gate

    @staticmethod
    def _distinct(column: pa.Array):
        """Lowered bytes, where each distinct word starts and ends there, and the texts as numbers of words."""
        data, bounds = flat_bytes(column)
        data = lowered(data)
        starts, ends, owner = word_bounds(data, bounds, blank_class())
        codes, keys = pd.factorize(span_hashes(data, starts, ends))
        first = np.empty(len(keys), dtype=np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        # Each text's words, then the end mark, which is the last distinct word.
        texts = len(bounds) - 1
        words = np.diff(np.searchsorted(owner, np.arange(texts + 1)))
        cuts = np.zeros(texts + 1, dtype=np.int64)
        np.cumsum(words + 1, out=cuts[1:])
        sequence = np.full(cuts[-1], len(keys), dtype=np.int64)
        own = np.ones(len(sequence), dtype=bool)
        own[cuts[1:] - 1] = False
        sequence[own] = codes
        return data, starts[first], ends[first], sequence, cuts

    def slopes(self, spelled: Spelling, mass: np.ndarray) -> np.ndarray:
        """By gate: slope of the log likelihood in each weight, and its curvature in each pair of weights.

        ``mass`` says how often each bit occurs.
        """
        x, gate = self.inputs(spelled, leave_out=True)
        # Bits of one gate side by side.
        order = np.argsort(gate, kind="stable")
        x, mass, bits = x.take(order, axis=1), mass.take(order), spelled.bits.take(order)
        number = np.bincount(gate, minlength=GATES)
        used = np.flatnonzero(number)
        first = (np.cumsum(number) - number)[used]
        z = sum(np.repeat(self.weights[:, i].astype(np.float32), number) * x[i] for i in range(INPUTS))
        p = 1 / (1 + np.exp(-np.clip(z, -20, 20).astype(np.float64)))
        miss, curve = mass * (bits - p), mass * p * (1 - p)
        sums = [miss * x[i] for i in range(INPUTS)]
        for i in range(INPUTS):
            own = curve * x[i]
            sums += [own * x[j] for j in range(i, INPUTS)]
        out = np.zeros((GATES, len(sums)))
        if len(used):
            out[used] = np.stack([np.add.reduceat(v, first) for v in sums], axis=1)
        return out

    def moved(self, slopes: np.ndarray) -> np.ndarray:
        """The weights after a Newton step."""
        weights = self.weights.astype(np.float64)
        for w, sums in zip(weights, slopes, strict=True):
            curve = np.zeros((INPUTS, INPUTS))
            curve[np.triu_indices(INPUTS)] = sums[INPUTS:]
            curve += np.triu(curve, 1).T + PRIOR_BITS * np.eye(INPUTS)
            w += np.linalg.solve(curve, sums[:INPUTS] - PRIOR_BITS * (w - FIRST_WEIGHTS))
        return np.clip(weights, -3, 3)

    def _rows(self, known: Letters, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What scoring needs of every bit of the letters at some places, and where each one's bits begin.

        With the sign of the bit that did not come: the inputs times the root of the
        rate, and their sum under the first weights.
        """
        bounds = np.zeros(len(at) + 1, dtype=np.int64)
        np.cumsum(per_worker("letter_codes", letter_codes)[0].take(known.letters.take(at)), out=bounds[1:])
        rows = np.zeros((max(int(bounds[-1]), STEPS), ROW), dtype=np.float32)
        for first in range(0, len(at), PIECE):
            spelled = Spelling.of(known, at[first:first + PIECE])
            x, gate = self.inputs(spelled)
            gate = gate.astype(np.int64)
            sign = (1 - 2 * spelled.bits).astype(np.float32)
            own = rows[bounds[first]:bounds[min(first + PIECE, len(at))]]
            own[:, INPUTS] = sum(self.weights[:, i].take(gate) * x[i] for i in range(INPUTS)) * sign
            x *= sign * np.float32(math.sqrt(RATE))
            own[:, :INPUTS] = x.T
        return rows, bounds

    def score(self, column: pa.Array) -> np.ndarray:
        """log10 of each text's probability."""
        data, starts, ends, sequence, cuts = self._distinct(column)
        known = Letters(data, starts, ends, end_mark=True)
        codes, at = known.distinct()
        rows, bounds = self._rows(known, at)
        # Rows of the distinct words' bits, and where each word's bits begin.
        size = np.diff(bounds).take(codes)
        place = np.cumsum(size) - size
        row = counted_on(bounds.take(codes), place, int(size.sum()))
        bounds = np.append(place[known.first], len(row))
        # The texts' bits as bits of distinct words; each text is filled up to whole steps by others that don't count.
        size = np.diff(bounds).take(sequence)
        total = np.zeros(len(sequence) + 1, dtype=np.int64)
        np.cumsum(size, out=total[1:])
        lengths = np.diff(total[cuts])
        whole = -(-lengths // STEPS)
        text_starts = np.cumsum(whole) - whole
        place = total[:-1] + np.repeat(text_starts * STEPS - total[cuts[:-1]], np.diff(cuts))
        bit = counted_on(bounds.take(sequence), place, int(whole.sum()) * STEPS).reshape(-1, STEPS)
        lanes = -(-lengths // LANE)
        owner = np.repeat(np.arange(len(lengths)), lanes)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = text_starts[owner] + number * (LANE // STEPS)
        left = np.minimum(LANE, lengths[owner] - number * LANE)
        order = np.argsort(-left, kind="stable")
        begin, left = begin[order], left[order]
        alive = np.searchsorted(-left, -np.arange(LANE), side="left")
        # Corrections over the root of the rate; the last row adds the sum under the first weights.
        change = np.zeros((INPUTS + 1, len(begin)), dtype=np.float32)
        change[INPUTS] = 1
        product = np.empty_like(change)
        chance = np.empty(len(begin), dtype=np.float32)
        found = np.empty((STEPS, len(begin), ROW), dtype=np.float32)
        turned = np.empty((STEPS, INPUTS + 1, len(begin)), dtype=np.float32)
        factors = np.empty((STEPS, len(begin)), dtype=np.float32)
        cost = np.zeros(len(begin), dtype=np.float64)
        low, high, one = np.float32(-LIMIT), np.float32(LIMIT), np.float32(1)
        for first in range(0, int(left[0]) if len(left) else 0, STEPS):
            n = int(alive[first])
            at = row.take(bit.take(begin[:n] + first // STEPS, axis=0), mode="clip")
            for step in range(STEPS):
                rows.take(at[:, step], axis=0, mode="clip", out=found[step, :n])
            ahead, either = turned[:, :, :n], factors[:, :n]
            ahead[:] = found[:, :n, :INPUTS + 1].transpose(0, 2, 1)
            own, part, odds = change[:, :n], product[:, :n], chance[:n]
            weights, parts = own[:INPUTS], part[:INPUTS]
            for inputs, both in zip(ahead, either, strict=True):
                np.multiply(inputs, own, out=part)
                np.add.reduce(part, axis=0, out=odds)
                np.minimum(odds, high, out=odds)
                np.maximum(odds, low, out=odds)
                np.exp(odds, out=odds)
                np.add(odds, one, out=both)
                # Chance of the bit that did not come.
                np.divide(odds, both, out=odds)
                np.multiply(inputs[:INPUTS], odds, out=parts)
                np.subtract(weights, parts, out=weights)
            # Steps after the end of a lane.
            for step, on in enumerate(alive[first:first + STEPS].tolist()):
                either[step, on:] = 1
            # Four factors are below e ** 57, which fits.
            fours = np.multiply.reduce(factors.reshape(-1, 4, len(begin))[:, :, :n], axis=1)
            cost[:n] -= np.log(np.multiply.reduce(fours, axis=0, dtype=np.float64))
        out = np.zeros(len(lengths))
        np.add.at(out, owner[order], cost)
        return out / math.log(10)


def _blocks(documents: DataFrame, doc_id: str, text: str, trained: Column, shards: int) -> DataFrame:
    """Word counts per block of texts.

    One row per block and shard: hashes, training counts and spellings of the
    block's words there. One row per block, without shard: its texts, and for each
    word in the same order the texts that have it, and how often.
    """
    kind = documents.schema[doc_id].dataType
    schema = StructType([
        StructField("block", LongType()), StructField("shard", IntegerType()),
        *(StructField(c, BinaryType()) for c in ("a", "b", "c", "d")),
        StructField("ids", ArrayType(kind)), StructField("keys", ArrayType(LongType())), StructField("words", ArrayType(LongType()))])

    def one_block(number: int, batch: pa.Table, id_type):
        column = batch.column(text)
        data, bounds = flat_bytes(column)
        data = lowered(data)
        starts, ends, owner = word_bounds(data, bounds, blank_class())
        codes, keys = pd.factorize(span_hashes(data, starts, ends))
        keys = keys.astype(np.uint64)
        first = np.empty(len(keys), dtype=np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        shard = ((keys >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((keys, shard))
        place = np.empty(len(keys), dtype=np.int64)
        place[order] = np.arange(len(keys))
        texts = len(bounds) - 1
        pairs, times = np.unique(place[codes] * texts + owner, return_counts=True)
        word, member = pairs // max(1, texts), pairs % max(1, texts)
        learned = np.asarray(batch.column("_trained").to_numpy(zero_copy_only=False), dtype=bool)
        counts = np.bincount(word, times * learned[member], minlength=len(keys)).astype("<i8")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        keys, first = keys[order], first[order]
        size = (ends - starts)[first]
        none = pa.ListArray.from_arrays(pa.array([0, 0], pa.int32()), pa.array([], id_type))
        no_longs = pa.ListArray.from_arrays(pa.array([0, 0], pa.int32()), pa.array([], pa.int64()))

        def row(s, values, lists):
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([s], pa.int32()), *(pa.array([v], pa.binary()) for v in values), *lists],
                names=schema.names)

        for s in np.flatnonzero(np.diff(cuts)).tolist():
            part = slice(int(cuts[s]), int(cuts[s + 1]))
            letters = spelled_out(data, starts[first[part]], size[part])
            yield row(s, [keys[part].astype("<u8").tobytes(), counts[part].tobytes(), letters.tobytes(),
                          size[part].astype("<u4").tobytes()], [none, no_longs, no_longs])
        one = pa.array([0, texts], pa.int32())
        words = np.bincount(owner, minlength=texts)
        yield row(None, [np.bincount(word, minlength=len(keys)).astype("<u4").tobytes(), member.astype("<u4").tobytes(),
                         times.astype("<u4").tobytes(), b""],
                  [pa.ListArray.from_arrays(one, batch.column(doc_id).combine_chunks()),
                   pa.ListArray.from_arrays(one, batch.column("_key").combine_chunks()),
                   pa.ListArray.from_arrays(one, pa.array(words, pa.int64()))])

    def run(batches):
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for at, to in row_slices(batch.column(text)):
                part = batch.slice(at, to - at)
                held.append(part)
                size += part.column(text).nbytes
                if size >= BLOCK_BYTES:
                    yield from one_block(number, pa.Table.from_batches(held), part.column(doc_id).type)
                    number, held, size = number + 1, [], 0
        if held:
            yield from one_block(number, pa.Table.from_batches(held), held[0].column(doc_id).type)

    rows = documents.select(
        doc_id, text, trained.alias("_trained"), F.xxhash64(F.col(text)).alias("_key"))
    return staged(rows.mapInArrow(run, schema), "word-blocks")


SUMMED = StructType([
    StructField("kind", StringType()), StructField("block", LongType()), StructField("shard", IntegerType()),
    StructField("a", BinaryType()), StructField("b", BinaryType()), StructField("c", BinaryType()), StructField("n", LongType()),
    StructField("slots", BinaryType()), StructField("sums", BinaryType())])


def _added(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's values."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)])
    return keys[first], np.add.reduceat(values[order], first) if len(first) else values


def _sum_shard(rows: pa.Table) -> pa.Table:
    """All blocks' words of one shard, summed.

    ``counts`` rows answer each block in its own order; ``words`` rows have the
    distinct training words; ``bits`` rows have the tables' counts by slot range,
    of slots times two, plus one for ones, as steps from one to the next.
    """
    shard = rows.column("shard")[0].as_py()
    held = [[np.frombuffer(v, dtype=kind) for v in rows.column(c).to_pylist()]
            for c, kind in (("a", "<u8"), ("b", "<i8"), ("d", "<u4"))]
    codes, keys = pd.factorize(np.concatenate(held[0]))
    counts = np.bincount(codes, np.concatenate(held[1]), minlength=len(keys)).astype("<i8")
    out = []
    at = 0
    for block, own in zip(rows.column("block").to_pylist(), held[0], strict=True):
        out.append(("counts", block, shard, counts[codes[at:at + len(own)]].tobytes(), None, None, None, None, None))
        at += len(own)
    size = np.concatenate(held[2]).astype(np.int64)
    ends = np.cumsum(size)
    data = np.frombuffer(b"".join(rows.column("c").to_pylist()), dtype=np.uint8)
    first = np.empty(len(keys), dtype=np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    first = first[counts > 0]
    counts = counts[counts > 0]
    # Words with one beginning side by side, so that a piece spells it once.
    padded = np.append(data, np.zeros(8, dtype=np.uint8))
    starts, letters = (ends - size)[first], np.zeros((len(first), 8), dtype=np.uint8)
    for i in range(8):
        letters[:, i] = np.where(size[first] > i, padded[starts + i], 0)
    order = np.argsort(letters.view(">u8")[:, 0], kind="stable")
    first, counts = first[order], counts[order]
    sums = [np.zeros(2 << w, dtype=np.int64) for w in TABLE_BITS]
    begun, bits = [], 0

    def put_out(i: int, width: int, used: np.ndarray, each: np.ndarray) -> None:
        cuts = np.searchsorted(used, np.arange(0, (2 << width) + 1, 2 << RANGE_BITS))
        for r in np.flatnonzero(np.diff(cuts)).tolist():
            part, values = used[cuts[r]:cuts[r + 1]], each[cuts[r]:cuts[r + 1]]
            steps = np.diff(part, prepend=r * (2 << RANGE_BITS))
            out.append(("bits", None, i << 16 | r, None, None, None, len(part),
                        *(v.astype(np.min_scalar_type(v.max())).tobytes() for v in (steps, values))))

    def put_out_begun() -> None:
        put_out(len(TABLE_BITS), START_BITS, *_added(*(np.concatenate(v) for v in zip(*begun, strict=True))))
        begun.clear()

    for at, to in pieces(size[first]):
        part = first[at:to]
        starts = ends[part] - size[part]
        joined = np.cumsum(size[part])
        letters = spelled_out(data, starts, size[part])
        number = counts[at:to]
        out.append(("words", None, shard, letters.tobytes(), size[part].astype("<u4").tobytes(), number.tobytes(), len(part), None, None))
        spelled, each = spelled_once(letters, joined - size[part], joined, number)
        each = each.astype(np.int64)
        keys = [slots << np.uint32(1) | spelled.bits.view(np.uint8) for slots in spelled.slots]
        for table, slots in zip(sums, keys, strict=False):
            np.add.at(table, slots, each)
        begun.append((keys[-1], each))
        bits += len(each)
        if bits >= HELD_BITS:
            put_out_begun()
            bits = 0
    if begun:
        put_out_begun()
    for i, (table, width) in enumerate(zip(sums, TABLE_BITS, strict=True)):
        used = np.flatnonzero(table)
        put_out(i, width, used, table[used])
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
    return pa.table([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names=SUMMED.names)


def _sum_range(rows: pa.Table) -> pa.Table:
    """One range of a table, summed over the shards, as paired counts."""
    table = np.zeros(2 << RANGE_BITS, dtype=np.int64)
    for number, steps, sums in zip(*(rows.column(c).to_pylist() for c in ("n", "slots", "sums")), strict=True):
        steps, sums = (np.frombuffer(v, dtype=f"<u{len(v) // number}").astype(np.int64) for v in (steps, sums))
        table[np.cumsum(steps)] += sums
    return pa.table({"shard": rows.column("shard").slice(0, 1), "pairs": [paired(stored(table[::2]), stored(table[1::2])).tobytes()]})


def context_tables(summed: DataFrame, texts: int) -> list[np.ndarray]:
    """The predictors' tables of paired counts, over all distinct training words and the end marks."""
    tables = [np.zeros(1 << w, dtype=np.uint16) for w in (*TABLE_BITS, START_BITS)]
    ranges = summed.where("kind = 'bits'").select("shard", "n", "slots", "sums").groupBy("shard").applyInArrow(
        _sum_range, "shard int, pairs binary")
    for r in ranges.collect():
        number = r["shard"] & 0xFFFF
        tables[r["shard"] >> 16][number << RANGE_BITS:(number + 1) << RANGE_BITS] = np.frombuffer(r["pairs"], dtype=np.uint16)
    add_end_marks(tables, texts)
    return tables


def first_weights(summed: DataFrame, texts: int, mixer: Callable) -> np.ndarray:
    """Weights of every gate that suit all training texts best, by Newton steps from ``FIRST_WEIGHTS``.

    Slopes and curvatures are summed over all distinct training words, each as often
    as it occurs, and the end marks. ``mixer(weights)`` makes the model.
    """
    known = summed.where("kind = 'words'").select("a", "b", "c")
    number = INPUTS + INPUTS * (INPUTS + 1) // 2
    sums = [F.sum(F.col("v")[i]) for i in range(number)]
    mark = end_mark()
    weights = None
    for _ in range(FIT_STEPS):

        def slopes(batches, weights=weights):
            total = np.zeros((GATES, number))
            for batch in batches:
                for letters, sizes, counts in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "c")), strict=True):
                    ends = np.cumsum(np.frombuffer(sizes, dtype="<u4").astype(np.int64))
                    total += mixer(weights).slopes(*spelled_once(
                        np.frombuffer(letters, dtype=np.uint8), np.concatenate([[0], ends[:-1]]), ends, np.frombuffer(counts, dtype="<i8")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(GATES), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["gate", "v"])

        model = mixer(weights)
        total = model.slopes(mark, np.full(len(mark.bits), float(texts)))
        for r in known.mapInArrow(slopes, "gate int, v array<double>").groupBy("gate").agg(F.array(*sums).alias("v")).collect():
            total[r["gate"]] += r["v"]
        weights = model.moved(total)
    return weights.astype(np.float32)


def _base_scores(blocks: DataFrame, counts: DataFrame, doc_id: str, base: tuple[int, int, int]) -> DataFrame:
    """(id, key, n_tokens, n_known, base_score) of every text, block by block."""
    tokens, distinct, texts = base
    kind = blocks.schema["ids"].dataType.elementType
    schema = StructType([
        StructField("_id", kind), StructField("_key", LongType()), StructField("n_tokens", LongType()),
        StructField("n_known", LongType()), StructField("base_score", DoubleType())])
    rest = math.log10(tokens + distinct + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pieces = sorted(zip(right.column("shard").to_pylist(), right.column("a").to_pylist(), strict=True))
        count = np.concatenate([np.frombuffer(v, dtype="<i8") for _, v in pieces]) if pieces else np.zeros(0)
        each, member, times = (np.frombuffer(left.column(c)[0].as_py(), dtype="<u4") for c in ("a", "b", "c"))
        words = left.column("words").combine_chunks().flatten().to_numpy()
        n = len(words)
        known = np.bincount(member, times * np.repeat(count > 0, each), minlength=n).astype(np.int64) + (texts > 0)
        total = np.bincount(member, times * np.repeat(np.log10(count + 1.0), each), minlength=n) + math.log10(texts + 1)
        return pa.table([
            left.column("ids").combine_chunks().flatten(), left.column("keys").combine_chunks().flatten(),
            pa.array(words + 1), pa.array(known), pa.array(total - (words + 1) * rest)], names=schema.names)

    own = blocks.where(F.col("shard").isNull()).select("block", "a", "b", "c", "ids", "keys", "words")
    return own.groupBy("block").cogroup(counts.select("block", "shard", "a").groupBy("block")).applyInArrow(run, schema)


def word_sums(documents: DataFrame, trained: Column, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, int]:
    """Word counts by block, their sums by shard, and the number of training texts."""
    trained = F.coalesce(trained, F.lit(False))
    size, texts = documents.agg(F.sum(F.octet_length(text)), F.count_if(trained)).first()
    shards = max(16, math.ceil((size or 0) / SHARD_BYTES))
    blocks = _blocks(documents, doc_id, text, trained, shards)
    words = blocks.where(F.col("shard").isNotNull()).select("block", "shard", "a", "b", "c", "d")
    return blocks, staged(words.groupBy("shard").applyInArrow(_sum_shard, SUMMED), "word-sums"), texts


def lm_scores(documents: DataFrame, trained: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every text.

    Texts for which ``trained`` holds are learned from. ``base_score`` is the log10
    probability under add-one counts of single tokens, ``score`` that of the mixing
    model. A null or empty text is its end mark alone. Repeated rows give equal rows.
    """
    spark = documents.sparkSession
    blocks, summed, texts = word_sums(documents, trained, doc_id, text)

    known = summed.where("kind = 'words'")
    tokens, distinct = known.select(
        "n", "c").mapInArrow(_totals, "tokens long, distinct long").agg(F.sum("tokens"), F.sum("distinct")).first()
    tokens, distinct = (tokens or 0) + texts, (distinct or 0) + (texts > 0)

    held = spark.sparkContext.broadcast([t.tobytes() for t in context_tables(summed, texts)])
    name = f"mixer:{uuid.uuid4().hex}"

    def mixer(weights=None) -> Mixer:
        return Mixer(per_worker(name, lambda: [np.frombuffer(t, dtype=np.uint16) for t in held.value]), weights)

    weights = first_weights(summed, texts, mixer)

    def score(batch):
        model = mixer(weights)
        column = batch.column(text)
        found = [model.score(column.slice(at, to - at)) for at, to in row_slices(column, 2 << 20)]
        return [pa.array(np.concatenate(found) if found else [], pa.float64())]

    scored = attach(
        documents.select(F.col(doc_id), F.col(text), F.xxhash64(F.col(text)).alias("_key")),
        [StructField("score", DoubleType())], score)
    scored = scored.select(
        F.col(doc_id).alias("_id"), "_key", "score",
        (-F.col("score") * math.log2(10) / F.greatest(F.lit(1), F.coalesce(F.octet_length(text), F.lit(0)))).alias("bits_per_byte"))
    base = _base_scores(blocks, summed.where("kind = 'counts'"), doc_id, (tokens, distinct, texts)).dropDuplicates(["_id", "_key"])
    joined = join_on(scored, base, ["_id", "_key"], "inner")
    return joined.select(
        F.col("_id").alias(doc_id), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score",
        "score", "bits_per_byte")


def _totals(batches):
    tokens = distinct = 0
    for batch in batches:
        distinct += sum(batch.column("n").to_pylist())
        tokens += sum(int(np.frombuffer(c, dtype="<i8").sum()) for c in batch.column("c").to_pylist())
    yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([distinct], pa.int64())], names=["tokens", "distinct"])


