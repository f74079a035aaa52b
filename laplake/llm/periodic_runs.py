"""Maximal periodic runs of words, by recompression.

The words of a few documents, with a separator of its own between any two, are
compressed level by level: blocks of one symbol, then pairs of a left and a right
symbol, in turn. Every level keeps which symbols became which, so all levels
together are a run-length grammar of the sequence. What a symbol is merged with
depends on its neighbours alone, so equal stretches are parsed alike but for their
ends, and a longest common extension of two places takes a few comparisons per
level: up while both stand at the start of a symbol, down once symbols differ.

Candidates come from harmonic grids. A run of period p and exponent e holds e
multiples of p, all with the same word, so for each p only places at its multiples
are looked at, and only where e in a row agree. The extensions of such a place
and its neighbour, forward and backward, give the run exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from laplake.llm.frames import attach
from laplake.llm.text import blank_class, flat_bytes, mix, row_slices, word_bounds

EXPONENT, LENGTH = 4, 6
GRID = 1 << 19  # grid places looked at together
SALTS = 3  # partitions of the symbols tried for each pair step
STEPS = 400  # a guard only: what is left uncompressed is compared symbol by symbol
RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
ARROW_RUN = pa.list_(pa.struct([(c, pa.int64()) for c in RUN.names]))


class Level:
    """Symbols of one level, the words each stands for, and what they are merged into above."""

    def __init__(self, symbols: np.ndarray, words: np.ndarray):
        self.symbols, self.words = symbols, words
        self.block = False
        self.first = self.parent = self.opens = None

    def merge(self, first: np.ndarray, block: bool) -> None:
        """Symbols from ``first[i]`` up to the next one become the symbol ``i`` above."""
        n = len(self.symbols)
        self.block, self.first = block, np.append(first, n)
        self.opens = np.zeros(n, dtype=bool)
        self.opens[first] = True
        self.parent = np.cumsum(self.opens) - 1

    def mirrored(self) -> Level:
        """The same level read from its end."""
        out = Level(self.symbols[::-1], self.words[::-1])
        if self.first is not None:
            out.merge((len(self.symbols) - self.first[1:])[::-1], self.block)
        return out

    def run_left(self, at: np.ndarray) -> np.ndarray:
        """Symbols from a place to the end of its block."""
        return self.first[self.parent[at] + 1] - at


def _named(left: np.ndarray, right: np.ndarray, free: int) -> tuple[np.ndarray, int]:
    """A new symbol for each distinct pair of numbers, and the next free one."""
    keys, names = np.unique((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64), return_inverse=True)
    return names + free, free + len(keys)


def _block_step(level: Level, free: int) -> tuple[np.ndarray, np.ndarray, int]:
    s = level.symbols
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    size = np.diff(np.append(first, len(s)))
    above = s[first]
    long = np.flatnonzero(size > 1)
    above[long], free = _named(above[long], size[long], free)
    return first, above, free


def _pair_step(level: Level, free: int, separators: int, step: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Merge symbols of the left part with symbols of the right part behind them.

    Of a few partitions, each in both directions, the one with most pairs is taken.
    The first ``separators`` symbols are in neither part.
    """
    s = level.symbols
    real = s >= separators
    both = real[:-1] & real[1:]
    best, pairs = -1, None
    for salt in range(SALTS):
        seed = np.uint64((step * SALTS + salt + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        side = (mix(s.astype(np.uint64) + seed) & np.uint64(1)).astype(bool)
        for left in (side, ~side):
            found = left[:-1] & ~left[1:] & both
            n = int(np.count_nonzero(found))
            if n > best:
                best, pairs = n, found
    heads = np.flatnonzero(pairs)
    opens = np.ones(len(s), dtype=bool)
    opens[heads + 1] = False
    first = np.flatnonzero(opens)
    above = s[first]
    named, free = _named(s[heads], s[heads + 1], free)
    above[np.searchsorted(first, heads)] = named
    return first, above, free


def grammar(symbols: np.ndarray, separators: int) -> list[Level]:
    """Levels from the words to one symbol per text.

    Symbols below ``separators`` stand once each, first and last among them.
    """
    levels = [Level(symbols.astype(np.int64), np.ones(len(symbols), dtype=np.int64))]
    free = int(symbols.max()) + 1
    for step in range(STEPS):
        level = levels[-1]
        if len(level.symbols) <= 2 * separators - 1 and not np.any(
                (level.symbols[1:] >= separators) & (level.symbols[:-1] >= separators)):
            break
        block = step % 2 == 0
        first, above, free = _block_step(level, free) if block else _pair_step(level, free, separators, step)
        level.merge(first, block)
        levels.append(Level(above, np.add.reduceat(level.words, first)))
    return levels


def extensions(levels: list[Level], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each pair of different places, how many words from there on are equal."""
    x, y = x.copy(), y.copy()
    equal = np.zeros(len(x), dtype=np.int64)
    stuck = np.zeros(len(x), dtype=np.int64)  # the level where symbols differ

    def step(level: Level, at: np.ndarray) -> None:
        n = np.minimum(level.run_left(x[at]), level.run_left(y[at])) if level.block else 1
        equal[at] += n * level.words[x[at]]
        x[at] += n
        y[at] += n

    def matched(level: Level, at: np.ndarray) -> np.ndarray:
        return level.symbols[x[at]] == level.symbols[y[at]]

    up = np.arange(len(x))
    for number, level in enumerate(levels):
        todo, rising = up, []
        while len(todo):
            same = matched(level, todo)
            stuck[todo[~same]] = number
            todo = todo[same]
            if level.parent is not None:
                both = level.opens[x[todo]] & level.opens[y[todo]]
                rising.append(todo[both])
                todo = todo[~both]
            step(level, todo)
        if not rising:
            break
        up = np.concatenate(rising)
        x[up], y[up] = level.parent[x[up]], level.parent[y[up]]
    for number in range(len(levels) - 1, 0, -1):
        below = levels[number - 1]
        todo = np.flatnonzero(stuck >= number)
        x[todo], y[todo] = below.first[x[todo]], below.first[y[todo]]
        while len(todo):
            todo = todo[matched(below, todo)]
            step(below, todo)
    return equal


def grid_places(words: np.ndarray, cuts: np.ndarray, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, period) where ``exponent`` multiples of the period in a row hold the same word."""
    sizes = np.diff(cuts)
    periods = sizes // exponent
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    number = (sizes[text] - 1) // period - (exponent - 2)
    total = np.cumsum(number)
    at = 0
    while at < len(text):
        before = int(total[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + GRID, side="right")))
        own = np.repeat(np.arange(at, to), number[at:to])
        p = period[own]
        place = cuts[text[own]] + (np.arange(len(own)) - np.repeat(total[at:to] - number[at:to] - before, number[at:to])) * p
        for k in range(1, exponent):
            good = words[place] == words[place + k * p]
            own, p, place = own[good], p[good], place[good]
        yield text[own], place, p
        at = to


def find_runs(words: np.ndarray, cuts: np.ndarray, exponent: int = EXPONENT, length: int = LENGTH):
    """(text, start, length, period) of all runs, in that order; ``cuts`` bounds the texts in ``words``."""
    text, place, period = (np.concatenate(parts) for parts in zip(
        *grid_places(words, cuts, exponent), [np.zeros(0, dtype=np.int64)] * 3, strict=False)) \
        if len(words) else [np.zeros(0, dtype=np.int64)] * 3
    if not len(text):
        return [np.zeros(0, dtype=np.int64)] * 4
    # Only texts with a candidate enter the grammar, each between two separators.
    mine = np.unique(text)
    sizes = np.diff(cuts)[mine]
    begin = np.cumsum(sizes + 1) - sizes
    joined = np.empty(int(sizes.sum()) + len(mine) + 1, dtype=np.int64)
    joined[np.append(begin - 1, len(joined) - 1)] = np.arange(len(mine) + 1)
    moved = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    joined[np.repeat(begin, sizes) + moved] = words[np.repeat(cuts[mine], sizes) + moved] + len(mine) + 1
    levels = grammar(joined, len(mine) + 1)
    mirror = [level.mirrored() for level in levels]
    own = np.searchsorted(mine, text)
    out = []
    for at in range(0, len(text), GRID):
        i = begin[own[at:at + GRID]] + place[at:at + GRID] - cuts[text[at:at + GRID]]
        p = period[at:at + GRID]
        ahead = extensions(levels, i, i + p)
        behind = extensions(mirror, len(joined) - i, len(joined) - i - p)
        size = ahead + behind + p
        good = size >= np.maximum(length, exponent * p)
        rows = np.stack([text[at:at + GRID], i - behind - begin[own[at:at + GRID]], size, p])[:, good]
        out.append(np.unique(rows, axis=1))
    found = np.unique(np.concatenate(out, axis=1), axis=1)
    # One stretch has one smallest period; its multiples were found as well.
    keep = np.ones(found.shape[1], dtype=bool)
    keep[1:] = (found[:3, 1:] != found[:3, :-1]).any(axis=0)
    return list(found[:, keep])


def _word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """A number for each word, the same for equal bytes only."""
    bounds = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    letters = pa.py_buffer(np.ascontiguousarray(data[inside[data]]))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), letters])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The kept words of each text, one space between them."""
    which = np.flatnonzero(kept)
    sizes = ends[which] - starts[which] + 1
    to = np.cumsum(sizes)
    place = np.arange(int(to[-1]) if len(to) else 0) + np.repeat(starts[which] - (to - sizes), sizes)
    out = np.append(data, np.uint8(0x20))[place]
    out[to - 1] = 0x20
    past = np.append(0, to)[np.searchsorted(which, cuts)]
    texts = [out[a:max(a, b - 1)].tobytes() for a, b in zip(past[:-1].tolist(), past[1:].tolist(), strict=True)]
    return pa.array(texts, pa.binary()).cast(pa.string())


def periodic_runs(documents: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed",
                  exponent: int = EXPONENT, length: int = LENGTH) -> DataFrame:
    """Documents with their runs and the text without repeats.

    ``runs`` holds (start, length, period) in words of every stretch that repeats with its
    smallest period at least ``exponent`` times, is at least ``length`` words long and cannot be
    extended; in order of start and period. ``collapsed`` has the words that lie in no run, or
    only among the first words of runs, up to one period, with one space between them.
    Words are runs without blanks, compared byte by byte. Null and empty texts have no runs and
    an empty collapsed text. Repeated rows are treated each for itself. Further columns stay; one
    with the name of a new column is replaced.
    """
    if exponent < 2:
        raise ValueError("a run repeats at least twice")

    def compute(batch):
        column = batch.column(text)
        inside = blank_class()
        lists, texts = [], []
        for at, to in row_slices(column):
            data, bounds = flat_bytes(column.slice(at, to - at))
            starts, ends, owner = word_bounds(data, bounds, inside)
            cuts = np.searchsorted(owner, np.arange(to - at + 1))
            found = find_runs(_word_numbers(data, starts, ends, inside), cuts, exponent, length)
            own, start, size, period = found
            change = np.zeros(len(starts) + 1, dtype=np.int64)
            np.add.at(change, cuts[own] + start + period, 1)
            np.add.at(change, cuts[own] + start + size, -1)
            texts.append(_joined_words(data, starts, ends, np.cumsum(change)[:-1] == 0, cuts))
            offsets = np.searchsorted(own, np.arange(to - at + 1)).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
                [pa.array(v, pa.int64()) for v in (start, size, period)], names=RUN.names)))
        return [pa.concat_arrays(lists).cast(ARROW_RUN) if lists else pa.array([], ARROW_RUN),
                pa.concat_arrays(texts) if texts else pa.array([], pa.string())]

    return attach(documents, [StructField(runs, ArrayType(RUN)), StructField(collapsed, StringType())], compute)
