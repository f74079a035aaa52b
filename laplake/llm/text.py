"""Texts of an Arrow batch as one flat byte buffer, cut into words and hashed.

Everything works on whole buffers, so a batch of documents costs a fixed number
of numpy passes however many words it holds. A word's 64-bit hash depends on its
bytes alone: equal words hash alike in every document, task and run.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPAN = 1 << 20  # bytes hashed at a time
ROOT = 0x9E3779B97F4A7C17  # odd, so it has an inverse modulo 2**64


def per_worker(name: str, make: Callable):
    """A value made once per Python worker and kept from task to task.

    Of names ``kind:which`` a worker keeps the last one of each kind.
    """
    held = vars(sys.modules.setdefault("_laplake_worker", types.ModuleType("_laplake_worker")))
    if name not in held:
        kind, colon, _ = name.partition(":")
        for old in [k for k in held if colon and k.startswith(f"{kind}:")]:
            del held[old]
        held[name] = make()
    return held[name]


def give_back() -> None:
    """Return freed memory to the system, so that idle workers of an executor hold little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def flat_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and the bounds of each; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    base = int(bounds[0])
    return np.frombuffer(data, dtype=np.uint8)[base:int(bounds[-1])], bounds - base


def row_slices(column, size: int = 1 << 20, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of text and at most ``rows`` rows, so that working arrays stay small."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        before = int(total[at - 1]) if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(total, before + size, side="right"))))
        yield at, to
        at = to


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def word_class(separators: Callable[[int], bool]) -> np.ndarray:
    """Which bytes belong to words; all of UTF-8 beyond ASCII does."""
    return np.array([not separators(b) for b in range(256)])


def blank_class() -> np.ndarray:
    """Words are runs without space, tab, line feed, vertical tab, form feed, carriage return."""
    return word_class(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)


def alnum_class() -> np.ndarray:
    """Words are runs of digits, a-z, and bytes beyond ASCII; capitals are lowered before."""
    return word_class(lambda b: b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F)


def word_bounds(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray):
    """Start, end and text number of every word; no word crosses two texts."""
    mask = inside[data]
    if not mask.any():
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    first[edges] = mask[edges]
    last[edges - 1] = mask[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    per_text = np.diff(np.searchsorted(starts, bounds))
    return starts, ends, np.repeat(np.arange(len(bounds) - 1), per_text)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def make(size: int):
        up = np.full(size, ROOT, dtype=np.uint64)
        down = np.full(size, pow(ROOT, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)

    letters = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    up, down = per_worker("powers", lambda: make(SPAN + 1)) if n <= SPAN + 1 else make(n)
    return up, down, letters


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; spans are in order and don't overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        begin = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, begin + SPAN, side="right")))
        s, e = starts[at:to] - begin, ends[at:to] - begin
        size = int(e[-1])
        up, down, letters = _powers(size + 1)
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(letters[data[begin:begin + size]] * up[:size], out=sums[1:])
        out[at:to] = (sums[e] - sums[s]) * down[s]
        at = to
    return mix(out)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words; text borders are the caller's."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    factors = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out += words[k:k + n] * factors[k]
    return mix(out)
