"""Byte-level tokenizing of Arrow text columns through a public vocabulary file.

Texts are cut into pre-tokens on the byte buffer, and each distinct pre-token is
tokenized once per worker by the ``tokenizers`` library; all repeats are array
look-ups. A file with another pre-tokenizer or a normaliser is left wholly to
the library. Both ways give the library's ids.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from laplake.llm.text import flat_bytes, give_back, per_worker, row_slices, span_hashes

DEFAULT_FILE = "byte_bpe_50k.json"
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
CACHE_WORDS = 3_000_000  # distinct pre-tokens a worker remembers before it starts anew


def vocabulary_path(path: str | None = None) -> str:
    """The vocabulary file: ``path``, or the installed default."""
    if path is not None:
        return path
    import public_tokenizers
    return public_tokenizers.path(DEFAULT_FILE)


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte.

    Printable Latin-1 characters stand for themselves; the other bytes take the
    characters from code point 256 on, in order.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def _code_classes() -> np.ndarray:
    """Letter, number, space or other, for every code point."""
    import regex

    classes = np.zeros(0x110000, dtype=np.uint8)
    for first in range(0, 0x110000, 0x800):
        if 0xD800 <= first < 0xE000:  # halves of pairs are no characters
            continue
        text = "".join(map(chr, range(first, first + 0x800)))
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
            for found in regex.finditer(pattern, text):
                s, e = found.span()
                classes[first + s:first + e] = kind
    return classes


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of the character that each byte belongs to."""
    classes = per_worker("code_classes", _code_classes)
    ascii_part = np.zeros(256, dtype=np.uint8)
    ascii_part[:128] = classes[:128]
    out = ascii_part[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int32)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        code = np.where(size == 2, first & 31, np.where(size == 3, first & 15, first & 7))
        for k in (1, 2, 3):
            more = np.flatnonzero(size > k)
            code[more] = (code[more] << 6) | (data[lead[more] + k] & 63)
        kind = classes[code]
        out[lead] = kind
        for k in (1, 2, 3):
            more = np.flatnonzero(size > k)
            out[lead[more] + k] = kind[more]
    return out


def pretoken_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pre-tokens start: runs of one class with one space before them,
    English contractions apart, and blanks ahead of the last one together."""
    n = len(data)
    kind = byte_classes(data)
    start = np.empty(n, dtype=bool)
    start[:1] = True
    start[1:] = kind[1:] != kind[:-1]
    text_starts = bounds[:-1][np.diff(bounds) > 0]
    start[text_starts] = True
    opens = np.zeros(n, dtype=bool)
    opens[text_starts] = True
    # The last blank before a word stands alone, or joins the word if it is a space.
    after = np.flatnonzero(start & (kind != SPACE) & ~opens)
    after = after[kind[after - 1] == SPACE]
    blank = after - 1
    wide = np.flatnonzero(data[blank] >= 0x80)
    blank[wide] -= np.where((data[blank[wide] - 1] & 0xC0) == 0xC0, 1, 2)
    start[blank] = True
    start[after[data[after - 1] == 0x20]] = False
    quotes = np.flatnonzero((data == 0x27) & start)
    if len(quotes):
        end = bounds[np.searchsorted(bounds, quotes, side="right")]
        ahead = np.concatenate([data, np.zeros(3, dtype=np.uint8)])
        one, two = ahead[quotes + 1], ahead[quotes + 2]
        short = np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8)) & (quotes + 1 < end)
        long = ((one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e"))
                | (one == ord("l")) & (two == ord("l"))) & (quotes + 2 < end)
        start[quotes[short | long] + 1] = False
        behind = np.concatenate([quotes[short] + 2, quotes[long] + 3])
        limit = np.concatenate([end[short], end[long]])
        start[behind[behind < limit]] = True
    return np.flatnonzero(start)


class WordTable:
    """What is known of each distinct pre-token: a run of values in one pool."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.keys = np.zeros(0, dtype=np.uint64)
        self.at = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.searchsorted(self.keys, keys)
        held = place < len(self.keys)
        held[held] = self.keys[place[held]] == keys[held]
        return place, held

    def add(self, keys: np.ndarray, values: list[list[int]]) -> None:
        size = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
        at = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate([self.pool, np.array([v for run in values for v in run], dtype=np.int32)])
        order = np.argsort(keys)
        keys, at, size = keys[order], at[order], size[order]
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = (
            np.insert(old, place, new) for old, new in ((self.keys, keys), (self.at, at), (self.size, size)))


class ByteTokenizer:
    """Values per pre-token (ids, or whatever ``word_values`` gives) for whole columns."""

    def __init__(self, path: str, word_values=None):
        from tokenizers import Tokenizer

        self.library, self.path = Tokenizer.from_file(path), path
        spec = self._read()
        cut = spec.get("pre_tokenizer") or {}
        self.plain = (
            cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
            and spec.get("normalizer") is None and spec["model"].get("type") == "BPE")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.held = spec if word_values else None  # tens of megabytes
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.table = WordTable()
        self.word_values = word_values or self._ids

    def _read(self) -> dict:
        with open(self.path, encoding="utf-8") as file:
            return json.load(file)

    @property
    def spec(self) -> dict:
        """What the file says; read again if it is not held for ``word_values``."""
        return self._read() if self.held is None else self.held

    def _ids(self, word: bytes) -> list[int]:
        tokens = self.library.model.tokenize(word.decode("latin-1").translate(self.letters))
        return [t.id for t in tokens]

    def encode_text(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _words(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Row of the word table for each pre-token."""
        ends = np.append(starts[1:], len(data))
        distinct = pa.array(span_hashes(data, starts, ends)).dictionary_encode()
        codes, keys = distinct.indices.to_numpy(), distinct.dictionary.to_numpy()
        if len(self.table.keys) + len(keys) > CACHE_WORDS:
            self.table.clear()
        place, held = self.table.find(keys)
        if not held.all():
            first = np.empty(len(keys), dtype=np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            fresh = np.flatnonzero(~held)
            raw = data.tobytes()
            self.table.add(keys[fresh], [
                self.word_values(raw[s:e])
                for s, e in zip(starts[first[fresh]].tolist(), ends[first[fresh]].tolist(), strict=True)])
            place, _ = self.table.find(keys)
        return place[codes]

    def column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Values of all texts in a row, and each text's bounds in them."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column, "")
        if not self.plain:
            return self._by_library(column.to_pylist())
        odd = np.zeros(len(column), dtype=bool)
        for text in self.special:
            odd |= pc.match_substring(column, text).to_numpy(zero_copy_only=False)
        if odd.any():
            return self._with_special(column, odd)
        data, bounds = flat_bytes(column)
        starts = pretoken_starts(data, bounds)
        row = self._words(data, starts)
        size, at = self.table.size[row], self.table.at[row]
        total = np.zeros(len(row) + 1, dtype=np.int64)
        np.cumsum(size, out=total[1:])
        values = self.table.pool[np.arange(total[-1]) + np.repeat(at - total[:-1], size)]
        return values, total[np.searchsorted(starts, bounds)]

    def _by_library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        runs = [self.encode_text(t) for t in texts]
        bounds = np.zeros(len(runs) + 1, dtype=np.int64)
        np.cumsum([len(r) for r in runs], out=bounds[1:])
        return np.array([v for r in runs for v in r], dtype=np.int32), bounds

    def _with_special(self, column: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts with a special string go to the library, the others their usual way."""
        usual, part = self.column(column.filter(pa.array(~odd)))
        rare, cut = self._by_library(column.filter(pa.array(odd)).to_pylist())
        size = np.zeros(len(column), dtype=np.int64)
        size[~odd], size[odd] = np.diff(part), np.diff(cut)
        bounds = np.zeros(len(column) + 1, dtype=np.int64)
        np.cumsum(size, out=bounds[1:])
        values = np.empty(bounds[-1], dtype=np.int32)
        of_odd = np.repeat(odd, size)
        values[of_odd], values[~of_odd] = rare, usual
        return values, bounds


def tokenizer(path: str | None) -> ByteTokenizer:
    """The worker's tokenizer for this file."""
    where = vocabulary_path(path)
    return per_worker(f"tokenizer:{where}", lambda: ByteTokenizer(where))


def token_slices(batches, text: str, path: str | None):
    """For each few megabytes of texts: the rows, their ids in a row, and bounds."""
    for batch in batches:
        column = batch.column(text)
        for at, to in row_slices(column):
            part = batch.slice(at, to - at)
            ids, bounds = tokenizer(path).column(part.column(text))
            yield part, ids, bounds
        give_back()


def append_id(ids: np.ndarray, bounds: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with the id ``last`` behind each."""
    n = len(bounds) - 1
    moved = bounds + np.arange(n + 1)
    out = np.empty(moved[-1], dtype=np.int32)
    ends = moved[1:] - 1
    mask = np.ones(len(out), dtype=bool)
    mask[ends] = False
    out[mask], out[ends] = ids, last
    return out, moved
