"""Benchmark decontamination.

The windows of the benchmark's normalised words form a hash set that every
worker holds. Documents are scanned window by window on the flat byte buffer;
a hash that is in the set is verified on the words themselves. What was found
comes back as word and character ranges, so callers can cut the spans or drop
the documents.

The set is broadcast in parts of at most ``part_bytes`` of window text. A larger
benchmark takes more passes over the documents, with the same result.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from laplake.llm.frames import attach, staged
from laplake.llm.text import (
    alnum_class,
    flat_bytes,
    lowered,
    per_worker,
    row_slices,
    span_hashes,
    window_hashes,
    word_bounds,
)

WINDOW = 10
PART_BYTES = 16 << 20

RANGE = StructType([StructField(n, LongType()) for n in ("first", "past", "begin", "end")])
FOUND = StructField("contamination", StructType([
    StructField("n_words", LongType()),
    StructField("n_hit", LongType()),
    StructField("items", ArrayType(StringType())),
    StructField("ranges", ArrayType(RANGE)),
]))
ARROW_FOUND = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("ranges", pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "past", "begin", "end")])))])


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text",
                      window: int = WINDOW) -> DataFrame:
    """Every distinct window of the items: (window, size, items).

    A window is ``window`` consecutive words, joined by blanks. An item of fewer
    words is one shorter window; an item without words, or of null text, is none.
    Items without an id still give windows, but no name.
    """

    def cut(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, bounds = flat_bytes(batch.column(1))
            data = lowered(data)
            starts, ends, owner = word_bounds(data, bounds, alnum_class())
            raw = data.tobytes()
            words = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            cuts = np.searchsorted(owner, np.arange(len(ids) + 1))
            out = []
            for i, name in enumerate(ids):
                mine = words[cuts[i]:cuts[i + 1]]
                size = min(window, len(mine))
                for k in range(len(mine) - size + 1 if size else 0):
                    out.append((name, b" ".join(mine[k:k + size]).decode(), size))
            names, texts, sizes = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int32())],
                names=["item", "window", "size"])

    schema = StructType([
        StructField("item", StringType()), StructField("window", StringType()), StructField("size", IntegerType())])
    rows = benchmark.select(F.col(item_id).cast("string"), F.col(text)).mapInArrow(cut, schema)
    return rows.groupBy("window", "size").agg(F.collect_set("item").alias("items"))


class WindowSet:
    """Hashes of the windows, by size, with the words and items behind each."""

    BITS = 22

    def __init__(self, rows: list[tuple[str, int, list[str]]]):
        self.items = {w.encode(): items for w, _, items in rows}
        self.keys: dict[int, np.ndarray] = {}
        self.maybe: dict[int, np.ndarray] = {}
        for size in sorted({size for _, size, _ in rows}):
            data, bounds = flat_bytes(pa.array([w for w, s, _ in rows if s == size], pa.string()))
            starts, ends, _ = word_bounds(data, bounds, alnum_class())
            hashes = window_hashes(span_hashes(data, starts, ends), size)[::size]
            self.keys[size] = np.unique(hashes)
            self.maybe[size] = np.zeros(1 << self.BITS, dtype=bool)
            self.maybe[size][hashes >> np.uint64(64 - self.BITS)] = True
        self.blank = bytes(b if inside else 0x20 for b, inside in enumerate(alnum_class().tolist()))

    def hits(self, data, starts, ends, owner) -> list[tuple[int, int, bytes]]:
        """(first word, number of words, window) of every verified occurrence."""
        found = []
        words = span_hashes(data, starts, ends)
        for size, keys in self.keys.items():
            hashes = window_hashes(words, size)
            if not len(hashes):
                continue
            near = np.flatnonzero(self.maybe[size][hashes >> np.uint64(64 - self.BITS)])
            near = near[owner[near] == owner[near + size - 1]]
            place = np.searchsorted(keys, hashes[near])
            place[place == len(keys)] = 0
            near = near[keys[place] == hashes[near]]
            for at in near.tolist():
                raw = data[starts[at]:ends[at + size - 1]].tobytes()
                window = b" ".join(raw.translate(self.blank).split())
                if window in self.items:
                    found.append((at, size, window))
        return found


def _merge(ranges: list[tuple[int, int, int, int]]) -> list[dict]:
    out: list[dict] = []
    for first, past, begin, end in sorted(ranges):
        if out and first <= out[-1]["past"]:
            if past > out[-1]["past"]:
                out[-1]["past"], out[-1]["end"] = past, end
        else:
            out.append({"first": first, "past": past, "begin": begin, "end": end})
    return out


def _scan_column(column: pa.Array, windows: WindowSet, earlier: list | None) -> list[dict]:
    rows: list[dict] = []
    inside = alnum_class()
    for at, to in row_slices(column):
        data, bounds = flat_bytes(column.slice(at, to - at))
        data = lowered(data)
        starts, ends, owner = word_bounds(data, bounds, inside)
        first = np.searchsorted(owner, np.arange(to - at + 1))
        found: dict[int, tuple[list, set]] = {}
        for word, size, window in windows.hits(data, starts, ends, owner):
            ranges, items = found.setdefault(int(owner[word]), ([], set()))
            ranges.append((word, word + size, int(starts[word]), int(ends[word + size - 1])))
            items.update(windows.items[window])
        for i, n in enumerate(np.diff(first).tolist()):
            ranges, items = found.get(i, ((), ()))
            if ranges:
                text = data[bounds[i]:bounds[i + 1]]
                chars = np.zeros(len(text) + 1, dtype=np.int64)
                np.cumsum((text & 0xC0) != 0x80, out=chars[1:])
                base, word0 = int(bounds[i]), int(first[i])
                ranges = [(f - word0, p - word0, int(chars[b - base]), int(chars[e - base])) for f, p, b, e in ranges]
            if earlier is not None and (old := earlier[at + i]) is not None:
                ranges = [*ranges, *(tuple(r.values()) for r in old["ranges"])]
                items = {*items, *old["items"]}
            merged = _merge(list(ranges))
            rows.append({
                "n_words": n, "n_hit": sum(r["past"] - r["first"] for r in merged),
                "items": sorted(items), "ranges": merged})
    return rows


def find_contamination(documents: DataFrame, benchmark: DataFrame, text: str = "text",
                       item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                       part_bytes: int = PART_BYTES) -> DataFrame:
    """Documents with a column ``contamination``: n_words, n_hit, items, ranges.

    ``ranges`` holds the maximal runs of hit words: word numbers [first, past) and
    character offsets [begin, end). Null and empty texts have no words and no hits.
    Repeated rows are scanned each for itself. An empty benchmark hits nothing.
    """
    spark = documents.sparkSession
    windows = staged(benchmark_windows(benchmark, item_id, item_text, window), "windows")
    size = windows.agg(F.sum(F.length("window") + 8 * F.size("items") + 32)).first()[0] or 0
    parts = max(1, math.ceil(size / part_bytes))
    found = documents
    for part in range(parts):
        mine = windows if parts == 1 else windows.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == part)
        held = spark.sparkContext.broadcast(
            [(r["window"], r["size"], r["items"]) for r in mine.select("window", "size", "items").toLocalIterator()])
        name, again = f"windows:{uuid.uuid4().hex}", part > 0

        def scan(batch, held=held, name=name, again=again):
            known = per_worker(name, lambda: WindowSet(held.value))
            earlier = batch.column(FOUND.name).to_pylist() if again else None
            return [pa.array(_scan_column(batch.column(text), known, earlier), ARROW_FOUND)]

        found = attach(found, [FOUND], scan)
        if part + 1 < parts:
            found = staged(found, "scan")
    return found


def cut_spans(found: DataFrame, text: str = "text", least: int = 1) -> DataFrame:
    """Texts without their hit spans, where at least ``least`` words were hit; all rows stay."""
    ranges = F.col("contamination.ranges")
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(ranges, lambda r: r["end"]))
    ends = F.concat(F.transform(ranges, lambda r: r["begin"]), F.array(F.length(text).cast("long")))
    pieces = F.transform(
        F.arrays_zip(begins.alias("b"), ends.alias("e")),
        lambda p: F.substring(F.col(text), p["b"].cast("int") + 1, (p["e"] - p["b"]).cast("int")))
    return found.withColumn(text, F.when(
        F.col("contamination.n_hit") >= least, F.concat_ws("", pieces)).otherwise(F.col(text)))


def drop_contaminated(found: DataFrame, share: float = 0.0) -> DataFrame:
    """Rows of which at most ``share`` of the words were hit."""
    c = F.col("contamination")
    return found.where(c["n_hit"] <= share * c["n_words"])
