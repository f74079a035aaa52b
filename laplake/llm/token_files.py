"""Token ids in compact files.

Documents are ranged by id and tokenized once into a table of blocks. Global
counts give a canonical Huffman code of limited length; its lengths are the
whole code book. Each block is coded for itself, with the bit offset of every
256th id, so all of these stretches are decoded side by side through one
look-up table, and any part of a file can be read alone.

A folder holds two Parquet tables: ``codebook`` (id, length) and ``blocks``
(segment, block, first_id, doc_ids, doc_tokens, offsets, bits). Segments and
blocks follow the order of document ids.
"""

from __future__ import annotations

import uuid
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    IntegerType,
    LongType,
    StructField,
    StructType,
)

from laplake.llm.frames import binary_array, staged
from laplake.llm.text import per_worker
from laplake.llm.tokens import append_id, token_slices

LONGEST = 16  # bits of a code at most; more only if the vocabulary needs it
STRETCH = 256  # ids between two noted bit offsets


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``longest`` bits, by package merging.

    Ids that never occur get length 0. With one id in use, its code is one bit.
    """
    used = np.flatnonzero(counts)
    n = len(used)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if n < 2:
        lengths[used] = 1
        return lengths
    longest = max(longest, int(n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    rows, leaves = weights, [np.ones(n, dtype=bool)]
    for _ in range(longest - 1):
        pairs = rows[:len(rows) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        rank = np.argsort(both, kind="stable")
        rows = both[rank]
        leaves.append(rank < n)
    take = 2 * n - 2
    for leaf in reversed(leaves):
        mine = int(leaf[:take].sum())
        lengths[order[:mine]] += 1
        take = 2 * (take - mine)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), counted upwards."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, bits = 0, 0
    for at in np.unique(lengths[order]).tolist():
        mine = order[lengths[order] == at]
        code <<= at - bits
        codes[mine] = code + np.arange(len(mine), dtype=np.uint64)
        code += len(mine)
        bits = at
    return codes


class CodeBook:
    """Codes, and the table that maps the next bits to an id and its length."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.codes = canonical_codes(lengths)
        self.width = max(1, int(lengths.max(initial=1)))
        # Ids in canonical order fill the table from its start, each by its share.
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        share = np.left_shift(1, self.width - self.lengths[order])
        entry = (order.astype(np.int64) << 6) | self.lengths[order]
        self.table = np.zeros(1 << self.width, dtype=np.int64)
        filled = np.repeat(entry, share)
        self.table[:len(filled)] = filled

    def encode(self, ids: np.ndarray, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
        """Big-endian 32-bit words of the code, and the bit offset of every ``stretch``-th id."""
        size = self.lengths[ids]
        at = np.cumsum(size) - size
        total = int(at[-1] + size[-1]) if len(ids) else 0
        word = at >> 5
        shifted = self.codes[ids] << (64 - size - (at & 31)).astype(np.uint64)
        words = np.zeros((total >> 5) + 3, dtype=np.uint32)
        if len(ids):
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            joined = np.bitwise_or.reduceat(shifted, heads)
            own = word[heads]
            words[own] |= (joined >> np.uint64(32)).astype(np.uint32)
            words[own + 1] |= (joined & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return words.astype(">u4"), at[::stretch].astype("<u4") if total < 1 << 32 else at[::stretch].astype("<u8")

    def decode(self, words: np.ndarray, offsets: np.ndarray, n: int, stretch: int = STRETCH) -> np.ndarray:
        """The ids: every stretch takes one id per step, all stretches together."""
        if not n:
            return np.zeros(0, dtype=np.uint32)
        words = words.astype(np.uint32)
        pairs = (words[:-1].astype(np.uint64) << np.uint64(32)) | words[1:]
        rows = len(offsets)
        out = np.empty((stretch, rows), dtype=np.uint32)
        down = np.uint64(64 - self.width)
        at = offsets.astype(np.uint64)
        last = n - (rows - 1) * stretch
        end = np.uint64(32 * (len(words) - 2))
        for step in range(stretch):
            if step == last and rows > 1:
                at = at[:-1]
            elif step == last:
                break
            window = (pairs[at >> np.uint64(5)] << (at & np.uint64(31))) >> down
            entry = self.table[window]
            out[step, :len(at)] = entry >> 6
            at = np.minimum(at + (entry & 63).astype(np.uint64), end)
        return out.T.reshape(-1)[:n]


def _blocks(documents: DataFrame, doc_id: str, text: str, end_id: int, path: str | None) -> DataFrame:
    """Documents in order of id, tokenized: one row per few megabytes of text."""
    kind = documents.schema[doc_id].dataType
    schema = StructType([
        StructField("segment", IntegerType()), StructField("block", IntegerType()), StructField("before", LongType()),
        StructField("doc_ids", ArrayType(kind)), StructField("doc_tokens", ArrayType(LongType())),
        StructField("ids", BinaryType())])

    def run(batches):
        segment, before = TaskContext.get().partitionId(), 0
        for block, (part, ids, bounds) in enumerate(token_slices(batches, text, path)):
            ids, bounds = append_id(ids, bounds, end_id)
            narrow = "<u2" if ids.max() < 1 << 16 else "<u4"
            names = part.column(doc_id)
            one = pa.array([0, len(names)], pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array([segment], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()),
                pa.ListArray.from_arrays(one, names),
                pa.ListArray.from_arrays(one, pa.array(np.diff(bounds), pa.int64())),
                binary_array(ids.astype(narrow), [len(ids)])], names=schema.names)
            before += len(ids)

    ranged = documents.select(doc_id, text).repartitionByRange(F.col(doc_id).asc_nulls_first())
    return staged(ranged.sortWithinPartitions(F.col(doc_id).asc_nulls_first(), text).mapInArrow(run, schema), "token-ids")


def _block_ids(row_ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(row_ids, dtype="<u2" if len(row_ids) == 2 * n else "<u4")


def _counts(blocks: DataFrame) -> np.ndarray:
    """Occurrences of every id; what is collected is as long as the vocabulary."""

    def run(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for ids, tokens in zip(batch.column(0), batch.column(1), strict=True):
                found = np.bincount(_block_ids(ids.as_py(), sum(tokens.as_py())))
                if len(found) < len(total):
                    found, total = total, found
                found[:len(total)] += total
                total = found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    rows = blocks.select("ids", "doc_tokens").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = rows.collect()
    counts = np.zeros(max((r["id"] for r in found), default=0) + 1, dtype=np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    return counts


def write_token_files(documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text",
                      end_id: int = 0, tokenizer_path: str | None = None) -> None:
    """Write the ids of all documents, each followed by ``end_id``, in ascending order of id.

    Null ids come first. Null and empty texts are their end id alone; repeated
    rows are written each. An empty table gives an empty, readable folder.
    """
    spark = documents.sparkSession
    blocks = _blocks(documents, doc_id, text, end_id, tokenizer_path)
    lengths = code_lengths(_counts(blocks))
    spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths) if n], "id long, length int") \
        .coalesce(1).write.parquet(f"{path}/codebook")
    # One total per segment, that is, per range of the sort.
    totals = dict(blocks.select("segment", F.aggregate(
        "doc_tokens", F.lit(0).cast("long"), lambda a, b: a + b).alias("n")).groupBy("segment").agg(F.sum("n")).collect())
    order = sorted(totals)
    first = dict(zip(order, accumulate([0, *(totals[s] for s in order)][:-1]), strict=True)) if order else {}
    schema = StructType([
        *(f for f in blocks.schema.fields if f.name in ("segment", "block")), StructField("first_id", LongType()),
        *(f for f in blocks.schema.fields if f.name in ("doc_ids", "doc_tokens")),
        StructField("offsets", BinaryType()), StructField("bits", BinaryType())])

    def run(batches):
        book = CodeBook(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                n = sum(row.column("doc_tokens")[0].as_py())
                words, offsets = book.encode(_block_ids(row.column("ids")[0].as_py(), n))
                at = first[row.column("segment")[0].as_py()] + row.column("before")[0].as_py()
                yield pa.RecordBatch.from_arrays([
                    row.column("segment"), row.column("block"), pa.array([at], pa.int64()), row.column("doc_ids"),
                    row.column("doc_tokens"), binary_array(offsets, [len(offsets)]), binary_array(words, [len(words)])],
                    names=schema.names)

    blocks.mapInArrow(run, schema).write.option("compression", "snappy").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str, doc_id: str = "doc_id") -> DataFrame:
    """Documents of the files: (doc id, start, n_tokens, ids as unsigned 32-bit values)."""
    found = spark.read.parquet(f"{path}/codebook").collect()
    lengths = np.zeros(max((r["id"] for r in found), default=0) + 1, dtype=np.uint8)
    for r in found:
        lengths[r["id"]] = r["length"]
    blocks = spark.read.parquet(f"{path}/blocks")
    schema = StructType([
        StructField(doc_id, blocks.schema["doc_ids"].dataType.elementType), StructField("start", LongType()),
        StructField("n_tokens", LongType()), StructField("ids", BinaryType())])
    name = f"book:{uuid.uuid4().hex}"

    def run(batches):
        book = per_worker(name, lambda: CodeBook(lengths))
        for batch in batches:
            for i in range(batch.num_rows):
                tokens = batch.column("doc_tokens").slice(i, 1).flatten().to_numpy()
                ends = np.cumsum(tokens)
                n = int(ends[-1])
                words = np.frombuffer(batch.column("bits")[i].as_py(), dtype=">u4")
                raw = batch.column("offsets")[i].as_py()
                offsets = np.frombuffer(raw, dtype="<u4" if len(raw) == 4 * -(-n // STRETCH) else "<u8")
                ids = book.decode(words, offsets, n)
                start = batch.column("first_id")[i].as_py() + ends - tokens
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_ids").slice(i, 1).flatten(), pa.array(start, pa.int64()),
                    pa.array(tokens, pa.int64()), binary_array(ids.astype("<u4"), tokens)], names=schema.names)

    return blocks.select("first_id", "doc_ids", "doc_tokens", "offsets", "bits").mapInArrow(run, schema)
