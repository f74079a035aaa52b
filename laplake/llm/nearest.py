"""Approximate nearest neighbours by inner product, with multiprobe p-stable hashing.

Vectors are cut into bands of norms, and in each brought onto a sphere by one
added component, so that the largest inner product is the smallest distance and
one long vector does not push all others together. Each table cuts a few random projections
into steps; the steps are the bucket. A query visits, in every table, its own
bucket and the neighbours reached by moving some projections one step, in order
of the estimated chance that they hold near vectors. All vectors of the visited
buckets are scored exactly, block by block, and only the best of each block go
on, so no pair is ever a row. The own buckets come first; what is found there is
the bar for all others, and bands too short to reach it are left out. Queries that
found fewer rows than there are meet all vectors. Buckets of any size are split
into blocks.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    DoubleType,
    IntegerType,
    LongType,
    StructField,
    StructType,
)

from laplake.llm.frames import binary_array, staged

TABLES, PROJECTIONS, STEP, PROBES = 4, 4, 2.0, 12
NORM_BAND = 0.25  # vectors whose norms lie within so many powers of two share a scale
BLOCK = 1024  # vectors, or queries, of one bucket that meet at a time


class Hashing:
    """The random projections of all tables for vectors of one dimension."""

    def __init__(self, dimension: int, tables: int, projections: int, step: float, seed: int = 13):
        draw = np.random.default_rng([seed, dimension])
        self.tables, self.projections, self.step = tables, projections, step
        self.lines = draw.normal(size=(dimension + 1, tables * projections))
        self.shifts = draw.uniform(0, step, tables * projections)
        self.moves = np.array(list(product((0, -1, 1), repeat=projections)))

    def places(self, points: np.ndarray) -> np.ndarray:
        """Position of each point on each line, in steps: (points, tables, projections)."""
        return ((points @ self.lines + self.shifts) / self.step).reshape(len(points), self.tables, self.projections)

    def probes(self, places: np.ndarray, number: int) -> np.ndarray:
        """Buckets to visit, most promising first: (points, tables, number, projections).

        A move costs the squared distance to the border that it crosses; of equal
        costs the first in a fixed order is taken.
        """
        steps = np.floor(places)
        inside = places - steps
        # Indexed by the move: 0, 1 and -1, the last.
        cost = np.stack([np.zeros_like(inside), (1 - inside) ** 2, inside ** 2], axis=-1)
        total = sum(cost[:, :, i, self.moves[:, i]] for i in range(self.projections))
        order = np.argsort(total, axis=2, kind="stable")[:, :, :number]
        return (steps[:, :, None, :] + self.moves[order]).astype(np.int64)


def bucket_key(steps: np.ndarray, dimension: int) -> np.ndarray:
    """One number per bucket, table and dimension; ``steps`` has tables on its second axis."""
    key = np.full(steps.shape[:-1], dimension, dtype=np.int64)
    key += np.arange(steps.shape[1]).reshape(1, -1, *[1] * (steps.ndim - 3)) << 20
    for i in range(steps.shape[-1]):
        key = key * 1_000_003 + steps[..., i]
    return key


def usable_vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, vector) of vectors without null or non-finite components and with a positive norm."""
    x = F.transform(vector, lambda v: v.cast("double"))
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return rows.where(F.col(vec_id).isNotNull() & F.coalesce(good, F.lit(False))).select(
        F.col(vec_id).alias("id"), x.alias("vector"))


def _placed(vectors: DataFrame, hashing: tuple, longest: float, probes: int | None) -> DataFrame:
    """(bucket, band, visit, norm, id, vector) of every table.

    Without ``probes`` the own bucket, of the band of the vector's norm, with the table as
    ``visit``; else all that a query visits in any band, numbered from 0.
    """

    def run(batches):
        for batch in batches:
            lists = batch.column("vector")
            size = np.diff(lists.offsets.to_numpy())
            for dimension in np.unique(size).tolist():
                mine = np.flatnonzero(size == dimension)
                part = batch.take(pa.array(mine))
                x = part.column("vector").flatten().to_numpy().reshape(-1, dimension)
                top = np.abs(x).max(axis=1)
                norm = top * np.linalg.norm(x / top[:, None], axis=1)
                band = np.zeros(len(x), dtype=np.int32)
                known = Hashing(dimension, *hashing)
                if probes is None:
                    band = np.maximum(0, np.floor((math.log2(longest) - np.log2(norm)) / NORM_BAND)).astype(np.int32)
                    scale = longest * 2.0 ** (-NORM_BAND * band)
                    added = np.sqrt(np.maximum(0, 1 - (norm / scale) ** 2))
                    points = np.column_stack([x / scale[:, None], added])
                    buckets = bucket_key(np.floor(known.places(points)).astype(np.int64), dimension)
                else:
                    points = np.column_stack([x / norm[:, None], np.zeros(len(x))])
                    buckets = bucket_key(known.probes(known.places(points), probes), dimension)
                each = buckets.reshape(len(x), -1).shape[1]
                again = np.repeat(np.arange(len(x)), each)
                for at in range(0, len(again), 1 << 14):
                    rows = again[at:at + (1 << 14)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(buckets.reshape(-1)[at:at + (1 << 14)]),
                        pa.array(band[rows]), pa.array((np.arange(at, at + len(rows)) % (probes or each)).astype(np.int32)),
                        pa.array(norm[rows]), part.column("id").take(pa.array(rows)),
                        binary_array(x[rows].ravel(), np.full(len(rows), dimension))],
                        names=["bucket", "band", "visit", "norm", "id", "vector"])

    return vectors.mapInArrow(run, StructType([
        StructField("bucket", LongType()), StructField("band", IntegerType()), StructField("visit", IntegerType()),
        StructField("norm", DoubleType()), vectors.schema["id"], StructField("vector", BinaryType())]))


def _best_of_block(k: int):
    """Exact scores of a block of vectors for a block of queries; the k best of each query that reach its bar."""

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return np.stack([np.frombuffer(v, dtype=np.float64) for v in column.to_pylist()])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"query_id": [], "vec_id": [], "score": []}
        if not left.num_rows or not right.num_rows:
            return pa.table(empty, schema=pa.schema([
                ("query_id", right.schema.field("id").type), ("vec_id", left.schema.field("id").type), ("score", pa.float64())]))
        x, q = matrix(left.column("id_vector")), matrix(right.column("id_vector"))
        ids = left.column("id").to_numpy()
        asked = right.column("id").to_numpy()
        scores = q @ x.T
        scores[asked[:, None] == ids[None, :]] = -np.inf
        least = right.column("bar").to_numpy()
        if scores.shape[1] > k:
            # Rounding of the product must not decide: near the bar, all are scored again.
            bar = np.partition(scores, -k, axis=1)[:, -k]
            bar = bar - 1e-9 * (1 + np.abs(np.where(np.isfinite(bar), bar, 0)))
        else:
            bar = np.full(len(q), -np.finfo(np.float64).max)
        bar = np.maximum(bar, least - 1e-9 * (1 + np.abs(least)))
        row, column = np.nonzero((scores >= bar[:, None]) & np.isfinite(scores))
        exact = np.empty(len(row))
        for at in range(0, len(row), 1 << 15):
            part = slice(at, at + (1 << 15))
            exact[part] = (q[row[part]] * x[column[part]]).sum(axis=1)
        order = np.lexsort((ids[column], -exact, row))
        row, column, exact = row[order], column[order], exact[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = (rank < k) & (exact >= least[row])
        return pa.table({
            "query_id": right.column("id").take(pa.array(row[keep])), "vec_id": left.column("id").take(pa.array(column[keep])),
            "score": exact[keep]})

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
            tables: int = TABLES, projections: int = PROJECTIONS, step: float = STEP, probes: int = PROBES,
            block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query, itself left out, or all if there are fewer.

    Nearness is the inner product of the original vectors in doubles; equal scores
    go by smaller id. Vectors that are null, zero, or have null or non-finite
    components take no part, nor do rows without an id; a query meets only
    vectors of its dimension. Ids are integers; repeated rows of one id count once.
    """
    corpus = usable_vectors(rows, vec_id, vector)
    asked = usable_vectors(queries, vec_id, vector)
    longest = corpus.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v)))).first()[0] or 1.0
    hashing = (tables, projections, step)
    longest *= 1 + 1e-9
    index = staged(_placed(corpus, hashing, longest, None), "ann-index")
    visits = staged(_placed(asked, hashing, longest, probes), "ann-visits")
    # At most as many bands as doubles have exponents, times four.
    bands = sorted(r["band"] for r in index.select("band").distinct().collect())

    def in_bands(frame: DataFrame) -> DataFrame:
        """``bucket`` told apart by band."""
        return frame.withColumn("bucket", F.xxhash64("bucket", "band"))

    lowest = -float(np.finfo(np.float64).max)
    visits = visits.drop("band").withColumn("band", F.explode(F.lit(bands).cast("array<int>")))
    own, others = visits.where("visit = 0"), visits.where("visit > 0")
    banded = in_bands(index)
    first = staged(_search(banded, in_bands(own).withColumn("bar", F.lit(lowest)), k, block), "ann-first")
    bars = _ranked(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bar"))
    barred = others.join(bars, "id", "left").withColumn("bar", F.coalesce("bar", F.lit(lowest)))
    # No score is above the product of the norms.
    reach = F.col("norm") * longest * F.pow(F.lit(2.0), -NORM_BAND * F.col("band")) * (1 + 1e-6)
    second = _search(banded, in_bands(barred.where(reach >= F.col("bar"))), k, block)
    found = staged(_ranked(first.union(second), k).select("query_id", "rank", "vec_id", "score"), "ann-found")

    # Queries with fewer rows than k and than there are vectors of their dimension meet all of these.
    dimension = (F.octet_length("vector") / 8).cast("long").alias("bucket")
    whole = index.where("visit = 0").select(dimension, "id", "vector")
    there = whole.groupBy("bucket").agg(F.count_distinct("id").alias("there"))
    counts = found.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    singles = asked.select(F.size("vector").cast("long").alias("bucket"), "id").join(there, "bucket")
    short = staged(
        singles.join(counts, "id", "left").where(F.coalesce("n", F.lit(0)) < F.least(F.lit(k), "there")).select("id").distinct(), "ann-short")
    if short.isEmpty():
        return found
    again = _placed(asked.join(short, "id", "left_semi"), hashing, longest, 1)
    again = again.select(dimension, "id", "vector", F.lit(lowest).alias("bar")).dropDuplicates(["bucket", "id", "vector"])
    rest = _ranked(_search(whole, again, k, block), k).select("query_id", "rank", "vec_id", "score")
    return found.join(short.withColumnRenamed("id", "query_id"), "query_id", "left_anti").union(rest)


def _search(index: DataFrame, visits: DataFrame, k: int, block: int) -> DataFrame:
    """(query_id, vec_id, score): each query with the best of every block of the buckets that it visits."""

    def blocks(frame: DataFrame, name: str) -> DataFrame:
        return frame.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))

    sizes = blocks(index, "parts").join(blocks(visits, "query_parts"), "bucket")

    def split(frame: DataFrame, own: str, other: str, *more: str) -> DataFrame:
        """Each row in its own block, once for every block of the other side."""
        mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
        return frame.join(sizes, "bucket").select(
            "bucket", mine.alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other), "id",
            F.col("vector").alias("id_vector"), *more)

    keys = ("bucket", "parts", "query_parts")
    left = split(index, "parts", "query_parts").groupBy(*keys)
    right = split(visits, "query_parts", "parts", "bar").groupBy(*keys)
    id_type = index.schema["id"].dataType
    return left.cogroup(right).applyInArrow(_best_of_block(k), StructType([
        StructField("query_id", id_type), StructField("vec_id", id_type), StructField("score", DoubleType())]))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order).cast(IntegerType())).where(F.col("rank") <= k)
