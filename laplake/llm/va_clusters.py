"""Centroid clustering over a vector-approximation file.

Vectors of whole numbers are kept twice: in full, and as cells of a few bits per
dimension, whose borders are quantiles of all vectors. Each round reads the cells. Two
tables per centroid, made from its components and the cell borders, give the least and
greatest distance that a cell allows in each dimension; their sums bound the distance of
every vector to every centroid. A vector whose least distance to all centroids but one
is above the greatest distance to some centroid is placed without its components. Only
where intervals overlap, or where a vector moves and its components change two sums, is
the full vector fetched.

Sums and counts of the clusters follow the vectors that move, in whole numbers, so
centroids are exact. The last pass fetches all vectors, for their distances.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
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

BITS = 4  # per dimension
ACCURACY = 1000  # of the quantiles that become cell borders
LARGEST = 1 << 26  # whole numbers beyond this could overflow a squared distance


def _usable(column, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vectors have ``dimension`` finite components, and these as doubles."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dimension)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
    values = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False).reshape(-1, dimension)
    good = np.isfinite(values).all(axis=1)
    return rows[good], values[good]


def whole_vectors(rows: DataFrame, vec_id: str, vector: str, scale: int, dimension: int) -> DataFrame:
    """(id, vector) with floor(scale * component) of vectors that have only finite components."""

    def run(batches):
        for batch in batches:
            keep, values = _usable(batch.column(vector), dimension)
            values = np.floor(values * scale)
            if len(values) and np.abs(values).max() >= LARGEST:
                raise ValueError(f"components of {LARGEST // scale} and more are out of range")
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(keep) + 1, dtype=np.int32) * dimension), pa.array(values.astype(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(vec_id).take(pa.array(keep)), lists], names=["id", "vector"])

    return rows.select(vec_id, vector).mapInArrow(run, StructType([
        StructField("id", rows.schema[vec_id].dataType), StructField("vector", ArrayType(LongType()))]))


def cell_borders(vectors: DataFrame, dimension: int, bits: int) -> np.ndarray | None:
    """Per dimension the first value of each cell, and one past the last value; None without vectors."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    wanted = []
    for d in range(dimension):
        x = F.col("vector")[d]
        wanted.append(F.concat(
            F.array(F.min(x)), F.percentile_approx(x, shares, ACCURACY), F.array(F.max(x) + 1)).alias(f"d{d}"))
    found = vectors.agg(*wanted).first()
    return None if found[0] is None else np.array([list(c) for c in found], dtype=np.int64)


def packed_cells(values: np.ndarray, borders: np.ndarray, bits: int) -> np.ndarray:
    """The cell numbers of each vector, ``bits`` each, one row of bytes per vector."""
    cells = np.stack([
        np.searchsorted(b[1:-1], values[:, d], side="right") for d, b in enumerate(borders)], axis=1).astype(np.uint8)
    return np.packbits(np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - bits:].reshape(len(values), -1), axis=1)


def unpacked_cells(packed: np.ndarray, dimension: int, bits: int) -> np.ndarray:
    each = np.unpackbits(packed, axis=1, count=dimension * bits).reshape(-1, dimension, bits)
    return each @ (1 << np.arange(bits - 1, -1, -1)).astype(np.uint8)


def interval_tables(borders: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance in one dimension: (dimension, cell, centroid)."""
    low, high = borders[:, :-1, None], borders[:, 1:, None] - 1
    z = centroids.T[:, None, :]
    below, above = z - low, z - high
    greatest = np.maximum(below ** 2, above ** 2)
    least = np.where((below >= 0) & (above <= 0), 0, np.minimum(below ** 2, above ** 2))
    return least, greatest


def possible(cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which centroids may be the nearest of each vector, by the distance intervals."""
    least, greatest = (np.zeros((len(cells), t.shape[2]), dtype=np.int64) for t in tables)
    for d in range(cells.shape[1]):
        least += tables[0][d][cells[:, d]]
        greatest += tables[1][d][cells[:, d]]
    return least <= greatest.min(axis=1, keepdims=True)


def exact(values: np.ndarray, centroids: np.ndarray, maybe: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest of the possible centroids; of equal ones the first."""
    distance = np.stack([((values - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    if maybe is not None:
        distance[~maybe] = np.iinfo(np.int64).max
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(values)), best]


class _VectorFile:
    """The two tables, and passes over them."""

    def __init__(self, vectors: DataFrame, dimension: int, bits: int):
        self.dimension, self.bits = dimension, bits
        self.vectors = staged(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")
        self.borders = cell_borders(self.vectors, dimension, bits)

    def cells(self) -> DataFrame:
        """(row, cells, cluster) before any round."""
        borders, dimension, bits = self.borders, self.dimension, self.bits

        def run(batches):
            for batch in batches:
                packed = packed_cells(_components(batch, dimension), borders, bits)
                yield pa.RecordBatch.from_arrays([
                    batch.column("row"), binary_array(packed.ravel(), np.full(len(packed), packed.shape[1])),
                    pa.nulls(len(packed), pa.int32())], names=["row", "cells", "cluster"])

        return staged(self.vectors.select("row", "vector").mapInArrow(run, StructType([
            StructField("row", LongType()), StructField("cells", BinaryType()), StructField("cluster", IntegerType())])), "cells")

    def placed(self, state: DataFrame, centroids: np.ndarray) -> DataFrame:
        """The state with ``maybe``, the bits of the possible centroids, and ``found`` if there is only one."""
        borders, dimension, bits = self.borders, self.dimension, self.bits

        def run(batches):
            tables = interval_tables(borders, centroids)
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    cells = unpacked_cells(_bytes(part.column("cells")), dimension, bits)
                    maybe = possible(cells, tables)
                    one = maybe.sum(axis=1) == 1
                    found = pa.array(maybe.argmax(axis=1).astype(np.int32), mask=~one)
                    kept = np.packbits(maybe, axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, found, binary_array(kept.ravel(), np.full(len(kept), kept.shape[1]))],
                        names=[*part.schema.names, "found", "maybe"])

        return state.mapInArrow(run, StructType([
            *state.schema.fields, StructField("found", IntegerType()), StructField("maybe", BinaryType())]))

    def fetched(self, placed: DataFrame, centroids: np.ndarray, also: tuple[str, ...] = ()) -> DataFrame:
        """(row, cells, old, cluster, distance, vector) of the given rows, from their full vectors."""
        wide = placed.withColumnRenamed("cluster", "old").join(self.vectors, "row")
        dimension = self.dimension

        def run(batches):
            for batch in batches:
                values = _components(batch, dimension)
                maybe = np.unpackbits(_bytes(batch.column("maybe")), axis=1, count=len(centroids)).astype(bool)
                best, distance = exact(values, centroids, maybe)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("row", "cells", "old", "vector", *also)),
                     pa.array(best.astype(np.int32)), pa.array(distance)],
                    names=["row", "cells", "old", "vector", *also, "cluster", "distance"])

        fields = [wide.schema[c] for c in ("row", "cells", "old", "vector", *also)]
        return wide.mapInArrow(run, StructType([*fields, StructField("cluster", IntegerType()), StructField("distance", LongType())]))


def _components(batch, dimension: int) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _bytes(column) -> np.ndarray:
    """Binary values of one size as rows of a matrix."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=np.uint8).reshape(len(values), -1) if values else np.zeros((0, 1), np.uint8)


def _moves(moved: DataFrame, dimension: int) -> list:
    """Per cluster the number of vectors gained, less those lost, and the same for every component."""
    ends = F.explode(F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("sign")),
                             F.struct(F.col("old").alias("c"), F.lit(-1).alias("sign")))).alias("end")
    each = moved.select("vector", ends).where("end.c IS NOT NULL")
    sums = [F.sum(F.col("vector")[d] * F.col("end.sign")).alias(f"d{d}") for d in range(dimension)]
    return each.groupBy(F.col("end.c").alias("c")).agg(F.sum("end.sign").alias("n"), *sums).collect()


def centroid_clusters(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", clusters: int = 16,
                      rounds: int = 3, scale: int = 64, dimension: int = 64, bits: int = BITS,
                      start: str = "1") -> DataFrame:
    """(id, cluster, distance, centroid): every vector with its cluster after ``rounds`` rounds.

    Components become floor(``scale`` * component). Centroids start as the vectors with the
    smallest sha256 of ``start:id``; ties go to the smaller vector. Null vectors, those of another
    dimension and those with null or non-finite components are left out. Rows that share an id are
    clustered each for itself; null ids are never a start unless there are too few others. With fewer
    vectors than ``clusters`` there are as many clusters as vectors, without any there are no rows.
    Other columns don't matter, whatever their names. Components whose whole number reaches ``LARGEST``
    are an error.
    """
    file = _VectorFile(whole_vectors(rows, vec_id, vector, scale, dimension), dimension, bits)
    kind = StructType([
        StructField(vec_id, rows.schema[vec_id].dataType), StructField("cluster", IntegerType()),
        StructField("distance", LongType()), StructField("centroid", ArrayType(LongType()))])
    if file.borders is None:
        return rows.sparkSession.createDataFrame([], kind)
    order = F.sha2(F.concat(F.lit(f"{start}:"), F.col("id").cast("string")), 256)
    first = file.vectors.select("vector", order.alias("order")).orderBy(
        F.col("order").asc_nulls_last(), "vector").limit(clusters).collect()
    centroids = np.array([r["vector"] for r in first], dtype=np.int64)
    # Python numbers: sums never overflow, and // rounds down.
    counts, sums = [0] * len(centroids), [[0] * dimension for _ in centroids]
    state = file.cells()
    for _ in range(rounds):
        placed = staged(file.placed(state, centroids), "placed")
        same = F.col("found").eqNullSafe(F.col("cluster")) & F.col("found").isNotNull()
        fetched = staged(file.fetched(placed.where(~same), centroids), "fetched")
        for r in _moves(fetched.where(~F.col("old").eqNullSafe(F.col("cluster"))), dimension):
            counts[r["c"]] += r["n"]
            sums[r["c"]] = [s + r[f"d{d}"] for d, s in enumerate(sums[r["c"]])]
        for c, n in enumerate(counts):
            if n:
                centroids[c] = [s // n for s in sums[c]]
        state = placed.where(same).select("row", "cells", "cluster").union(fetched.select("row", "cells", "cluster"))
    last = file.fetched(file.placed(state, centroids), centroids, also=("id",))
    names = rows.sparkSession.createDataFrame(
        [(c, values) for c, values in enumerate(centroids.tolist())], "cluster int, centroid array<bigint>")
    return last.join(F.broadcast(names), "cluster").select(F.col("id").alias(vec_id), "cluster", "distance", "centroid")

