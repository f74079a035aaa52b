"""Inverted lists: a corpus of vectors written by nearest centroid, and search that reads few lists."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from laplake.operators.vectors import _asked, _best_rows, _hit_schema, _matrices, _ranked
from laplake.session import cut_lineage

LISTS, SAMPLE, ROUNDS = 64, 20_000, 8
PART = 50_000  # vectors of one list that a task scores
OTHERS = -1  # the list of vectors that have another dimension, or cannot be scored
SCALE = 1 << 30


def train_centroids(corpus: DataFrame, lists: int = LISTS, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of about ``sample`` vectors of the commonest dimension, taken by a hash of the id."""
    rows = corpus.select("id", "embedding")
    number = rows.count()
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(SCALE)) < math.ceil(SCALE * min(1.0, sample / max(1, number))))
    table = chosen.limit(2 * sample).toArrow().sort_by("id")
    groups = [(len(own), size, unit) for size, own, unit in _matrices(table.column("embedding"))] if len(table) else []
    if not groups:
        return np.zeros((0, 0))
    vectors = max(groups, key=lambda g: g[:2])[2]
    vectors = vectors[np.linalg.norm(vectors, axis=1) > 0]
    centroids = vectors[np.unique(np.linspace(0, len(vectors) - 1, min(lists, len(vectors))).astype(int))]
    for _ in range(rounds):
        own = (vectors @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, vectors)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centroids)
    return centroids


class VectorIndex:
    """A corpus in folders by list, with the centroid, the size and the widest angle of each list."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        columns = spark.read.parquet(f"{path}/columns").schema.fields
        self.schema = StructType([*columns, StructField("list", IntegerType())])
        found = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
        self.numbers = [r["list"] for r in found]
        self.sizes = [r["n"] for r in found]
        self.angles = np.array([r["angle"] for r in found])
        self.centroids = np.array([r["centroid"] for r in found]) if found else np.zeros((0, 0))

    @classmethod
    def build(cls, corpus: DataFrame, path: str, lists: int = LISTS, sample: int = SAMPLE) -> VectorIndex:
        """Write the corpus by nearest centroid; every row of it is in exactly one list."""
        centroids = train_centroids(corpus, lists, sample)
        columns = corpus.columns

        def place(batches):
            for batch in batches:
                number = np.full(batch.num_rows, OTHERS, dtype=np.int32)
                angle = np.zeros(batch.num_rows)
                for size, rows, unit in _matrices(pa.chunked_array([batch.column("embedding")])):
                    if size == centroids.shape[1]:
                        cosines = unit @ centroids.T
                        number[rows] = cosines.argmax(axis=1)
                        angle[rows] = np.arccos(np.clip(cosines.max(axis=1), -1, 1))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(angle), pa.array(number)], names=[*columns, "_angle", "list"])

        schema = StructType([*corpus.schema.fields, StructField("_angle", DoubleType()), StructField("list", IntegerType())])
        placed = corpus.mapInArrow(place, schema)
        placed.hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/lists")
        spark = corpus.sparkSession
        known = spark.createDataFrame(
            [(i, c) for i, c in enumerate(centroids.tolist())], "list int, centroid array<double>")
        counted = spark.read.schema(schema).parquet(f"{path}/lists").groupBy("list").agg(
            F.count(F.lit(1)).alias("n"), F.max("_angle").alias("angle"))
        corpus.limit(0).write.parquet(f"{path}/columns")  # also where there are no lists
        known.join(counted, "list").coalesce(1).write.parquet(f"{path}/centroids")
        return cls(spark, path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/lists")

    def lists_of(self, numbers: list[int]) -> DataFrame:
        """Vectors of some lists; the folders of all others are not read."""
        return self.rows().where(F.col("list").isin(numbers))

    def _routed(self, queries: DataFrame, choose) -> DataFrame:
        """(query_id, embedding, list) for the lists that ``choose(cosines, bar)`` marks."""
        numbers, centroids, angles = np.array(self.numbers), self.centroids, self.angles
        names = [c for c in queries.columns if c in ("query_id", "embedding")]

        def route(batches):
            for batch in batches:
                bar = batch.column("bar").to_numpy(zero_copy_only=False)
                row, to = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
                for size, rows, unit in _matrices(pa.chunked_array([batch.column("embedding")])):
                    if len(numbers) and size == centroids.shape[1]:
                        at, which = np.nonzero(choose(np.clip(unit @ centroids.T, -1, 1), angles, bar[rows]))
                        row.append(rows[at])
                        to.append(numbers[which])
                    else:
                        row.append(rows)
                        to.append(np.full(len(rows), OTHERS))
                take = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(take) for c in names), pa.array(np.concatenate(to).astype(np.int32))],
                    names=[*names, "list"])

        return queries.mapInArrow(route, StructType([*(queries.schema[c] for c in names), StructField("list", IntegerType())]))

    def _met(self, pairs: DataFrame, k: int, part: int) -> DataFrame:
        """(query_id, score, id) of the queries and lists that belong together, list by list."""
        numbers = [r["list"] for r in pairs.select("list").distinct().collect()]
        sizes = self.spark.createDataFrame(
            [(n, max(1, math.ceil(size / part))) for n, size in zip(self.numbers, self.sizes, strict=True)], "list int, _parts int")
        own = self.lists_of(numbers).select("id", "embedding", "list").join(F.broadcast(sizes), "list", "left").withColumn(
            "_part", F.pmod(F.xxhash64("id"), F.coalesce("_parts", F.lit(1))).cast("int"))
        asked = pairs.join(F.broadcast(sizes), "list", "left").withColumn(
            "_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
        keys = ["list", "_part"]
        return own.drop("_parts").groupBy(*keys).cogroup(asked.drop("_parts").groupBy(*keys)).applyInArrow(
            lambda left, right: _best_rows(left, right, k), _hit_schema(own))

    def search(self, queries: DataFrame, k: int = 5, probes: int = 8, exact: bool = False, part: int = PART) -> DataFrame:
        """The k most similar vectors of every query found in its ``probes`` nearest lists.

        With ``exact`` all lists follow that may hold a better one: the angle between query and
        centroid, less the widest angle of the list, bounds the cosine of all its vectors. Both
        ways give scores as ``top_k`` does, ties by id.
        """
        corpus = self.rows().drop("list")
        asked = _asked(queries).withColumn("bar", F.lit(0.0))

        def nearest(cosines, angles, bar):
            place = np.argsort(np.argsort(-cosines, axis=1, kind="stable"), axis=1)
            return place < probes

        pairs = cut_lineage(self._routed(asked, nearest))
        hits = self._met(pairs, k, part)
        if not exact:
            return _ranked(hits, corpus, k)
        hits = cut_lineage(hits)
        bars = _ranked(hits, corpus.select("id"), k).groupBy("query_id").agg(
            F.when(F.count(F.lit(1)) == k, F.min("score")).alias("bar"))
        again = asked.drop("bar").join(bars, "query_id", "left").withColumn("bar", F.coalesce("bar", F.lit(-2.0)))

        def may_hold(cosines, angles, bar):
            best = np.cos(np.maximum(0, np.arccos(cosines) - angles))
            return ~nearest(cosines, angles, bar) & (best >= bar[:, None] - 2e-6)

        more = cut_lineage(self._routed(again, may_hold).where(F.col("list") != OTHERS))
        return _ranked(hits.union(self._met(more, k, part)), corpus, k)
