"""Embedding, storing and searching lap documents."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    DoubleType,
    FloatType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from laplake import constants as C
from laplake.functions.numbers import fixed_text
from laplake.operators.groups import join_on
from laplake.session import written

QUERY_BLOCK = 2_000
CORPUS_PART = 50_000
PACK_BYTES = 4 << 20

Encoder = Callable[[list[str]], Sequence[Sequence[float]]]


def embed_documents(documents: DataFrame, encoder: Encoder, batch: int = C.EMBEDDING_BATCH,
                    column: str = "document", out: str = "embedding") -> DataFrame:
    """Add a vector to every document; ``encoder`` gets ``batch`` texts at a time.

    Vectors stay in the row of their text, so nothing is matched by position.
    """
    schema = StructType([*documents.schema.fields, StructField(out, ArrayType(FloatType()))])

    def encode(frames):
        for frame in frames:
            texts = frame[column].tolist()
            vectors = []
            for at in range(0, len(texts), batch):
                vectors.extend(encoder(texts[at:at + batch]))
            frame[out] = [[float(x) for x in vector] for vector in vectors]
            yield frame

    return documents.mapInPandas(encode, schema)


def filter_vectors(corpus: DataFrame, year: int | None = None, driver: int | None = None,
                   compound: str | None = None) -> DataFrame:
    """Metadata filter; zero and blank mean no filter. Applied before scoring."""
    for name, value in (("year", year), ("driver_number", driver), ("tyre_compound", compound)):
        if value:
            corpus = corpus.where(F.col(name) == value)
    return corpus


def _matrices(column: pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, unit vectors) of the usable rows, by length of the vector.

    Null vectors and vectors with a null or non-finite component are left out.
    """
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    values = lists.flatten()
    ends = np.cumsum(sizes)
    flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null as NaN
    gaps = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(~np.isfinite(flat), out=gaps[1:])
    whole = gaps[ends] == gaps[ends - sizes]
    for size in np.unique(sizes[whole & (sizes > 0)]).tolist():
        rows = np.flatnonzero(whole & (sizes == size))
        yield size, rows, _unit(flat[(ends[rows] - size)[:, None] + np.arange(size)])


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select(F.col("query_id").cast("string").alias("query_id"), "embedding")


def _packed(frame: DataFrame, rows: int, name: str) -> DataFrame:
    """Rows as Arrow streams, at most ``rows`` of them or some megabytes in one."""

    def closed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema) as out:
            for piece in held:
                out.write_batch(piece)
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[name])

    def pack(batches):
        held, count, size = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                piece = batch.slice(at, rows)
                if held and (count + piece.num_rows > rows or size + piece.nbytes > PACK_BYTES):
                    yield closed(held)
                    held, count, size = [], 0, 0
                held.append(piece)
                count, size = count + piece.num_rows, size + piece.nbytes
        if held:
            yield closed(held)

    return frame.mapInArrow(pack, StructType([StructField(name, BinaryType())]))


def _by_blocks(corpus: DataFrame, queries: DataFrame, meet: Callable, schema: StructType, block: int,
               part: int, merge: Callable | None = None) -> DataFrame:
    """Every part of the corpus meets every block of queries.

    Both are shuffled once, in packs, and no pair of them is written: a task reads the parts that
    its block meets one after another. With ``merge`` it keeps what that leaves of a block's results.
    """
    blocks = max(1, math.ceil(queries.count() / block))
    parts = max(1, math.ceil(corpus.count() / part))
    asked = _packed(queries, block, "asked").repartition(blocks).hint("shuffle_replicate_nl")
    pairs = asked.crossJoin(_packed(corpus, part, "rows").repartition(parts))
    tasks = max(blocks, 4 * corpus.sparkSession.sparkContext.defaultParallelism)

    def opened(pack: pa.BinaryScalar) -> pa.Table:
        return pa.ipc.open_stream(pack.as_buffer()).read_all()

    def run(batches):
        last = right = held = None
        for batch in batches:
            for asked, rows in zip(batch.column("asked"), batch.column("rows"), strict=True):
                if last is None or not asked.equals(last):
                    if held is not None:
                        yield from held.to_batches()
                    last, right, held = asked, opened(asked), None
                found = meet(opened(rows), right)
                if merge is None:
                    yield from found.to_batches()
                else:
                    held = found if held is None else merge(pa.concat_tables([held, found]))
        if held is not None:
            yield from held.to_batches()

    return pairs.coalesce(tasks).mapInArrow(run, schema)


def _few(queries: DataFrame, block: int) -> pa.Table | None:
    """The queries, if they are at most ``block``."""
    rows = queries.limit(block + 1).toArrow()
    return rows if len(rows) <= block else None


def _cosines(vectors: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Cosine of every query with every vector, to six digits."""
    return np.round(asked @ vectors.T, 6) + 0.0


def _best_rows(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """(query_id, score, id): of every query the k nearest of some vectors, ties by id."""
    left = left.select(["id", "embedding"]).sort_by("id")
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    asked = {size: (rows, unit) for size, rows, unit in _matrices(right.column("embedding"))}
    for size, rows, vectors in _matrices(left.column("embedding")):
        names, unit = asked.get(size, (None, None))
        for at in range(0, 0 if unit is None else len(unit), 256):
            scores = _cosines(vectors, unit[at:at + 256])
            # One whole number per pair, so that no two are equal: score, then place by id.
            ranks = (np.rint(scores * 1e6).astype(np.int64) << 32) - np.arange(len(rows))
            best = np.argpartition(ranks, -k, axis=1)[:, -k:] if len(rows) > k else np.broadcast_to(
                np.arange(len(rows)), ranks.shape)
            found.append((np.repeat(names[at:at + 256], best.shape[1]), rows[best].ravel(),
                          np.take_along_axis(scores, best, axis=1).ravel()))
    asker, row, score = (
        np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 3
    return pa.table([
        right.column("query_id").take(pa.array(asker)), pa.array(score, pa.float64()), left.column("id").take(pa.array(row))],
        names=["query_id", "score", "id"])


def _kept(hits: pa.Table, k: int) -> pa.Table:
    """At most k of the hits of every query."""
    hits = hits.sort_by([("query_id", "ascending"), ("score", "descending"), ("id", "ascending")]).combine_chunks()
    if not len(hits):
        return hits
    codes = hits.column("query_id").combine_chunks().dictionary_encode().indices.to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    place = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
    return hits.take(pa.array(np.flatnonzero(place < k)))


def _hit_schema(corpus: DataFrame) -> StructType:
    return StructType([
        StructField("query_id", StringType()), StructField("score", DoubleType()), corpus.schema["id"]])


def _scanned(corpus: DataFrame, few: pa.Table, k: int) -> DataFrame:
    """(query_id, score, id): at most k rows per query and task, the k nearest of all among them."""
    corpus = corpus.select("id", "embedding")

    def scan(batches):
        held = None
        for batch in batches:
            found = _best_rows(pa.Table.from_batches([batch]), few, k)
            held = found if held is None else _kept(pa.concat_tables([held, found]), k)
        if held is not None:
            yield from held.to_batches()

    return corpus.mapInArrow(scan, _hit_schema(corpus))


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of every query, ranked."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _described(best: DataFrame, corpus: DataFrame) -> DataFrame:
    """Hits with the other columns of the corpus."""
    others = [c for c in corpus.columns if c not in ("id", "embedding")]
    if not others:
        return best
    return corpus.select("id", *others).join(best, "id").select("query_id", "score", "id", *others, "rank")


def _ranked(hits: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """The k best hits of every query, with the other columns of the corpus."""
    return _described(_best(hits, k), corpus)


def _lowest_ids(corpus: DataFrame, k: int) -> DataFrame:
    """Of rows with one vector those with the k lowest ids: their scores are equal, so no query finds others."""
    order = Window.partitionBy("embedding").orderBy(F.asc_nulls_last("id"))
    rows = corpus.select("id", "embedding").where(F.col("embedding").isNotNull())
    return rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k).drop("_place")


def _ranked_many(corpus: DataFrame, queries: DataFrame, k: int, block: int, part: int) -> DataFrame:
    """``top_k`` for any number of queries: queries with one vector are searched once."""
    queries = written(queries, "asked")
    searched = written(queries.where(F.col("embedding").isNotNull()).select("embedding").distinct().select(
        F.monotonically_increasing_id().cast("string").alias("query_id"), "embedding"), "searched")
    rows = written(_lowest_ids(corpus, k), "rows")
    few = _few(searched, block)
    hits = _scanned(rows, few, k) if few is not None else _by_blocks(
        rows, searched, lambda left, right: _best_rows(left, right, k), _hit_schema(corpus), block, part,
        lambda found: _kept(found, k))
    best = written(_best(hits, k), "best")
    found = searched.join(_described(best, corpus).drop("rank"), "query_id").drop("query_id")
    # A query_id can come with several vectors.
    return _best(queries.join(found, "embedding").drop("embedding"), k)


def top_k(corpus: DataFrame, queries: DataFrame, k: int = 5, block: int = QUERY_BLOCK,
          part: int = CORPUS_PART) -> DataFrame:
    """The k most similar vectors of every query by cosine, exact.

    ``corpus`` has ``id``, which names a row, ``embedding`` and metadata, ``queries`` has
    ``query_id`` and ``embedding``. Up to ``block`` queries travel to the corpus, which is not
    shuffled. Of more of them every distinct vector is searched once, in blocks that meet the
    corpus less those of its copies that cannot be found. Only ids and vectors are scored;
    metadata is joined to the k best. Scores are rounded to six digits; equal scores are ordered
    by id. Vectors with null or non-finite components, or of another length than the query's, are
    no candidates.
    """
    asked = _asked(queries)
    few = _few(asked, block)
    if few is None:
        return _ranked_many(corpus, asked, k, block, part)
    return _ranked(_scanned(corpus, few, k), corpus, k)


def search_texts(corpus: DataFrame, questions: DataFrame, encoder: Encoder, k: int = 3, year: int | None = None,
                 driver: int | None = None, compound: str | None = None, batch: int = C.EMBEDDING_BATCH) -> DataFrame:
    """The k most similar documents of every question (``query_id``, ``question``), by its encoded text.

    Questions are encoded in the plan of the search; the metadata filter reaches the scan of the
    corpus. Null and empty questions find nothing.
    """
    asked = embed_documents(questions.where(F.length("question") > 0), encoder, batch, "question", "embedding")
    return top_k(filter_vectors(corpus, year, driver, compound), asked, k)


def score_range(corpus: DataFrame, queries: DataFrame, block: int = QUERY_BLOCK,
                part: int = CORPUS_PART) -> DataFrame:
    """Lowest and highest score and the number of vectors scored, per query."""
    schema = StructType([
        StructField("query_id", StringType()), StructField("vectors", LongType()),
        StructField("worst", DoubleType()), StructField("best", DoubleType())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {name: [] for name in schema.names}
        asked = {size: (rows, unit) for size, rows, unit in _matrices(right.column("embedding"))}
        for size, rows, vectors in _matrices(left.column("embedding")):
            names, unit = asked.get(size, (None, None))
            for at in range(0, 0 if unit is None else len(unit), 256):
                scores = _cosines(vectors, unit[at:at + 256])
                out["query_id"] += right.column("query_id").take(pa.array(names[at:at + 256])).to_pylist()
                out["vectors"] += [len(rows)] * len(scores)
                out["worst"] += scores.min(axis=1).tolist()
                out["best"] += scores.max(axis=1).tolist()
        return pa.table({name: pa.array(out[name], kind) for name, kind in zip(
            schema.names, (pa.string(), pa.int64(), pa.float64(), pa.float64()), strict=True)})

    queries = _asked(queries)
    few = _few(queries, block)
    if few is None:
        found = _by_blocks(corpus.select("id", "embedding"), queries, meet, schema, block, part)
    else:
        def scan(batches):
            for batch in batches:
                yield from meet(pa.Table.from_batches([batch]), few).to_batches()

        found = corpus.select("id", "embedding").mapInArrow(scan, schema)
    return found.groupBy("query_id").agg(
        F.sum("vectors").alias("vectors"), F.min("worst").alias("worst"), F.max("best").alias("best"))


def mean_vectors(corpus: DataFrame, key: str) -> DataFrame:
    """Mean vector per key, as search queries; every task adds up its rows first."""

    def add_up(batches):
        sums: dict = {}
        for batch in batches:
            names = batch.column("query_id").to_pylist()
            for name, vector in zip(names, batch.column("embedding").to_pylist(), strict=True):
                values = np.array(vector or [], dtype=np.float64)
                held = sums.setdefault((name, len(values)), [np.zeros(len(values)), np.zeros(len(values), dtype=np.int64)])
                seen = ~np.isnan(values)
                held[0] += np.where(seen, values, 0)
                held[1] += seen
        rows = [(name, at, total, n) for (name, _), (s, c) in sums.items()
                for at, (total, n) in enumerate(zip(s.tolist(), c.tolist(), strict=True)) if n]
        names, at, total, n = zip(*rows, strict=True) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(at, pa.int32()), pa.array(total, pa.float64()), pa.array(n, pa.int64())],
            names=["query_id", "at", "total", "n"])

    cells = corpus.select(F.col(key).cast("string").alias("query_id"), "embedding").mapInArrow(
        add_up, "query_id string, at int, total double, n long")
    means = cells.groupBy("query_id", "at").agg((F.sum("total") / F.sum("n")).alias("x"))
    ordered = F.sort_array(F.collect_list(F.struct("at", "x")))
    return means.groupBy("query_id").agg(F.transform(ordered, lambda c: c["x"]).alias("embedding"))


def retrieval_context(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """One text per query: numbered lines with similarity, or the none-found text."""
    line = F.concat(
        F.col("rank").cast("string"), F.lit(". [similarity: "), fixed_text("score", 3), F.lit("] "),
        F.coalesce("document", F.lit("N/A")))
    lines = hits.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("_lines"))
    asked = queries.select(F.col("query_id").cast("string").alias("query_id")).distinct()
    text = F.concat_ws("\n", F.lit(C.CONTEXT_TITLE), F.transform("_lines", lambda x: x["line"]))
    joined = join_on(asked, lines, ["query_id"])
    return joined.select(
        "query_id", F.when(F.col("_lines").isNull(), C.CONTEXT_EMPTY).otherwise(text).alias("context"))


def vector_stats(corpus: DataFrame) -> DataFrame:
    """Number of vectors per year."""
    return corpus.groupBy("year").agg(F.count(F.lit(1)).alias("vectors"))
