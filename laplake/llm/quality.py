"""Quality classification by a factorisation machine.

Every word occurrence is a feature with value 1/n in a text of n words, by the
hash of the word and by the hash of its last bytes; statistics of the text's
structure and its length are further features. Each feature has a weight and a
short vector; all pairs of features interact by the product of their vectors.
The sum over all pairs is half of (square of the sum - sum of the squares), so
scoring takes time linear in the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from laplake.llm.frames import attach
from laplake.llm.sampling import Adam, class_sample
from laplake.llm.text import (
    blank_class,
    flat_bytes,
    lowered,
    row_slices,
    span_hashes,
    word_bounds,
)

BUCKETS = 1 << 15  # for words; as many again for word ends
FACTORS = 8
STATISTICS = 12
TEXTS_PER_CLASS = 3000


def _byte_groups() -> list[np.ndarray]:
    b = np.arange(256)
    upper = (b >= 65) & (b <= 90)
    lower = (b >= 97) & (b <= 122)
    digit = (b >= 48) & (b <= 57)
    blank = (b == 32) | ((b >= 9) & (b <= 13))
    mark = (b < 128) & ~(upper | lower | digit | blank)
    return [upper, lower, digit, blank, mark, b >= 128, b == 10]


def text_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words and word ends (two columns), the words' bounds by text, and statistics."""
    data, bounds = flat_bytes(column)
    texts = len(bounds) - 1
    stats = np.zeros((texts, STATISTICS), dtype=np.float32)
    size = np.maximum(1, np.diff(bounds))
    for i, group in enumerate(_byte_groups()):
        total = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(group[data], out=total[1:])
        stats[:, i] = (total[bounds[1:]] - total[bounds[:-1]]) / size
    small = lowered(data)
    starts, ends, owner = word_bounds(small, bounds, blank_class())
    hashes = span_hashes(small, starts, ends)
    cuts = np.searchsorted(owner, np.arange(texts + 1))
    n = np.maximum(1, np.diff(cuts))
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    marked = _byte_groups()[4][data[ends - 1]] if len(ends) else np.zeros(0, dtype=bool)
    for i, values in enumerate((again, marked), start=7):
        stats[:, i] = np.bincount(owner, values, minlength=texts) / n
    stats[:, 9] = np.log1p(np.diff(cuts)) / 10
    stats[:, 10] = np.minimum(3.0, size / n / 10)
    stats[:, 11] = np.log1p(np.diff(bounds)) / 12
    word = (hashes >> np.uint64(49)).astype(np.int32)
    tail = data[np.maximum(ends - 2, 0)].astype(np.uint64) * np.uint64(256) + data[ends - 1] if len(ends) else hashes
    tail = ((tail * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int32) + BUCKETS
    return np.stack([word, tail], axis=1), cuts, stats


class FactorisationMachine:
    """Bias, a weight per feature and a vector per feature."""

    def __init__(self, seed: int = 5):
        draw = np.random.default_rng(seed)
        size = 2 * BUCKETS + STATISTICS
        self.bias = np.zeros(1, dtype=np.float32)
        self.weights = np.zeros(size, dtype=np.float32)
        self.vectors = draw.normal(0, 0.05, (size, FACTORS)).astype(np.float32)
        self.centre = np.zeros(STATISTICS, dtype=np.float32)
        self.scale = np.ones(STATISTICS, dtype=np.float32)

    def statistics(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.centre) * self.scale, -4, 4)

    def scores(self, buckets: np.ndarray, cuts: np.ndarray, stats: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each text."""
        texts = len(cuts) - 1
        x = self.statistics(stats)
        share = 1.0 / np.maximum(1, np.diff(cuts))
        linear = self.bias[0] + x @ self.weights[2 * BUCKETS:]
        dense = self.vectors[2 * BUCKETS:]
        sums, squares = x @ dense, (x * x) @ (dense * dense)
        filled = np.flatnonzero(np.diff(cuts))
        if len(filled):
            heads = cuts[filled]
            own = share[filled][:, None]
            for side in (0, 1):
                ids = buckets[:, side]
                linear[filled] += np.add.reduceat(self.weights[ids], heads) * own[:, 0]
                vectors = self.vectors[ids]
                sums[filled] += np.add.reduceat(vectors, heads, axis=0) * own
                vectors *= vectors
                squares[filled] += np.add.reduceat(vectors, heads, axis=0) * (own * own)
        z = linear + 0.5 * (sums * sums - squares).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))) if texts else np.zeros(0)

    def train(self, rows: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray, labels: np.ndarray,
              weights: np.ndarray, epochs: int = 12, batch: int = 64, seed: int = 3):
        """Weighted logistic loss; ``rows`` has each text's features and their summed values."""
        self.centre = stats.mean(axis=0)
        self.scale = 1 / np.maximum(1e-3, stats.std(axis=0))
        x_all = self.statistics(stats)
        draw = np.random.default_rng(seed)
        adam = Adam([self.bias, self.weights, self.vectors], rate=0.01)
        decay = 1e-4
        for epoch in range(epochs):
            adam.rate = 0.01 * (1 - epoch / epochs)
            order = draw.permutation(len(rows))
            for at in range(0, len(order), batch):
                mine = order[at:at + batch]
                ids = np.concatenate([rows[i][0] for i in mine])
                values = np.concatenate([rows[i][1] for i in mine])
                parts = np.concatenate([rows[i][2] for i in mine])
                own = np.repeat(np.arange(len(mine)), [len(rows[i][0]) for i in mine])
                x = x_all[mine]
                dense = self.vectors[2 * BUCKETS:]
                vectors = self.vectors[ids]
                sums, squares = x @ dense, (x * x) @ (dense * dense)
                linear = self.bias[0] + x @ self.weights[2 * BUCKETS:]
                linear += np.bincount(own, self.weights[ids] * values, minlength=len(mine))
                np.add.at(sums, own, vectors * values[:, None])
                np.add.at(squares, own, vectors * vectors * parts[:, None])
                z = linear + 0.5 * (sums * sums - squares).sum(axis=1)
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[mine]) * weights[mine] / len(mine)
                error = error.astype(np.float32)
                w_grad, v_grad = decay * self.weights / 10, decay * self.vectors
                np.add.at(w_grad, ids, error[own] * values)
                np.add.at(v_grad, ids, error[own][:, None] * (sums[own] * values[:, None] - vectors * parts[:, None]))
                w_grad[2 * BUCKETS:] += x.T @ error
                v_grad[2 * BUCKETS:] += x.T @ (error[:, None] * sums) - dense * ((x * x).T @ error)[:, None]
                adam.step([error.sum(keepdims=True), w_grad, v_grad])


class ConstantScore:
    """The score where labels of only one class, or none, are there to learn from."""

    def __init__(self, score: float):
        self.score = score

    def scores(self, buckets, cuts, stats) -> np.ndarray:
        return np.full(len(cuts) - 1, self.score)


def train_quality(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  label: str = "quality", per_class: int = TEXTS_PER_CLASS):
    """A model fitted on about ``per_class`` labelled texts of each class, weighted back to all labels.

    Several labels of one document count by their mean, rounded up from a half.
    Null labels and null ids are left out. With labels of one class only, every
    score is 1 or 0; without any it is a half.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(
        (F.avg(label) >= 0.5).cast("int").alias("_label"))
    sample, counts = class_sample(known, doc_id, "_label", per_class)
    # At most two classes of about per_class ids, and one text of each: bounded whatever the input.
    rows = documents.select(doc_id, text).join(F.broadcast(sample), doc_id).groupBy(doc_id, "_label").agg(
        F.min(text).alias(text))

    def cut(batches):
        for batch in batches:
            for at, to in row_slices(batch.column(text)):
                part = batch.slice(at, to - at)
                buckets, cuts, stats = text_features(part.column(text))
                out = []
                for i in range(to - at):
                    ids, n = np.unique(buckets[cuts[i]:cuts[i + 1]], return_counts=True)
                    out.append((ids.astype("<i4").tobytes(), n.astype("<i4").tobytes(), stats[i].astype("<f4").tobytes()))
                ids, n, numbers = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(doc_id).cast(pa.string()), part.column("_label"), *(pa.array(v, pa.binary()) for v in (ids, n, numbers))],
                    names=["key", "label", "ids", "n", "stats"])

    found = sorted(
        rows.mapInArrow(cut, "key string, label int, ids binary, n binary, stats binary").collect(),
        key=lambda r: (r["key"], bytes(r["ids"]), bytes(r["stats"])))
    labels_found = np.array([r["label"] for r in found])
    if len(set(labels_found.tolist())) < 2:
        return ConstantScore(float(labels_found[0]) if len(found) else 0.5)
    features = []
    for r in found:
        n = np.frombuffer(r["n"], dtype="<i4").astype(np.float32)
        words = max(1.0, n.sum() / 2)
        features.append((np.frombuffer(r["ids"], dtype="<i4"), n / words, n / words ** 2))
    weight = np.array([counts[k] / (labels_found == k).sum() for k in (0, 1)])[labels_found]
    machine = FactorisationMachine()
    machine.train(features, np.stack([np.frombuffer(r["stats"], dtype="<f4") for r in found]),
                  labels_found.astype(np.float32), (weight / weight.mean()).astype(np.float32))
    return machine


def score_quality(documents: DataFrame, model, text: str = "text", score: str = "score") -> DataFrame:
    """Documents with a score of 0 to 1 from the whole text; null and empty texts are scored alike."""

    def run(batch):
        column = batch.column(text)
        found = [model.scores(*text_features(column.slice(at, to - at))) for at, to in row_slices(column, 2 << 20)]
        return [pa.array(np.concatenate(found) if found else [], pa.float64())]

    return attach(documents, [StructField(score, DoubleType())], run)
