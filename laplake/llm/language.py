"""Language identification by a byte convolutional network.

Filters of several widths slide over windows of fixed length; each filter's
largest response in a window goes to a softmax over the languages. Bytes are
one-hot, so a filter is one table of 256 rows per place. The network is trained
in numpy on a bounded sample of labelled texts and sent to the tasks, which run
it over every window of every text in batches. A text's language has the highest
probability on average over its windows, each weighted by its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from laplake.llm.frames import attach
from laplake.llm.sampling import Adam, class_sample
from laplake.llm.text import flat_bytes, lowered, row_slices
from laplake.llm.tokens import LETTER, byte_classes

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
TEXTS_PER_LANGUAGE = 1500
WINDOWS_PER_TEXT = 3
UNDETERMINED = "und"
BLANK = 0x20


def cut_windows(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts, one per row and filled up with blanks; their text and number of bytes."""
    lengths = np.diff(bounds)
    number = -(-lengths // size)
    first = np.cumsum(number) - number
    out = np.full(int(number.sum()) * size, BLANK, dtype=np.uint8)
    out[np.arange(len(data)) + np.repeat(first * size - bounds[:-1], lengths)] = data
    owner = np.repeat(np.arange(len(lengths)), number)
    filled = np.minimum(size, lengths[owner] - (np.arange(len(owner)) - first[owner]) * size)
    return out.reshape(-1, size), owner, filled


class ByteConvNet:
    """Tables of filters by width, and the softmax layer above their maxima."""

    def __init__(self, classes: list[str], widths=WIDTHS, filters: int = FILTERS, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.classes, self.widths, self.filters = classes, widths, filters
        self.tables = [draw.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in widths]
        size = len(widths) * filters
        self.weights = draw.normal(0, 0.1, (size, len(classes))).astype(np.float32)
        self.bias = np.zeros(len(classes), dtype=np.float32)

    def maxima(self, windows: np.ndarray, where: bool = False):
        """Largest response of each filter in each window, and its place if asked."""
        rows, size = windows.shape
        best, places = [], []
        for width, table in zip(self.widths, self.tables, strict=True):
            n = size - width + 1
            response = np.take(table[0], windows[:, :n], axis=0)
            for k in range(1, width):
                response += np.take(table[k], windows[:, k:k + n], axis=0)
            if where:
                place = response.argmax(axis=1)
                places.append(place)
                best.append(np.take_along_axis(response, place[:, None, :], axis=1)[:, 0, :])
            else:
                best.append(response.max(axis=1))
        return np.maximum(np.concatenate(best, axis=1), 0), places

    def probabilities(self, windows: np.ndarray, batch: int = 32) -> np.ndarray:
        """Softmax per window, in batches that fit the processor's cache."""
        out = np.empty((len(windows), len(self.classes)), dtype=np.float64)
        for at in range(0, len(windows), batch):
            features, _ = self.maxima(windows[at:at + batch])
            out[at:at + batch] = self._softmax(features)
        return out

    def _softmax(self, features: np.ndarray) -> np.ndarray:
        z = (features @ self.weights + self.bias).astype(np.float64)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 5, least_steps: int = 200,
              batch: int = 64, seed: int = 11):
        """Cross-entropy, with the gradient of a maximum going to the place that gave it."""
        draw = np.random.default_rng(seed)
        adam = Adam([*self.tables, self.weights, self.bias])
        epochs = max(epochs, -(-least_steps // -(-len(windows) // batch)))
        for epoch in range(epochs):
            adam.rate = 0.01 * (1 - epoch / epochs)
            order = draw.permutation(len(windows))
            for at in range(0, len(order), batch):
                mine = order[at:at + batch]
                x, y = windows[mine], labels[mine]
                features, places = self.maxima(x, where=True)
                error = self._softmax(features)
                error[np.arange(len(y)), y] -= 1
                error = (error / len(y)).astype(np.float32)
                back = (error @ self.weights.T) * (features > 0)
                gradients = []
                for i, (width, table) in enumerate(zip(self.widths, self.tables, strict=True)):
                    grad = np.zeros_like(table)
                    part = back[:, i * self.filters:(i + 1) * self.filters]
                    column = np.broadcast_to(np.arange(self.filters), part.shape)
                    for k in range(width):
                        seen = np.take_along_axis(x, places[i] + k, axis=1)
                        np.add.at(grad[k], (seen, column), part)
                    gradients.append(grad)
                adam.step([*gradients, features.T @ error, error.sum(axis=0)])


def train_language(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
                   per_language: int = TEXTS_PER_LANGUAGE, windows_per_text: int = WINDOWS_PER_TEXT,
                   window: int = WINDOW) -> ByteConvNet | None:
    """A network fitted on about ``per_language`` texts of each language; None without labelled text.

    Of each sampled text up to ``windows_per_text`` windows from all over it are
    used, some of them cut short, so that short texts are known as well.
    """
    rows = labelled.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(key, text, lang)
    sample, _ = class_sample(rows, key, lang, per_language)

    def cut(batches):
        for batch in batches:
            data, bounds = flat_bytes(batch.column(text))
            data = lowered(data)
            out, owner = [], []
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                number = -(-(b - a) // window)
                for k in np.unique(np.linspace(0, number - 1, windows_per_text).astype(int)).tolist():
                    piece = data[a + k * window:min(b, a + (k + 1) * window)].tobytes()
                    short = len(piece) if (a + k) % 3 else max(16, len(piece) // 6)
                    out.append(piece[:short].ljust(window, b" "))
                    owner.append(i)
            yield pa.RecordBatch.from_arrays(
                [batch.column(lang).take(pa.array(owner, pa.int32())), pa.array(out, pa.binary())],
                names=["lang", "piece"])

    found = sorted((r["lang"], bytes(r["piece"])) for r in sample.mapInArrow(cut, "lang string, piece binary").collect())
    if not found:
        return None
    classes = sorted({name for name, _ in found})
    net = ByteConvNet(classes)
    number = {name: i for i, name in enumerate(classes)}
    windows = np.frombuffer(b"".join(piece for _, piece in found), dtype=np.uint8).reshape(-1, window)
    net.train(windows, np.array([number[name] for name, _ in found]))
    return net


def identify_language(documents: DataFrame, net: ByteConvNet | None, text: str = "text",
                      predicted: str = "lang_pred", score: str = "score", window: int = WINDOW) -> DataFrame:
    """Documents with their language and its probability, from all windows of the whole text.

    ``und`` with score 0 where the text is null, empty or without a letter, or where
    there is no network. Of equally likely languages the first by name is taken.
    """

    def run(batch):
        names, scores = [], []
        column = batch.column(text)
        for at, to in row_slices(column):
            data, bounds = flat_bytes(column.slice(at, to - at))
            letters = np.zeros(len(data) + 1, dtype=np.int64)
            np.cumsum(byte_classes(data) == LETTER, out=letters[1:])
            known = letters[bounds[1:]] > letters[bounds[:-1]]
            if net is None:
                known[:] = False
                total = np.zeros((to - at, 1))
            else:
                windows, owner, filled = cut_windows(lowered(data), bounds, window)
                weighted = net.probabilities(windows) * filled[:, None]
                total = np.stack([np.bincount(owner, c, minlength=to - at) for c in weighted.T], axis=1).astype(float)
                total /= np.maximum(1, np.diff(bounds))[:, None]
            best = total.argmax(axis=1)
            names += [net.classes[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            scores.append(np.where(known, np.minimum(1.0, total.max(axis=1)), 0.0))
        return [pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())]

    return attach(documents, [StructField(predicted, StringType()), StructField(score, DoubleType())], run)
