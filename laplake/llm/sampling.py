"""Bounded training samples that depend on row keys alone."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1 << 30


def class_sample(rows: DataFrame, key: str, label: str, per_class: int) -> tuple[DataFrame, dict]:
    """About ``per_class`` rows of each label, or all where there are fewer, and all labels' counts.

    A row is in or out by the hash of its key, so every run takes the same rows. Of
    rows that share key and label, the least one by its other columns is taken.
    """
    found = rows.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct(key, 0.01).alias("keys")).collect()
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(SCALE))
    keep = F.lit(False)
    for r in found:
        bar = SCALE if r["keys"] <= per_class else math.floor(SCALE * per_class / r["keys"])
        keep = keep | ((F.col(label) == F.lit(r[label])) & (place < bar))
    sample = rows.where(keep)
    others = [c for c in rows.columns if c not in (key, label)]
    if others:
        least = F.min(F.struct(*others)).alias("_least")
        sample = sample.groupBy(key, label).agg(least).select(
            *(F.col(c) if c in (key, label) else F.col(f"_least.{c}") for c in rows.columns))
    else:
        sample = sample.distinct()
    return sample, {r[label]: r["n"] for r in found}


class Adam:
    """Gradient steps with running moments for a list of numpy arrays."""

    def __init__(self, params, rate: float = 0.01):
        import numpy as np

        self.params, self.rate, self.t = params, rate, 0
        self.first = [np.zeros_like(p) for p in params]
        self.second = [np.zeros_like(p) for p in params]

    def step(self, gradients) -> None:
        import numpy as np

        self.t += 1
        rate = self.rate * math.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        for p, g, m, v in zip(self.params, gradients, self.first, self.second, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            p -= rate * m / (np.sqrt(v) + 1e-8)
