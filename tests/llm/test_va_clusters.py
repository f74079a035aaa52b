import hashlib

import numpy as np
import pytest

from laplake.llm.va_clusters import (
    centroid_clusters,
    exact,
    interval_tables,
    packed_cells,
    possible,
    unpacked_cells,
)

SCHEMA = "vec_id long, embedding array<double>, row long, cluster int"


def brute(rows, k, rounds, dimension=64, scale=64):
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dimension and all(x is not None and np.isfinite(x) for x in v)]

    def order(row):
        i, v = row
        return i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "", v

    centroids = [v for _, v in sorted(kept, key=order)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(((i, nearest(v)[1], nearest(v)[0], centroids[nearest(v)[1]]) for i, v in kept), key=str)


def found(df):
    return sorted(((r["vec_id"], r["cluster"], r["distance"], list(r["centroid"])) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("k", "bits", "seed"), [(16, 4, 1), (5, 2, 2), (3, 1, 3)])
def test_clusters_equal_brute_force(spark, k, bits, seed):
    draw = np.random.default_rng(seed)
    middles = draw.normal(size=(6, 64))
    rows = [(i, (middles[i % 6] + draw.normal(size=64) * 0.6).tolist()) for i in range(200)]
    rows += [(500 + i, rows[3][1]) for i in range(40)]
    rows += [(3, rows[3][1]), (900, None), (901, [1.0]), (902, [float("nan")] * 64), (903, [None] + [1.0] * 63),
             (904, [float("inf")] * 64), (905, [0.0] * 64), (906, [3e4] * 64), (None, rows[8][1])]
    assert found(centroid_clusters(frame(spark, rows), clusters=k, bits=bits)) == brute(rows, k, 3)


def test_few_vectors_and_none(spark):
    rows = [(i, [0.25 * i] * 64) for i in range(3)]
    assert found(centroid_clusters(frame(spark, rows))) == brute(rows, 16, 3)
    assert found(centroid_clusters(frame(spark, [(1, None), (2, [1.0])]))) == []
    assert centroid_clusters(frame(spark, rows).limit(0)).count() == 0
    same = [(i, [1.5] * 64) for i in range(30)]
    assert found(centroid_clusters(frame(spark, same))) == brute(same, 16, 3)


def test_components_out_of_range(spark):
    with pytest.raises(Exception, match="out of range"):
        centroid_clusters(frame(spark, [(1, [1e7] * 64)])).collect()


@pytest.mark.parametrize("bits", [1, 3, 4])
def test_intervals_hold_the_distances(bits):
    draw = np.random.default_rng(bits)
    values = draw.integers(-40, 40, (500, 9))
    values[:, 4] = 7
    borders = np.stack([
        np.concatenate([[v.min()], np.quantile(v, np.arange(1, 1 << bits) / (1 << bits), method="lower"), [v.max() + 1]])
        for v in values.T]).astype(np.int64)
    cells = unpacked_cells(packed_cells(values, borders, bits), 9, bits)
    centroids = draw.integers(-60, 60, (6, 9))
    centroids[5] = centroids[2]
    least, greatest = interval_tables(borders, centroids)
    square = (values[:, :, None] - centroids.T[None]) ** 2
    at = np.arange(9)
    assert (least[at, cells] <= square).all() and (square <= greatest[at, cells]).all()
    best, distance = exact(values, centroids)
    assert (distance == square.sum(axis=1).min(axis=1)).all()
    maybe = possible(cells, (least, greatest))
    assert maybe[np.arange(500), best].all() and (bits == 1 or (maybe.sum(axis=1) < 6).any())
    assert (exact(values, centroids, maybe)[0] == best).all()
