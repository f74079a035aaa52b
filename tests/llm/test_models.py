import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from laplake.llm.language import (
    ByteConvNet,
    cut_windows,
    identify_language,
    train_language,
)
from laplake.llm.nearest import nearest
from laplake.llm.quality import (
    ConstantScore,
    FactorisationMachine,
    score_quality,
    text_features,
    train_quality,
)
from laplake.llm.sampling import class_sample
from tests_llm_tables import documents, labels


def test_windows_cover_whole_texts():
    texts = [b"", b"abc", b"x" * 16, b"y" * 33]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    bounds = np.cumsum([0, *map(len, texts)])
    windows, owner, filled = cut_windows(data, bounds, 16)
    assert owner.tolist() == [1, 2, 3, 3, 3] and filled.tolist() == [3, 16, 16, 16, 1]
    assert b"".join(w.tobytes()[:n] for w, n in zip(windows, filled, strict=True)) == b"".join(texts)


def test_gradient_goes_to_the_maximum():
    net = ByteConvNet(["a", "b"], widths=(2,), filters=3)
    windows = np.array([list(b"hello world 1234"), list(b"quite other text")], dtype=np.uint8)
    before = -np.log(net.probabilities(windows)[[0, 1], [0, 1]]).sum()
    net.train(windows, np.array([0, 1]), least_steps=300)
    assert -np.log(net.probabilities(windows)[[0, 1], [0, 1]]).sum() < before / 4


def test_language_of_held_out_texts(spark):
    docs = documents(spark)
    net = train_language(docs.where("doc_id % 3 != 1"))
    found = identify_language(docs.withColumn("score", F.lit("own")), net).where("doc_id % 3 = 1").select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) > 0.97 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ... !!"), (4, "ü"), (5, None)], "doc_id long, text string")
    names = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify_language(odd, net).collect()}
    assert names[1] == names[2] == names[3] == names[5] == ("und", 0.0) and names[4][0] != "und"
    assert identify_language(odd.limit(0), net).count() == 0
    untrained = identify_language(odd, train_language(docs.where("lang is null")))
    assert {r["lang_pred"] for r in untrained.collect()} == {"und"}


def test_long_texts_count_as_a_whole(spark):
    docs = documents(spark)
    net = train_language(docs.where("doc_id % 3 != 1"))
    parts = {r["lang"]: r["text"] for r in docs.where("length(text) > 500").select("lang", "text").collect()}
    text = parts["en"][:400] + (parts["de"] + " ") * 40
    found = identify_language(spark.createDataFrame([(1, text)], "doc_id long, text string"), net).first()
    assert found["lang_pred"] == "de"


def test_pairs_by_sums_of_squares():
    draw = np.random.default_rng(1)
    column = pa.array(["one two three two", "", "Alpha beta!! gamma", None])
    buckets, cuts, stats = text_features(column)
    machine = FactorisationMachine()
    machine.weights[:] = draw.normal(size=len(machine.weights))
    machine.vectors[:] = draw.normal(size=machine.vectors.shape)
    found = machine.scores(buckets, cuts, stats)
    for i in range(4):
        n = max(1, cuts[i + 1] - cuts[i])
        rows = [(int(b), 1 / n) for b in buckets[cuts[i]:cuts[i + 1]].ravel()]
        rows += [(2 * (1 << 15) + k, float(v)) for k, v in enumerate(machine.statistics(stats)[i])]
        z = machine.bias[0] + sum(machine.weights[j] * x for j, x in rows)
        z += sum(
            float(machine.vectors[a] @ machine.vectors[b]) * x * y
            for k, (a, x) in enumerate(rows) for b, y in rows[:k])
        assert abs(found[i] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-3


def test_quality_of_held_out_texts(spark):
    docs, known = documents(spark), labels(spark)
    model = train_quality(docs, known.where("doc_id % 3 != 1"))
    found = score_quality(docs.withColumn("score", F.lit("own")), model).join(known, "doc_id").where("doc_id % 3 = 1").collect()
    right = sum((r["score"] >= 0.5) == (r["quality"] == 1) for r in found)
    assert right > 0.95 * len(found)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "w " * 200_000), (3, "w")], "doc_id long, text string")
    scores = score_quality(odd, model).collect()
    assert all(0 <= r["score"] <= 1 for r in scores) and scores[0]["score"] == scores[1]["score"]
    assert score_quality(odd.limit(0), model).count() == 0


def test_quality_with_few_labels(spark):
    docs = documents(spark)
    schema = "doc_id long, quality int, text string"
    assert isinstance(train_quality(docs, spark.createDataFrame([], schema)), ConstantScore)
    rows = [(0, 1, "x"), (None, 0, "x"), (1, None, "x"), (2, 1, "x"), (2, 0, "x")]
    only = train_quality(docs, spark.createDataFrame(rows, schema))
    assert only.scores(None, [0, 0], None).tolist() == [1.0]


def test_sample_is_bounded_and_whole_where_small(spark):
    rows = spark.range(20_000).select(F.col("id").alias("k"), F.when(F.col("id") < 50, "rare").otherwise("often").alias("label"))
    sample, counts = class_sample(rows, "k", "label", 1000)
    found = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    assert counts == {"rare": 50, "often": 19_950} and found["rare"] == 50 and 850 < found["often"] < 1150


def brute_nearest(rows, asked, k):
    out = {}
    for q in asked:
        found = sorted(((-sum(a * b for a, b in zip(rows[q], v, strict=True)), i) for i, v in rows.items() if i != q))
        out[q] = [(i, -s) for s, i in found[:k]]
    return out


def test_nearest_with_every_bucket_is_exact(spark):
    draw = random.Random(10)
    rows = {i: [draw.gauss(0, 1) for _ in range(6)] for i in range(300)}
    for i in range(300, 420):
        rows[i] = rows[7]
    bad = [(900, None), (901, [0.0] * 6), (902, [None, *[1.0] * 5]), (903, [float("nan"), *[1.0] * 5]), (904, [float("inf")] * 6), (None, [1.0] * 6)]
    schema = "vec_id long, embedding array<double>, score string"
    df = spark.createDataFrame([(*r, "x") for r in [*rows.items(), *bad]], schema)
    asked = df.where("vec_id % 20 = 0")
    found = {}
    for r in nearest(df, asked, k=5, step=50.0, probes=81, block=16).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute_nearest(rows, [i for i in rows if i % 20 == 0], 5)
    assert set(found) == set(want)
    for q, best in want.items():
        assert [i for i, _ in found[q]] == [i for i, _ in best]
        assert np.allclose([s for _, s in found[q]], [s for _, s in best])


def test_recall_and_small_tables(spark):
    draw = random.Random(11)
    rows = {i: [draw.gauss(0, 1) for _ in range(32)] for i in range(1500)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>")
    want = brute_nearest({i: [float(np.float32(x)) for x in v] for i, v in rows.items()}, range(0, 1500, 50), 10)
    found = nearest(df, df.where("vec_id % 50 = 0"), k=10).collect()
    hit = sum((r["vec_id"] in {i for i, _ in want[r["query_id"]]}) for r in found)
    assert hit >= 0.9 * 300
    assert nearest(df.limit(0), df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.1]), (3, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>")
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in nearest(few, few).collect()} == {(0, 20, 1), (20, 0, 1)}


def test_nearest_gives_all_of_few_vectors(spark):
    draw = np.random.default_rng(12)
    rows = {i: v.tolist() for i, v in enumerate(draw.normal(size=(20, 64)))}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    found = {}
    for r in nearest(df, df).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert found == {q: [i for i, _ in best] for q, best in brute_nearest(rows, rows, 20).items()}
    assert all(len(best) == 19 for best in found.values())


def test_recall_with_skewed_norms(spark):
    draw = np.random.default_rng(13)
    unit = draw.normal(size=(3000, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    for norms in (np.where(np.arange(3000) == 5, 100.0, 1.0), draw.lognormal(size=3000)):
        x = unit * norms[:, None]
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        asked = range(0, 3000, 20)
        found = {}
        for r in nearest(df, df.where("vec_id % 20 = 0")).collect():
            found.setdefault(r["query_id"], set()).add(r["vec_id"])
        scores = x @ x.T
        np.fill_diagonal(scores, -np.inf)
        hit = [len(found.get(q, set()) & set(np.argsort(-scores[q])[:20].tolist())) for q in asked]
        print("recall", sum(hit) / 3000)
        assert sum(hit) > 0.93 * 3000 and all(len(found[q]) == 20 for q in asked)


def test_sample_is_bounded_with_repeated_ids(spark):
    rows = spark.range(40000).select((F.col("id") % 20).alias("doc_id"), F.lit("a b").alias("text"), F.lit("xx").alias("lang"))
    sample, counts = class_sample(rows, "doc_id", "lang", 1000)
    assert counts == {"xx": 40000} and sorted(r["doc_id"] for r in sample.collect()) == list(range(20))
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("xx").alias("lang"))
    again = class_sample(rows.union(rows), "doc_id", "lang", 500)[0].collect()
    assert 400 < len(again) < 600 and len(set(again)) == len(again)
