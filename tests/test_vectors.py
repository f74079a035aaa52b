import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from laplake.operators import vectors
from laplake.operators.vector_index import VectorIndex
from laplake.plans.fixtures import RaceData
from laplake.plans.jobs import index_races
from laplake.sinks.tables import VersionedTable


def _letter_counter():
    """Letter counts: a deterministic stand-in for an embedding service."""

    def letters(texts):
        return [[float(t.lower().count(chr(97 + i))) for i in range(26)] for t in texts]

    return letters


letters = _letter_counter()


def _brute(corpus, queries, k):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    names = [r["id"] for r in corpus]
    scores = np.round(unit(np.array([r["embedding"] for r in queries], float))
                      @ unit(np.array([r["embedding"] for r in corpus], float)).T, 6)
    out = []
    for at, q in enumerate(queries):
        best = sorted(range(len(names)), key=lambda i: (-scores[at, i], names[i]))[:k]
        out += [(str(q["query_id"]), rank, names[i]) for rank, i in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [3, 2000])
def test_top_k_equals_brute_force(spark, block):
    corpus = RaceData(spark, SMALL).vectors.repartition(5)
    queries = vectors.mean_vectors(corpus, "driver_number")
    found = vectors.top_k(corpus, queries, 4, block).select("query_id", "rank", "id").collect()
    assert sorted(map(tuple, found)) == _brute(corpus.collect(), queries.collect(), 4)


def test_ties_go_to_the_lowest_id(spark):
    corpus = spark.createDataFrame([(f"v{i}", [1.0, 0.0]) for i in range(9)] + [("z", None), ("zero", [0.0, 0.0])],
                                   "id string, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, embedding array<double>")
    found = vectors.top_k(corpus, queries, 3).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in found] == [("v0", 1.0), ("v1", 1.0), ("v2", 1.0)]
    assert tuple(vectors.score_range(corpus, queries).first()) == ("q", 10, 0.0, 1.0)


def test_no_match_text(spark):
    corpus = spark.createDataFrame([("a", 2023, 1, "SOFT", [1.0], "doc")],
                                   "id string, year int, driver_number int, tyre_compound string, "
                                   "embedding array<float>, document string")
    queries = spark.createDataFrame([("q", [1.0])], "query_id string, embedding array<double>")
    hits = vectors.top_k(vectors.filter_vectors(corpus, year=2024), queries)
    assert vectors.retrieval_context(hits, queries).first()["context"] == "No similar historical situations found."
    hits = vectors.top_k(vectors.filter_vectors(corpus, year=0, compound=""), queries)
    assert vectors.retrieval_context(hits, queries).first()["context"] == (
        "Relevant historical F1 situations:\n\n1. [similarity: 1.000] doc")


def test_no_queries(spark):
    corpus = spark.createDataFrame([("a", [1.0])], "id string, embedding array<float>")
    queries = spark.createDataFrame([], "query_id string, embedding array<double>")
    assert vectors.top_k(corpus, queries).count() == 0
    assert vectors.score_range(corpus, queries).count() == 0


def test_encoder_gets_small_batches(spark):
    def counting(texts):
        assert len(texts) <= 8
        return [[float(len(texts)), 1.0] for _ in texts]

    docs = spark.range(50).select(F.col("id").cast("string").alias("document")).coalesce(1)
    found = vectors.embed_documents(docs, counting, batch=8).collect()
    assert len(found) == 50 and sum(1 for r in found if r["embedding"][0] == 2.0) == 2


def test_index_keeps_the_last_version(spark, tmp_path):
    data = RaceData(spark, SMALL)
    table = VersionedTable(spark, str(tmp_path / "index"), ["id"])
    features = data.race_features
    index_races(features, letters, table, 0)
    found = index_races(features.withColumn("tyre_compound", F.lit("WET")), letters, table, 1)
    assert found.count() == features.count()
    assert found.select("tyre_compound").distinct().collect()[0][0] == "WET"
    row = found.first()
    assert row["embedding"] == letters([row["document"]])[0]
    index_races(features.limit(0), letters, table, 2)
    assert table.latest().count() == features.count()
    table.merge(3)
    assert table.versions() == [3] and table.all().count() == features.count()


def test_index_runs_merge_their_versions(spark, tmp_path):
    features = RaceData(spark, SMALL).race_features.where("driver_number < 3")
    table = VersionedTable(spark, str(tmp_path / "index"), ["id"])
    for name, versions in (("SOFT", [0]), ("HARD", [0, 1]), ("WET", [3]), ("SOFT", [3, 4])):
        found = index_races(features.withColumn("tyre_compound", F.lit(name)), letters, table, merge_every=3)
        assert table.versions() == versions and found.count() == features.count()
        assert {r[0] for r in found.select("tyre_compound").distinct().collect()} == {name}


def test_ragged_vectors_and_null_components_are_no_candidates(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.0, 0.0]), ("c", [None, 1.0]), ("d", [1.0, 0.0, 0.0, 1.0, 0.0]), ("e", []), ("f", None)]
    corpus = spark.createDataFrame(rows, "id string, embedding array<float>").coalesce(1)
    queries = spark.createDataFrame([("q", [2.0, 0.0]), ("r", [1.0, 0.0, 0.0, 0.0])], "query_id string, embedding array<double>")
    assert [(r["query_id"], r["id"]) for r in vectors.top_k(corpus, queries, 3).collect()] == [("q", "a")]
    assert [tuple(r) for r in vectors.score_range(corpus, queries).collect()] == [("q", 1, 1.0, 1.0)]


def test_copies_of_one_vector_cost_k_rows(spark):
    corpus = spark.range(3000).select(
        F.format_string("v%05d", "id").alias("id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    queries = spark.range(300).select(F.col("id").alias("query_id"), F.array(F.lit(2.0), F.lit(1.0)).alias("embedding"))
    found = vectors.top_k(corpus, queries, 2, block=70, part=500).select("query_id", "rank", "id").collect()
    assert {(r["rank"], r["id"]) for r in found} == {(1, "v00000"), (2, "v00001")} and len(found) == 600


def test_components_that_are_no_numbers_are_no_candidates(spark):
    nan, inf = float("nan"), float("inf")
    corpus = spark.createDataFrame([("a", [nan, 1.0]), ("b", [inf, 1.0]), ("c", [1.0, 1.0])], "id string, embedding array<float>")
    queries = spark.createDataFrame([("q", [2.0, 0.0]), ("r", [nan, 0.0])], "query_id string, embedding array<double>")
    for block in (1, 10):
        assert [(r["query_id"], r["id"]) for r in vectors.top_k(corpus, queries, 3, block=block).collect()] == [("q", "c")]
        assert [tuple(r)[:2] for r in vectors.score_range(corpus, queries, block=block).collect()] == [("q", 1)]


def test_few_queries_leave_the_corpus_where_it_is(spark):
    corpus = spark.range(1000).select(
        F.format_string("v%05d", "id").alias("id"), F.array(F.sin("id"), F.cos("id"), F.lit(0.5)).alias("embedding"),
        F.col("id").alias("place")).repartition(7)
    queries = corpus.where("place < 20").select(F.col("id").alias("query_id"), "embedding")
    few, many = vectors.top_k(corpus, queries, 4), vectors.top_k(corpus, queries, 4, block=3, part=100)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    assert "FlatMapCoGroups" not in few._jdf.queryExecution().executedPlan().toString()


def _clustered(spark, number=3000, dimension=16):
    draw = np.random.default_rng(4)
    middles = draw.normal(size=(40, dimension))
    rows = [(f"v{i:05d}", (middles[i % 40] + draw.normal(size=dimension) * 0.25).tolist(), i) for i in range(number)]
    rows += [("null", None, -1), ("short", [1.0, 2.0], -2), ("nan", [float("nan")] * dimension, -3), ("zero", [0.0] * dimension, -4)]
    return spark.createDataFrame(rows, "id string, embedding array<double>, place long").repartition(4)


def _files_read(df):
    plan = df.select("id")._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    leaves = plan.collectLeaves()
    return leaves.head().metrics().get("numFiles").get().value()


def test_inverted_lists(spark, tmp_path):
    corpus = _clustered(spark)
    index = VectorIndex.build(corpus, str(tmp_path / "index"), lists=40, sample=1500)
    assert sorted(map(str, index.rows().drop("list").collect())) == sorted(map(str, corpus.collect()))
    queries = corpus.where("place % 50 = 0 OR place = -2").select(F.col("id").alias("query_id"), "embedding")
    want = {tuple(r) for r in vectors.top_k(corpus, queries, 10).collect()}
    exact = {tuple(r) for r in index.search(queries, 10, probes=2, exact=True).collect()}
    assert exact == want
    routed = {(r["query_id"], r["id"]) for r in index.search(queries, 10, probes=4).collect()}
    assert len(routed & {(r[0], r[2]) for r in want}) >= 0.9 * len(want)
    # Files of other lists are not opened.
    assert _files_read(index.lists_of(index.numbers[:4])) <= 4 * _files_read(index.rows()) / len(index.numbers) + 4
    again = VectorIndex(spark, index.path)
    assert {tuple(r) for r in again.search(queries, 10, probes=3, exact=True, part=20).collect()} == want


def test_an_index_of_nothing(spark, tmp_path):
    corpus = _clustered(spark, 10)
    queries = corpus.select(F.col("id").alias("query_id"), "embedding")
    index = VectorIndex.build(corpus.limit(0), str(tmp_path / "none"))
    assert index.search(queries, 3, exact=True).count() == 0
    index = VectorIndex.build(corpus.where("place = -2"), str(tmp_path / "one"))
    assert [r["id"] for r in index.search(queries, 3, exact=True).collect()] == ["short"]
    assert index.search(queries.limit(0), 3).count() == 0


def test_questions_as_text(spark):
    corpus = vectors.embed_documents(spark.createDataFrame(
        [("a", 2023, "aab", 1), ("b", 2024, "zz", 2), ("c", 2024, "ab", 3)], "id string, year int, document string, other int"), letters)
    asked = spark.createDataFrame([("1", "zzz"), ("2", ""), ("3", None), ("4", "baa")], "query_id string, question string")
    found = vectors.search_texts(corpus, asked, letters, k=1)
    assert sorted((r["query_id"], r["id"], r["document"]) for r in found.collect()) == [("1", "b", "zz"), ("4", "a", "aab")]
    found = vectors.search_texts(corpus, asked, letters, k=1, year=2024)
    context = {r["query_id"]: r["context"] for r in vectors.retrieval_context(found, asked).collect()}
    assert context["4"].endswith("1. [similarity: 0.949] ab") and context["2"] == context["3"] == (
        "No similar historical situations found.")


def _shuffled(spark, action):
    """Rows that all stages of an action write for a shuffle."""
    before = {(s.stageId(), s.attemptId()) for s in _stages(spark.sparkContext)}
    action()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(s.shuffleWriteRecords() for s in _stages(spark.sparkContext) if (s.stageId(), s.attemptId()) not in before)


def _stages(context):
    quantiles = context._gateway.new_array(context._jvm.double, 0)
    found = context._jsc.sc().statusStore().stageList(None, False, False, quantiles, None)
    return [found.apply(i) for i in range(found.length())]


def _circle(spark, number, name, turn):
    """Unit vectors that all differ."""
    return spark.range(number).select(
        F.format_string("%05d", F.col("id")).alias(name), F.array(F.cos(F.col("id") * turn), F.sin(F.col("id") * turn)).alias("embedding"))


def test_many_queries_do_not_copy_the_corpus(spark):
    """A corpus in 20 parts and 30 blocks of queries: no row is shuffled once per block or part."""
    corpus, queries = _circle(spark, 2000, "id", 0.001), _circle(spark, 900, "query_id", 0.0017)
    found = []
    moved = _shuffled(spark, lambda: found.extend(vectors.top_k(corpus, queries, 2, block=30, part=100).collect()))
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in found) == _brute(corpus.collect(), queries.collect(), 2)
    assert moved < 20 * (2000 + 900)


def test_repeated_vectors_are_searched_once(spark):
    """Copies of a few vectors in the corpus and among the queries, one query_id with two vectors, and what is no vector."""
    some = [[1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [1.0, 2.0]]
    rows = [(f"v{i:04d}", some[i % 4], i) for i in range(400)] + [("null", None, -1), ("gap", [None, 1.0], -2), ("nan", [float("nan"), 1.0], -3)]
    corpus = spark.createDataFrame(rows, "id string, embedding array<float>, place int").repartition(5)
    asked = [(f"q{i:03d}", some[i % 2]) for i in range(200)] + [("q000", [0.0, 1.0]), ("none", None), ("odd", [1.0])]
    queries = spark.createDataFrame(asked, "query_id string, embedding array<double>").repartition(3)
    for block in (1, 50, 1000):
        found = sorted(map(tuple, vectors.top_k(corpus, queries, 3, block=block).select("query_id", "rank", "id", "place").collect()))
        assert found[:3] == [("q000", i, f"v{j:04d}", j) for i, j in ((1, 0), (2, 2), (3, 4))]
        want = [(f"q{i:03d}", rank, f"v{i % 2 + 4 * rank - 4:04d}", i % 2 + 4 * rank - 4) for i in range(1, 200) for rank in (1, 2, 3)]
        assert found[3:] == want
