"""The registered queries on the smallest tables, against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from laplake.llm.queries import ORACLES, QUERIES
from laplake.llm.tokens import ByteTokenizer, vocabulary_path
from test_periodic_runs import brute_runs, collapsed
from test_texts import blank, brute_base

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{TINY}/documents.parquet").collect()
    return {r["doc_id"]: r for r in rows}


@pytest.fixture(scope="module")
def ids(docs):
    library = ByteTokenizer(vocabulary_path()).library
    return {i: library.encode(r["text"] or "", add_special_tokens=False).ids for i, r in docs.items()}


def rows_of(spark, name):
    return QUERIES[name](spark, TINY).collect()


def fold(doc_id, of):
    return zlib.crc32(str(doc_id).encode()) % of


def crc(values):
    return zlib.crc32(np.array(values, dtype="<u4").tobytes())


def test_names():
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{n}" for n in range(1, 14)]
    assert set(ORACLES) <= set(QUERIES)


def test_language_model_scores(spark, docs):
    found = {r["doc_id"]: r for r in rows_of(spark, "op2_lm_score")}
    want = brute_base([(i, r["text"]) for i, r in docs.items()], lambda i: fold(i, 7) != 2)
    assert set(found) == set(want)
    for i, (n, known, total, base) in want.items():
        r = found[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, fold(i, 7) == 2)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] < 0
    held = [r for r in found.values() if r["held_out"]]
    size = sum(len(" ".join(blank(docs[r["doc_id"]]["text"])).encode()) + 1 for r in held)
    assert -sum(r["score"] for r in held) * np.log2(10) / size < 3.2


def test_packed_pieces(spark, ids):
    found = rows_of(spark, "op3_packing")
    for i, own in ids.items():
        whole, at = [*own, 1], 0
        for r in sorted((r for r in found if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(whole)
            assert r["ids_crc32"] == crc(whole[at:at + r["length"]])
            at += r["length"]
        assert at == len(whole)
    total = Counter()
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == total[r["sequence_id"]]
        total[r["sequence_id"]] += r["length"]
    assert all(n <= 2048 and n & (n - 1) == 0 for n in total.values())


def test_token_counts(spark, docs, ids):
    for r in rows_of(spark, "op4_token_counts"):
        assert r["n_tokens"] == len(ids[r["doc_id"]]) and r["over_limit"] == (r["n_tokens"] > 1024)
        assert r["n_bytes"] == len((docs[r["doc_id"]]["text"] or "").encode())


def test_token_files(spark, ids):
    found, start = {r["doc_id"]: r for r in rows_of(spark, "op8_token_files")}, 0
    assert set(found) == set(ids)
    for i in sorted(ids):
        r, whole = found[i], [*ids[i], 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(whole), crc(whole))
        start += len(whole)


def test_nearest_vectors(spark):
    rows = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in spark.read.parquet(f"{TINY}/embeddings.parquet").collect()}
    found, hit, total = {}, 0, 0
    for r in rows_of(spark, "op7_nearest"):
        found.setdefault(r["query_id"], []).append(r)
        assert abs(r["score"] - rows[r["query_id"]] @ rows[r["vec_id"]]) < 1e-12
    assert set(found) == {i for i in rows if i % 20 == 0}
    for q, best in found.items():
        want = sorted((-(rows[q] @ v), i) for i, v in rows.items() if i != q)[:20]
        best = sorted(best, key=lambda r: r["rank"])
        assert [r["rank"] for r in best] == list(range(1, len(want) + 1))
        assert [(-r["score"], r["vec_id"]) for r in best] == sorted((-r["score"], r["vec_id"]) for r in best)
        hit += len({i for _, i in want} & {r["vec_id"] for r in best})
        total += len(want)
    assert hit >= 0.9 * total


def test_languages_and_quality(spark, docs):
    found = rows_of(spark, "op9_language_id")
    assert {r["doc_id"] for r in found} == set(docs)
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (fold(r["doc_id"], 3) == 1) for r in found)
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) > 0.9 * len(held)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{TINY}/labels.parquet").collect()}
    scored = [r for r in rows_of(spark, "op10_quality") if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in scored) > 0.85 * len(scored)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in scored)


def test_pipeline_is_its_stages(spark, docs):
    from laplake.llm.near_dedup import near_duplicates
    rows = spark.read.parquet(f"{TINY}/documents.parquet")
    steps, current = {}, rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = spark.createDataFrame(stage(spark, current, TINY).collect(), rows.schema)
        assert current.columns == rows.columns
        steps[name] = {r["doc_id"] for r in current.collect()}
    kept = spark.createDataFrame([r for r in docs.values() if r["doc_id"] in steps["quality"]], rows.schema)
    classes = near_duplicates(kept).collect()
    assert steps["near_dedup"] == {r["doc_id"] for r in classes if r["kept"]}
    assert all(r["component_id"] in steps["near_dedup"] for r in classes)
    pieces = corpus_pipeline.run(spark, TINY).collect()
    assert {r["doc_id"] for r in pieces} == steps["decontaminate"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{TINY}/labels.parquet").collect()}
    good = [i for i in docs if labels.get(i) == 1]
    assert len([i for i in good if i in steps["quality"]]) > 0.95 * len(good)
    empty = spark.createDataFrame([], rows.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, TINY).count() == 0, name


def test_stages_keep_columns_of_any_name(spark, docs):
    from pyspark.sql import functions as F
    names = ["_score", "_lang", "found_lang", "lang_score", "quality_score", "Contamination", "kept", "hub"]
    rows = spark.read.parquet(f"{TINY}/documents.parquet").withColumns(
        {name: F.concat(F.lit(name), F.col("doc_id").cast("string")) for name in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, TINY)
        assert out.columns == rows.columns
        found = out.collect()
        assert found and all(r[name] == f"{name}{r['doc_id']}" for r in found for name in names)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_periodic_runs(spark, docs):
    found = {r["doc_id"]: r for r in rows_of(spark, "op11_periodic_runs")}
    assert set(found) == set(docs)
    changed = 0
    for i, row in docs.items():
        words, h = re.findall(r"[^\x20\x09-\x0D]+", row["text"] or ""), zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
            changed += 1
        runs, r = brute_runs(words), found[i]
        best = min(runs, key=lambda v: (-v[1], v[0], v[2]), default=(None,) * 3)
        milli = None if not runs else 1000 * best[1] // best[2]
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(runs), *best, milli)
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{p}\n" for s, n, p in runs))
        assert r["collapsed_sha256"] == sha(collapsed(words, runs))
    assert changed > 10 and sum(r["n_runs"] > 0 for r in found.values()) > 5
