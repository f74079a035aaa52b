import hashlib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from laplake.llm.exact_dedup import exact_duplicates, retain
from laplake.session import new_folder

SCHEMA = "Keep_id string, doc_id long, text string, n int, file string"


def brute(rows):
    groups, out = {}, []
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(i)
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        least = min(known, default=None)
        first = True
        for i in ids:
            out.append((i, least, len(ids), i == least and first))
            first = first and i != least
    return sorted(out, key=str)


def some_rows(number=300):
    draw = random.Random(3)
    texts = ["", None, " ", "\n\t", "a b", "a  b", "a\x0bb", " a b", "A b", "é 中", "x" * 30000, "x" * 29999 + "y"]
    texts += [f"text {k} " + "word " * k for k in range(40)]
    rows = [(draw.randint(0, 100000), draw.choice(texts)) for _ in range(number)]
    rows += [(None, "a b"), (None, "nobody's"), (None, "nobody's"), (7, "twice"), (7, "twice"), (8, "twice")]
    return rows + [(200000 + k, "hot text") for k in range(number)]


def written(spark, rows, path=None, files=5):
    path = path or new_folder(spark, "test-docs")
    df = spark.createDataFrame([("c", i, t, 1, "f") for i, t in rows], SCHEMA)
    df.repartition(files, F.xxhash64("doc_id", F.rand(1))).write.mode("append").parquet(path)
    return path


def found(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"files_per_batch": 1, "hot_rows": 10}, {"hot_rows": 1}])
def test_equal_brute_force(spark, options):
    rows = some_rows()
    path = written(spark, rows)
    df = exact_duplicates(spark, path, **options)
    assert found(df) == brute(rows)
    assert {r["digest"].hex() for r in df.collect()} == {
        hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest() for _, t in rows}


@pytest.mark.parametrize("hot_rows", [10, 10000])
def test_texts_are_compared_where_digests_agree(spark, hot_rows):
    rows = some_rows(150)
    weak = exact_duplicates(
        spark, written(spark, rows), digest=lambda text: F.encode(F.substring(F.sha2(text, 256), 1, 1), "utf-8"),
        hot_rows=hot_rows)
    assert found(weak) == brute(rows)


def test_state_is_kept_between_runs(spark):
    first, more = some_rows(40), [(-5, "hot text"), (1, "new"), (2, "new")]
    path, state = written(spark, first), new_folder(spark, "state")
    assert found(exact_duplicates(spark, path, state=state)) == brute(first)
    written(spark, more, path, files=1)
    assert found(exact_duplicates(spark, path, state=state)) == brute(first + more)
    read = [int(f) for f in os.listdir(f"{state.removeprefix('file:')}/commits") if f.isdigit()]
    assert sorted(read) == [0, 1]
    entries = retain(spark, path, state).collect()  # nothing new: the state as it is
    assert len(entries) == len({(r[1]) for r in first + more} - {None, " ", "\n\t", "a  b", "a\x0bb"} | {"", " "})


def test_empty_tables_and_single_files(spark):
    path = new_folder(spark, "empty")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    assert exact_duplicates(spark, path).count() == 0
    single = "/root/testdata/sf0.001/documents.parquet"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(single).collect()]
    assert found(exact_duplicates(spark, single)) == brute(rows)


def test_provider_setting_is_put_back(spark):
    key = "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB"
    before = spark.conf.get(key, None)
    exact_duplicates(spark, "/root/testdata/sf0.001/documents.parquet")
    assert spark.conf.get(key, None) == before
