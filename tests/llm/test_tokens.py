import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from laplake.llm.frames import staged
from laplake.llm.packing import Pool, best_filling, pack, sequences
from laplake.llm.token_counts import PairMerger, TokenCounter, count_tokens
from laplake.llm.token_files import (
    CodeBook,
    canonical_codes,
    code_lengths,
    read_token_files,
    write_token_files,
)
from laplake.llm.tokens import ByteTokenizer, vocabulary_path
from laplake.session import new_folder

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PARTS = [*"ab 1'sStmdrevl\n\t  \r!.,é½中　 x́_-", "<|endoftext|>", "'ll", "'re ", " '", "𝒳", "😀", "\x1c", "\x85", "the", " of"]
AWKWARD = [None, "", " ", "\n", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "x" * 5000, " " * 700 + "a", "it's 'll don't", "é" * 40]


@pytest.fixture(scope="module")
def known():
    return ByteTokenizer(vocabulary_path())


def expected(known, texts):
    return [known.library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_ids_equal_the_librarys(known):
    draw = random.Random(1)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 40))) for _ in range(4000)] + AWKWARD
    ids, bounds = known.column(pa.array(texts))
    found = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert found == expected(known, texts)


def test_slices_of_a_column_and_a_small_word_table(known, monkeypatch):
    import laplake.llm.tokens as tokens
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    column = pa.array(["one two", "three four five", None, "six"]).slice(1)
    ids, bounds = known.column(column)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == expected(known, column.to_pylist())


def test_counts_by_merging(known):
    counter = TokenCounter(vocabulary_path())
    draw = random.Random(2)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 30))) for _ in range(1500)] + AWKWARD
    assert counter.column(pa.array(texts)).tolist() == [len(x) for x in expected(known, texts)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdefgh", min_size=1, max_size=60))
def test_merging_one_word(known_word):
    merger = _merger()
    assert merger[0].count(known_word.encode()) == len(merger[1].model.tokenize(known_word))


def _merger(held=[]):  # noqa: B006
    if not held:
        tokenizer = ByteTokenizer(vocabulary_path())
        held.append((PairMerger(tokenizer.spec), tokenizer.library))
    return held[0]


def test_count_tokens_of_a_table(spark, known):
    texts = [*AWKWARD, "a b", "a b"]
    rows = [(i if i else None, t, "own") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = count_tokens(df).collect()
    assert sorted((r["n_tokens"], r["n_bytes"]) for r in found) == sorted(
        (len(x), len((t or "").encode())) for x, t in zip(expected(known, texts), texts, strict=True))
    assert count_tokens(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        import public_tokenizers
        TokenCounter(public_tokenizers.path("word_bpe_49k.json"))


def test_other_vocabularies_go_to_the_library():
    import public_tokenizers
    other = ByteTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert not other.plain
    ids, bounds = other.column(pa.array(["Hello there", None]))
    assert ids[:bounds[1]].tolist() == other.library.encode("Hello there", add_special_tokens=False).ids
    assert bounds[2] == bounds[1]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), min_size=1, max_size=8), st.integers(1, 64))
def test_filling_is_the_closest(counts, capacity):
    reach = {0}
    for length, n in counts.items():
        reach = {r + k * length for r in reach for k in range(n + 1) if r + k * length <= capacity}
    chosen = best_filling(sorted(counts, reverse=True), counts, capacity)
    assert all(m <= counts[n] for n, m in chosen.items())
    assert sum(n * m for n, m in chosen.items()) == max(reach)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=60), st.integers(0, 200))
def test_pool_places_every_id_once(lengths, low):
    pool, seen = Pool(64), []
    for i, n in enumerate(lengths):
        pool.put(n, (i, 0, np.arange(n)))
    windows = [*pool.windows(low), *pool.windows(0)]
    assert all(sum(n for n, _ in w) == 64 for w in windows)
    rest = list(pool.rest())
    assert all(s & (s - 1) == 0 for s in (sum(n for n, _ in w) for w in rest))
    for window in [*windows, *rest]:
        for n, (i, start, ids) in window:
            assert ids.tolist() == list(range(start, start + n))
            seen += [(i, k) for k in ids.tolist()]
    assert sorted(seen) == [(i, k) for i, n in enumerate(lengths) for k in range(n)]


@pytest.mark.parametrize("pool", [1, 2048])
def test_pack_gives_every_id_once(spark, known, pool):
    draw = random.Random(3)
    texts = [*AWKWARD, *(" ".join(draw.choice(["alpha", "be", "gam ma"]) for _ in range(draw.randint(0, 900))) for _ in range(40))]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, start int").repartition(3)
    pieces = staged(pack(df, capacity=256, pool_windows=pool), "test-pieces")
    rows = pieces.orderBy("doc_id", "start").collect()
    for i, ids in enumerate(expected(known, texts)):
        mine = [r for r in rows if r["doc_id"] == i]
        assert b"".join(bytes(r["ids"]) for r in mine) == np.array([*ids, 1], dtype="<u4").tobytes()
        assert {r["doc_tokens"] for r in mine} == {len(ids) + 1}
        at = 0
        for r in mine:
            assert r["start"] == at and len(r["ids"]) == 4 * r["length"]
            at += r["length"]
    for r in sequences(pieces).collect():
        assert r["length"] == 256 or r["length"] & (r["length"] - 1) == 0
        parts = sorted((p["offset"], bytes(p["ids"])) for p in rows if p["sequence_id"] == r["sequence_id"])
        assert bytes(r["ids"]) == b"".join(p for _, p in parts)
        assert [o for o, _ in parts] == [sum(len(p) for _, p in parts[:k]) // 4 for k in range(len(parts))]
    assert pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pack(df, capacity=100)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=60), st.integers(6, 12))
def test_code_lengths(counts, longest):
    lengths = code_lengths(np.array(counts), longest).astype(int)
    used = [i for i, c in enumerate(counts) if c]
    assert all((lengths[i] > 0) == (c > 0) for i, c in enumerate(counts))
    assert lengths.max(initial=0) <= max(longest, 1)
    if len(used) > 1:
        assert sum(2.0 ** -lengths[i] for i in used) == 1.0
        # Without the limit it is Huffman's code.
        import heapq
        heap, cost = sorted(counts[i] for i in used), 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a + b
            heapq.heappush(heap, a + b)
        assert sum(counts[i] * n for i, n in enumerate(code_lengths(np.array(counts), 60).astype(int))) == cost
    words = sorted(format(int(c), f"0{n}b") for c, n in zip(canonical_codes(lengths), lengths, strict=True) if n)
    assert not any(b.startswith(a) for a, b in zip(words, words[1:], strict=False))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=1200))
def test_code_round_trip(ids):
    values = np.array(ids, dtype=np.int64)
    book = CodeBook(code_lengths(np.bincount(values, minlength=1)))
    words, offsets = book.encode(values, 64)
    assert book.decode(words, offsets, len(values), 64).tolist() == ids


def test_token_files_round_trip(spark, known):
    draw = random.Random(4)
    texts = [*AWKWARD, *("".join(draw.choice(PARTS) for _ in range(draw.randint(0, 900))) for _ in range(60))]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(4)
    path = new_folder(spark, "test-files")
    write_token_files(df, path)
    found = {r["doc_id"]: r for r in read_token_files(spark, path).collect()}
    start = 0
    for i, ids in enumerate(expected(known, texts)):
        want = np.array([*ids, 0], dtype="<u4")
        assert (found[i]["start"], found[i]["n_tokens"], zlib.crc32(found[i]["ids"])) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)


def test_token_files_of_odd_tables(spark):
    schema = "doc_id long, text string"
    empty = new_folder(spark, "test-files")
    write_token_files(spark.createDataFrame([], schema), empty)
    assert read_token_files(spark, empty).count() == 0
    path = new_folder(spark, "test-files")
    write_token_files(spark.createDataFrame([(5, "same"), (5, "same"), (None, None), (1, "")], schema), path)
    found = [(r["doc_id"], r["start"], r["n_tokens"]) for r in read_token_files(spark, path).orderBy("start").collect()]
    assert found == [(None, 0, 1), (1, 1, 1), (5, 2, 2), (5, 4, 2)]
