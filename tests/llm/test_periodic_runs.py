import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import laplake.llm.periodic_runs as module
from laplake.llm.periodic_runs import extensions, find_runs, grammar, periodic_runs

def brute_runs(words, exponent=4, length=6):
    """Every maximal stretch of equal words p apart, with no smaller period."""
    n, out = len(words), []
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            size = j - i + p
            if j > i and size >= max(length, exponent * p) and not any(
                    all(words[k] == words[k + q] for k in range(i, i + size - q)) for q in range(1, p)):
                out.append((i, size, p))
            i = max(i + 1, j)
    return sorted(out)


def collapsed(words, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def some_texts(seed, number):
    draw = random.Random(seed)
    out = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 7, list("ab" * 4), list("aab" * 20), list("abababab" "cababababc" * 5)]
    for _ in range(number):
        alphabet = [f"w{k}" for k in range(draw.choice([1, 2, 2, 3, 30]))]
        words = [draw.choice(alphabet) for _ in range(draw.randint(0, 60))]
        for _ in range(draw.randint(0, 3)):
            unit = [draw.choice(alphabet) for _ in range(draw.randint(1, 9))]
            at = draw.randint(0, len(words))
            words[at:at] = (unit * draw.randint(2, 8))[:draw.randint(4, 50)]
        out.append(words)
    return out


def numbers_of(texts):
    known = {}
    flat = [known.setdefault(w, len(known)) for t in texts for w in t]
    return np.array(flat, dtype=np.int64), np.cumsum([0, *map(len, texts)])


@pytest.mark.parametrize("exponent", [2, 3, 4])
def test_runs_equal_brute_force(exponent):
    texts = some_texts(1, 250)
    found = [[] for _ in texts]
    for t, *run in zip(*find_runs(*numbers_of(texts), exponent, 6), strict=True):
        found[t].append(tuple(run))
    assert [sorted(f) for f in found] == [brute_runs(t, exponent) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=4), st.randoms())
def test_extensions(texts, draw):
    joined, bounds = [0], []
    for i, t in enumerate(texts):
        bounds.append((len(joined), len(joined) + len(t)))
        joined += [v + len(texts) + 1 for v in t] + [i + 1]
    levels = grammar(np.array(joined), len(texts) + 1)
    assert len(levels[-1].symbols) <= 2 * len(texts) + 1
    places = [k for a, b in bounds for k in range(a, b)]
    pairs = [(i, j) for i in places for j in places if i < j][:400]
    if not pairs:
        return
    x, y = (np.array(v) for v in zip(*pairs, strict=True))

    def brute(i, j, step):
        n = 0
        while joined[i + n * step] == joined[j + n * step]:
            n += 1
        return n

    assert extensions(levels, x, y).tolist() == [brute(i, j, 1) for i, j in pairs]
    last = len(joined) - 1
    behind = extensions([v.mirrored() for v in levels], last - x, last - y)
    assert behind.tolist() == [brute(i, j, -1) for i, j in pairs]


def test_long_texts_and_small_grids(monkeypatch):
    draw = random.Random(4)
    unit = [f"u{draw.randrange(50)}" for _ in range(700)]
    texts = [["x"] * 3000, [f"v{draw.randrange(400)}" for _ in range(3000)] + unit * 5 + unit[:99], ["a", "b"] * 1500]
    whole = [v.tolist() for v in find_runs(*numbers_of(texts))]
    assert [r for r in zip(*whole, strict=True) if r[2] > 100] == [(0, 0, 3000, 1), (1, 3000, 3599, 700), (2, 0, 3000, 2)]
    monkeypatch.setattr(module, "GRID", 100)
    assert [v.tolist() for v in find_runs(*numbers_of(texts))] == whole


def test_documents(spark):
    texts = [" ".join(t) for t in some_texts(2, 60)] + [None, "", " \n\t", "a\x0ba\x0ca\ra  a\ta a", "é é é é é é é 中 中 中 中 中 中"]
    rows = [(i, t, "x", f"r{i}") for i, t in enumerate(texts)] + [(None, "b b b b b b b", "y", "none"), (3, texts[3], "x", "r3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Collapsed string, other string").repartition(3)
    found = periodic_runs(df).collect()
    assert len(found) == len(rows)
    for r in found:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        want = brute_runs(words)
        assert [tuple(v) for v in r["runs"]] == want
        assert r["collapsed"] == collapsed(words, want)
        assert r["other"] == ("none" if r["doc_id"] is None else f"r{r['doc_id']}")
    assert periodic_runs(df.limit(0)).count() == 0
    assert periodic_runs(df.limit(0)).columns == ["doc_id", "text", "other", "runs", "collapsed"]
