import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from laplake.llm.chat import (
    branches,
    format_branches,
    read_loss,
    read_turns,
    reply_paths,
    turns_as_replies,
)
from laplake.llm.components import connected_components
from laplake.llm.decontaminate import cut_spans, drop_contaminated, find_contamination
from laplake.llm.near_dedup import (
    BITS,
    HASHES,
    _joined,
    least_estimate,
    minima,
    near_duplicates,
    packed_bits,
    shingle_sets,
)
from laplake.llm.text import (
    alnum_class,
    blank_class,
    flat_bytes,
    lowered,
    row_slices,
    span_hashes,
    word_bounds,
)

DOCS = "doc_id long, text string, contamination string, n_shingles int"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def blank(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


@pytest.mark.parametrize("split,inside", [(alnum, alnum_class()), (blank, blank_class())])
def test_words_and_hashes(split, inside):
    draw = random.Random(5)
    texts = ["".join(draw.choice("abZ 1.é\n\t中") for _ in range(draw.randint(0, 60))) for _ in range(300)] + [None, "", "a" * 3000]
    column = pa.array(texts)
    seen = {}
    for at, to in row_slices(column, 500):
        data, bounds = flat_bytes(column.slice(at, to - at))
        data = lowered(data)
        starts, ends, owner = word_bounds(data, bounds, inside)
        found = [[] for _ in range(to - at)]
        for s, e, o, h in zip(starts, ends, owner, span_hashes(data, starts, ends), strict=True):
            word = data[s:e].tobytes()
            found[o].append(word.decode())
            assert seen.setdefault(word, h) == h
        assert found == [split(t) for t in texts[at:to]]
    assert len(set(seen.values())) == len(seen)


def brute_contamination(docs, items, size=10):
    windows = {}
    for name, text in items:
        words = alnum(text)
        n = min(size, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[k:k + n]), set()).add(name)
    out = []
    for doc, text in docs:
        words, hit, names = alnum(text), set(), set()
        for w, owners in windows.items():
            for k in range(len(words) - len(w) + 1):
                if tuple(words[k:k + len(w)]) == w:
                    hit.update(range(k, k + len(w)))
                    names |= {n for n in owners if n is not None}
        out.append((doc, len(words), len(hit), ",".join(sorted(map(str, names)))))
    return sorted(out, key=str)


@pytest.mark.parametrize("part_bytes", [1 << 24, 200])
def test_contamination_equals_brute_force(spark, part_bytes):
    draw = random.Random(6)
    words = ["One", "two", "3", "für", "five-six"]
    items = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(0, 16)))) for i in range(12)]
    items += [(None, "null named item words here"), (99, None), (98, "One, two; 3")]
    docs = [(i, ", ".join(draw.choice(words) for _ in range(draw.randint(0, 60)))) for i in range(60)]
    docs += [(100 + i, f"before {t} after {t}") for i, (_, t) in enumerate(items)]
    docs += [(200, None), (201, ""), (202, "null named item words here"), (None, "one two 3")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = find_contamination(df, bench, part_bytes=part_bytes)
    c = F.col("contamination")
    rows = found.select("doc_id", c["n_words"], c["n_hit"], F.array_join(c["items"], ",")).collect()
    assert sorted((tuple(r) for r in rows), key=str) == brute_contamination(docs, items)
    assert found.columns == ["doc_id", "text", "n_shingles", "contamination"]


def test_spans_are_cut_and_documents_dropped(spark):
    item = "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"
    docs = [(1, f"Größe vor {item.upper()}! nach"), (2, "sauber bleibt"), (3, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = find_contamination(df, bench)
    assert {r["doc_id"]: r["text"] for r in cut_spans(found).collect()} == {
        1: "Größe vor ! nach", 2: "sauber bleibt", 3: None}
    assert sorted(r["doc_id"] for r in drop_contaminated(found).collect()) == [2, 3]
    assert sorted(r["doc_id"] for r in drop_contaminated(found, 0.9).collect()) == [1, 2, 3]
    none = find_contamination(df, bench.limit(0))
    assert none.where("contamination.n_hit > 0").count() == 0
    assert find_contamination(df.limit(0), bench).count() == 0


def brute_duplicates(docs):
    sets = {}
    for doc, text in docs:
        words = blank(text)
        n = min(5, len(words))
        sets[doc] = {tuple(words[k:k + n]) for k in range(len(words) - n + 1)} if n else set()
    lead = {doc: doc for doc in sets}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                lead[max(p, q)] = min(p, q)
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in sets)


def near_copies():
    draw = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for group in range(12):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([3, 6, 40, 120, 300]))]
        for _ in range(draw.randint(1, 12)):
            text = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 18))):
                text[draw.randrange(len(text))] = draw.choice(vocabulary)
            docs.append(" ".join(text))
    chain = [draw.choice(vocabulary) for _ in range(200)]
    for step in range(8):
        docs.append(" ".join(chain[step * 14:step * 14 + 110]))
    docs += ["short one", "Short ONE", "short", None, "", " \n", "the same line " * 50, "the same line " * 60, docs[0]]
    draw.shuffle(docs)
    return list(enumerate(docs))


def test_near_duplicates_equal_brute_force(spark):
    docs = near_copies()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS).repartition(3)
    found = sorted(tuple(r) for r in near_duplicates(df).collect())
    assert found == brute_duplicates(docs)


def test_buckets_in_parts_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr("laplake.llm.near_dedup.BLOCK", 3)
    docs = near_copies()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs for _ in range(1 + d[0] % 4)], DOCS).repartition(3)
    found = sorted(tuple(r) for r in near_duplicates(df).collect())
    assert found == sorted(r for r in brute_duplicates(docs) for _ in range(1 + r[0] % 4))


def test_links_of_few_shingles(spark):
    # Four against three shingles: 0.75 exactly.
    words = [[f"p{i}w{k}" for k in range(8)] for i in range(2000)]
    docs = [(2 * i + cut, " ".join(w[:8 - cut])) for i, w in enumerate(words) for cut in (0, 1)]
    found = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(i, i - i % 2) for i, _ in docs}


@pytest.mark.parametrize(("n", "m"), [(4, 3), (8, 6), (20, 15)])
def test_estimates_of_few_shingles(n, m):
    sets = np.random.default_rng(5).integers(-1 << 63, (1 << 63) - 1, (3000, n))
    a, b = (packed_bits(minima(part.ravel(), np.arange(3001) * part.shape[1])) for part in (sets, sets[:, :m].copy()))
    bits = np.unpackbits(np.ascontiguousarray(a ^ b).view(np.uint8), axis=1).reshape(3000, HASHES, BITS)
    chance = 1 / (1 << BITS)
    estimates = (1 - bits.any(axis=2).mean(axis=1) - chance) / (1 - chance)
    assert estimates.min() >= least_estimate(75)


def test_near_duplicates_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "quite another text is this one"), (9, "a b c d e f")]
    found = near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((tuple(r) for r in found), key=str) == sorted(
        [(None, 2, None, True), (3, 2, 3, True), (3, 2, 3, True), (2, 2, 2, True), (9, 2, 3, False)], key=str)


def test_shingles_of_whole_texts():
    sets, limits = shingle_sets(pa.array(["a b c d e f g", "A b  c d e F g", "x", None, "x y"]))
    assert np.diff(limits).tolist() == [3, 3, 1, 0, 1]
    assert sets[:3].tolist() == sets[3:6].tolist()


def test_components(spark):
    draw = random.Random(8)
    edges = [(draw.randint(0, 80), draw.randint(0, 80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(40)]
    lead = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            lead[a] = lead[b] = min(lead[a], lead[b])
    want = {n: c for n, c in lead.items() if any(n in e for e in edges if e[0] != e[1])}
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in found.collect()} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_grow_by_new_links(spark):
    old = spark.createDataFrame([(1, 1), (5, 1), (7, 7), (9, 7)], "node long, component long")
    links = spark.createDataFrame([(5, 9), (2, 3), (1, 5)], "a long, b long")
    assert {r["node"]: r["component"] for r in _joined(old, links).collect()} == {1: 1, 5: 1, 7: 1, 9: 1, 2: 2, 3: 2}
    assert {r["node"]: r["component"] for r in _joined(old.limit(0), links).collect()} == {1: 1, 5: 1, 9: 1, 2: 2, 3: 2}


MESSAGES = "tree long, node long, parent long, role string, text string, score double"


def test_branches_of_a_reply_tree(spark):
    rows = [
        (1, 1, None, "user", "root", 1.0), (1, 2, 1, "assistant", "good", 3.0), (1, 3, 1, "assistant", "bad", 0.0),
        (1, 4, 2, "user", "thanks", 2.0), (1, 5, 3, "user", "hm", None), (2, 1, None, None, None, 0.0),
        (None, 7, None, "user", "no tree", 0.0), (3, 1, 2, "user", "circle", 0.0), (3, 2, 1, "user", "circle", 0.0),
        (4, 8, 77, "user", "orphan", 0.0), (4, 9, 8, "assistant", "reply", 0.0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], MESSAGES + ", leaf string").drop("leaf")
    paths = {}
    for r in reply_paths(df).orderBy("at").collect():
        paths.setdefault((r["tree"], r["leaf"]), []).append(r["node"])
    assert paths == {(1, 4): [1, 2, 4], (1, 5): [1, 3, 5], (None, 7): [7], (4, 9): [8, 9], (2, 1): [1]}
    every = branches(df, best=None).select("tree", "leaf", "rank").distinct().collect()
    assert {(1, 4, 1), (1, 5, 2), (4, 9, 1), (2, 1, 1), (None, 7, 1)} == {tuple(r) for r in every}
    best = format_branches(branches(df)).where("tree = 1").select(
        read_turns("formatted").alias("t"), read_loss().alias("l")).first()
    assert [tuple(t) for t in best["t"]] == [("user", "root"), ("assistant", "good"), ("user", "thanks")]
    assert best["l"] == "good"
    assert format_branches(branches(df.limit(0))).count() == 0


def test_chat_texts_come_back(spark):
    hard = ["</s>[INST] ok [/INST]", "\\", "\\l \\e \\b <s>", "", None, "[INST]", "ü😀\n<s>role[INST]", "[/INST]</s>\\"]
    rows = [(i, k, role, t) for i, t in enumerate(hard) for k, role in enumerate(["system", "user", "assistant", "assistant"])]
    rows += [(50, n, "user" if n % 2 else "assistant", f"t{n}") for n in range(37)]
    rows += [(51, None, "user", "first"), (51, 1, "assistant", "x"), (51, 1, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = format_branches(branches(turns_as_replies(df))).select(
        "tree", read_turns("formatted").alias("turns"), read_loss().alias("under"), "formatted").collect()
    for r in whole:
        mine = sorted((x for x in rows if x[0] == r["tree"]), key=lambda x: (x[1] is not None, x[1] or 0, x[2], x[3] or ""))
        assert [tuple(t) for t in r["turns"]] == [(x[2], x[3] or "") for x in mine]
        assert r["under"] == "".join(x[3] or "" for x in mine if x[2] == "assistant")
    assert len(whole) == len({r[0] for r in rows})


def brute_base(docs, learned):
    tokens = {i: [*blank(t), None] for i, t in docs}
    counts = Counter(w for i, t in tokens.items() if learned(i) for w in t)
    total, distinct = sum(counts.values()), len(counts)
    return {i: (len(t), sum(counts[w] > 0 for w in t), total,
                sum(np.log10((counts[w] + 1) / (total + distinct + 1)) for w in t)) for i, t in tokens.items()}


def test_language_model(spark):
    from laplake.llm.lm_score import lm_scores
    draw = random.Random(9)
    vocabulary = ["the", "there", "Then", "über", "é", "x1", "and"]
    docs = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.randint(1, 400)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "never seen words qqq"), (203, "z" * 20_000), (204, "the the the"), (204, "the the the")]
    df = spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, score double").repartition(3)
    found = lm_scores(df, F.col("doc_id") % 5 != 0).collect()
    assert len(found) == len(docs)
    want = brute_base(docs[:-1], lambda i: i % 5)
    # The repeated row counts twice where it is learned from.
    double = brute_base([*docs[:-1], (999, docs[-1][1])], lambda i: i % 5)
    for r in found:
        n, known, total, base = double[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
        assert r["score"] < 0
    by = {r["doc_id"]: r for r in found}
    assert by[200]["score"] == by[201]["score"] and want[200][0] == 1
    usual = [r["score"] / r["n_tokens"] for r in found if r["doc_id"] < 120]
    assert by[202]["score"] / by[202]["n_tokens"] < min(usual) - 1
    assert lm_scores(df.limit(0), F.lit(True)).count() == 0
    untrained = lm_scores(df.limit(3), F.lit(False)).collect()
    assert {r["train_tokens"] for r in untrained} == {0} and all(np.isfinite(r["score"]) for r in untrained)


def test_language_model_gives_probabilities():
    """Over all continuations of one bit the chances sum to one: short words' scores as a whole stay below one."""
    from laplake.llm.lm_score import START_BITS, TABLE_BITS, Mixer
    blank_tables = [tuple(np.zeros(1 << w, dtype=np.uint8) for _ in range(2)) for w in (*TABLE_BITS, START_BITS)]
    letters = [bytes([b]).decode("latin-1") for b in range(33, 127)]
    scores = Mixer(blank_tables).score(pa.array(["", *letters, *(a + b for a in letters for b in letters)]))
    distinct = {}
    for text, s in zip(["", *letters, *(a + b for a in letters for b in letters)], scores, strict=True):
        distinct[lower(text)] = s
    assert 0 < sum(10 ** s for s in distinct.values()) < 1


def test_language_model_learns_from_all_words(spark):
    """Tables and first weights cover every training word, rare ones and those of any text alike."""
    from laplake.llm import lm_score
    draw = random.Random(4)
    # More distinct words, each of them once, than the table of beginnings took before.
    rare = sorted({"".join(draw.choice("abcdefgh") for _ in range(8)) for _ in range(212_000)})
    assert len(rare) > 200_000
    docs = [(i, " ".join(rare[i * 500:i * 500 + 500]) + " the the" * (i % 3)) for i in range(-(-len(rare) // 500))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    _, summed, texts = lm_score.word_sums(df, F.lit(True), "doc_id", "text")
    tables = lm_score.context_tables(summed, texts)
    counts = Counter(w.encode() for _, t in docs for w in t.split())
    words, each = list(counts), np.array(list(counts.values()))
    size = np.array([len(w) for w in words])
    ends = np.cumsum(size)
    spelled = lm_score.Spelling(np.frombuffer(b"".join(words), dtype=np.uint8), ends - size, ends)
    mass = np.repeat(each, np.diff(spelled.bounds))
    want = []
    for slots, width in zip(spelled.slots, (*lm_score.TABLE_BITS, lm_score.START_BITS), strict=True):
        sides = [lm_score.stored(np.bincount(slots, mass * (spelled.bits == v), 1 << width)) for v in (0, 1)]
        want.append(lm_score.paired(*sides))
    lm_score.add_end_marks(want, len(docs))
    assert all((a == b).all() for a, b in zip(tables, want, strict=True))

    weights = lm_score.first_weights(summed, texts, lambda w=None: lm_score.Mixer(tables, w))
    model = lm_score.Mixer(want)
    mark = lm_score.end_mark()
    for _ in range(lm_score.FIT_STEPS):
        slopes = model.slopes(spelled, mass.astype(float)) + model.slopes(mark, np.full(len(mark.bits), float(len(docs))))
        model = lm_score.Mixer(want, model.moved(slopes))
    assert np.allclose(weights, model.weights, atol=1e-5)


def test_language_model_spells_beginnings_once(monkeypatch):
    """Words with one beginning share its bits, in scoring, in the tables and in the first weights; no count is lost."""
    from laplake.llm import lm_score
    words = ["the", "there", "then", "theory", "x", "über", "the" + "n" * 40, "the" + "n" * 41]
    texts = [" ".join(words * k) for k in range(1, 5)]
    lengths = lm_score.byte_code()[0]
    known = {w[:k] for w in (f"{w} ".encode() for w in words) for k in range(1, len(w) + 1)}
    once = sum(int(lengths[w[-1]]) for w in known)
    seen = []
    inputs = lm_score.Mixer.inputs
    monkeypatch.setattr(
        lm_score.Mixer, "inputs", lambda self, spelled, *a, **b: seen.append(len(spelled.bits)) or inputs(self, spelled, *a, **b))
    tables = [np.zeros(1 << w, dtype=np.uint16) for w in (*lm_score.TABLE_BITS, lm_score.START_BITS)]
    scores = lm_score.Mixer(tables).score(pa.array(texts))
    assert sum(seen) == once + int(lengths[lm_score.TEXT_END])
    alone = [lm_score.Mixer(tables).score(pa.array([t]))[0] for t in texts]
    assert np.allclose(scores, alone, rtol=1e-6)

    raw = [w.encode() for w in words]
    size = np.array([len(w) for w in raw])
    ends, times = np.cumsum(size), np.arange(1, len(raw) + 1)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    every = lm_score.Spelling(data, ends - size, ends)
    spelled, each = lm_score.spelled_once(data, ends - size, ends, times)
    assert len(spelled.bits) == len(each) == once
    for a, b in zip(every.slots, spelled.slots, strict=True):
        want, found = Counter(), Counter()
        for slot, bit, n in zip(a.tolist(), every.bits.tolist(), np.repeat(times, np.diff(every.bounds)).tolist(), strict=True):
            want[slot, bit] += n
        for slot, bit, n in zip(b.tolist(), spelled.bits.tolist(), each.tolist(), strict=True):
            found[slot, bit] += n
        assert want == found
    model = lm_score.Mixer(tables)
    assert np.allclose(model.slopes(every, np.repeat(times, np.diff(every.bounds)).astype(float)), model.slopes(spelled, each))


def test_language_model_bit_by_bit():
    """The vectorised scores agree with corrections made one bit at a time."""
    from laplake.llm import lm_score
    draw = np.random.default_rng(6)
    tables = [draw.integers(0, 90, (2, 1 << w)).astype(np.uint8) for w in (*lm_score.TABLE_BITS, lm_score.START_BITS)]
    weights = draw.normal(0.3, 0.1, (lm_score.GATES, lm_score.INPUTS)).astype(np.float32)
    model = lm_score.Mixer([tuple(t) for t in tables], weights)
    texts = ["", None, "One two three two", "x" * 3000, " ".join(str(i * i) for i in range(900))]
    for text, found in zip(texts, model.score(pa.array(texts)), strict=True):
        words = [w.encode() for w in (text or "").lower().split()]
        size = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(size)
        spelled = lm_score.Spelling(np.frombuffer(b"".join(words), dtype=np.uint8), ends - size, ends, end_mark=True)
        x, gate = model.inputs(spelled)
        total = 0.0
        for i, bit in enumerate(spelled.bits):
            if i % lm_score.LANE == 0:
                change = np.zeros(lm_score.INPUTS)
            z = float(np.clip(x[:, i] @ (weights[gate[i]] + change), -lm_score.LIMIT, lm_score.LIMIT))
            p = 1 / (1 + np.exp(-z))
            total += np.log10(p if bit else 1 - p)
            change += lm_score.RATE * (bit - p) * x[:, i]
        assert abs(found - total) < 1e-4 * max(1, abs(total))
