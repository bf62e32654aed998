"""Near-duplicate and substring detection against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from sparktrail.llm import near, substring
from sparktrail.llm.components import components
from sparktrail.llm.near import Sketcher

SCHEMA = "doc_id long, text string, n string, bands int, key string"


def _frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, "k") for i, t in texts], SCHEMA)


def _sets(text, size):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


def _brute(texts, size, percent=80):
    sets = [(i, _sets(t, size)) for i, t in texts]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations([s for s in sets if s[0] is not None], 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {(i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for i, s in sets}


def _words(rng, n, vocabulary=400):
    return [f"w{rng.randint(0, vocabulary)}" for _ in range(n)]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    rng = random.Random(size)
    passage = _words(rng, 110, 10**6)
    texts, chain = [], _words(rng, 120)
    for i in range(60):  # mostly one common passage, below the bar for most pairs
        texts.append(" ".join(passage + _words(rng, rng.randint(5, 30))))
    for i in range(40):  # a chain: neighbours are alike, the ends are not
        chain = chain[:]
        chain[rng.randrange(120)] = f"new{i}"
        texts.append(" ".join(chain))
    texts += ["Same Text HERE now"] * 30 + ["same\ttext here NOW ", "one", "One", "one two", "", " \n", None, None, "é É"]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(5, texts[5]), (None, texts[6])]
    got = near.near_duplicates(_frame(spark, rows), size=size).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == _brute(rows, size)


def test_near_duplicates_of_nothing(spark):
    assert near.near_duplicates(_frame(spark, []), size=2).count() == 0
    got = near.near_duplicates(_frame(spark, [(3, "a b c d"), (1, None)]), size=2).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(3, 3, 3, True), (1, 0, 1, True)}


def test_sketches_estimate_similarity():
    sketcher, rng = Sketcher(32, 5), np.random.default_rng(1)
    for n in (1, 3, 40, 3000):
        values = rng.integers(1, 1 << 63, n, dtype=np.int64).astype(np.uint64)
        sketch = sketcher(values)
        assert (sketch < np.iinfo(np.uint64).max).all(), "every coordinate fills"
    found = []
    for _ in range(60):
        both = rng.integers(1, 1 << 63, 900, dtype=np.int64).astype(np.uint64)
        found.append((sketcher(both[:800]) == sketcher(both[100:])).mean())
    assert abs(np.mean(found) - 700 / 900) < 0.02 and np.std(found) < 0.05


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, 201), (201, 202), (202, 200)] + [(rng.randint(300, 330), rng.randint(300, 330)) for _ in range(20)] + [(None, 3)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def _removed(texts, window):
    first, out = {}, []
    for i, text in sorted((t for t in texts if t[0] is not None), key=lambda t: t[0]):
        words = (text or "").encode().split()
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            first[key] = min(first.get(key, i), i)
    for i, text in texts:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            if i is not None and first[tuple(words[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "window"), [(1, 10), (3, 9), (4, 50), (5, 41)])
def test_substrings_equal_brute_force(spark, seed, window):
    rng = random.Random(seed)
    passages = [_words(rng, n, 10**6) for n in (window - 1, window, window + 1, window + 2, 2 * window + 5, 6 * window, 20 * window)] + [["a"] * (3 * window), ["a", "b"] * (2 * window)]
    texts = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            lo = rng.randint(0, len(p) - 1)
            parts += rng.choice([p, p, p[lo:], p[: lo + 1]]) + _words(rng, rng.randint(0, 15), 10**6)
        texts.append((i, rng.choice([" ", "\t", " \n"]).join(parts)))
    texts += [(i + 200, t) for i, t in texts[:30]] + [(3, texts[3][1]), (3, texts[4][1]), (None, texts[5][1]), (500, None), (501, ""), (502, "  ")]
    docs = _frame(spark, texts)
    out, cleaned = substring._with_repeats(docs, "doc_id", "text", window, False)
    rows = out.select("doc_id", f"{cleaned}.*").collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows], key=str) == _removed(texts, window)
    cleaned = substring.without_repeats(docs, window=window)
    assert cleaned.columns == docs.columns and cleaned.count() == len(texts)
    changed = {r.doc_id: r.text for r in cleaned.collect()}
    assert changed[500] is None and changed[502] == "  ", "what nothing goes from stays as it is"


def test_levels_double_up_to_the_window():
    assert substring.lengths(50) == [13, 25, 50] and substring.lengths(10) == [5, 10] and substring.lengths(2) == [1, 2]


def test_columns_of_any_name_pass(spark):
    names = "id key text_key spans cleaned of_id of_key at n left h0 _id _cleaned said gone told"
    passage = " ".join(map(str, range(60)))
    docs = spark.createDataFrame([(i, passage, *names.split()) for i in (1, 2)], ["doc_id", "text", *names.split()])
    out = {r.doc_id: r for r in substring.without_repeats(docs).collect()}
    assert out[1].text == passage and out[2].text == "" and all(tuple(r)[2:] == tuple(names.split()) for r in out.values())


def test_words_that_only_differ_in_order_are_told_apart(spark):
    # a word and its complement, on which polynomial hashes modulo a power of two agree
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    got = near.near_duplicates(_frame(spark, [(1, word), (2, other), (3, word)]), size=2).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 2), (3, 1)}
    line = " ".join(f"w{i}" for i in range(49))
    left = {r.doc_id: r.text for r in substring.without_repeats(_frame(spark, [(1, f"{word} {line}"), (2, f"{other} {line}")])).collect()}
    assert left[2] == f"{other} {line}"


def test_links_are_confirmed_on_words(spark, monkeypatch):
    monkeypatch.setattr(near, "shingles", lambda words, size: iter([np.arange(1, 9, dtype=np.uint64)] * words.n_docs))
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    texts = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (3, "b a d c f e")], "id long, text string")
    assert [tuple(r) for r in near._confirmed(pairs, texts, 2, 80).collect()] == [(1, 2)]


def test_substrings_of_nothing(spark):
    docs = _frame(spark, [])
    assert substring.without_repeats(docs).count() == 0
    assert substring.without_repeats(_frame(spark, [(1, "short text"), (2, None)])).count() == 2
