"""The prefix trie against one built in plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparktrail.llm import common, trie

_SCHEMA = "conv_id long, turn long, role string, text string"


def _plain(built):
    """Rows of the trie of {conv: [(role, text), ...]}."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children, saved, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, own in members.items():
        words = len(re.findall(rb"[^\x20\x09-\x0D]+", path[-1][1].encode())) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(own) - 1) * words
            leaves[path[:d]] += path not in children
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), children[p], leaves[p], saved[p], digest(ends[p])) for p, own in members.items())


def _rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            sign = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), sign, (role or "", text or "")))
    own = {c: [t[2] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + ts[h:]
    return out


def _got(spark, rows):
    df = spark.createDataFrame(rows, _SCHEMA).repartition(4)
    return sorted(map(tuple, trie.trie(*trie.branched(trie.turns(df))).collect()))


def _random_rows(seed, convs, longest):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(200), convs):
        for t in range(r.randint(1, longest)):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["a", "a b", "", None, " x\ty "])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_plain_trie(spark, seed, monkeypatch):
    monkeypatch.setattr(trie, "ENDS", 3)
    rows = _random_rows(seed, 60, 5) + [(None, 1, "user", "lost"), (400, None, None, None), (400, 1, "user", "x"), (401, 5, "user", "alone")]
    rows += [(c, t, "user", f"same {t}") for c in range(500, 530) for t in range(4)] + [(7_000, 0, "user", "w " * 3000)] * 2
    assert _got(spark, rows) == _plain(_rebuilt(rows))


def test_nested_chains_and_long_conversations(spark, monkeypatch):
    """Each conversation is a prefix of the one with the next smaller id, so chains hang on chains; sums go by blocks."""
    sums = common.running_sums
    monkeypatch.setattr(trie, "running_sums", lambda *a: sums(*a, block=4))
    built = {c: [("u", f"turn {i}") for i in range(40 - c)] + [("u", f"end of {c}")] * (c % 3) for c in range(40)}
    convs = spark.createDataFrame([(c, len(p)) for c, p in built.items()], "conv long, len long")
    rows = [(c, d, hashlib.sha256(repr(t).encode()).hexdigest(), len(t[1].split())) for c, p in built.items() for d, t in enumerate(p, 1)]
    got = trie.trie(convs, spark.createDataFrame(rows, "conv long, depth long, sign string, words long")).collect()
    assert sorted(map(tuple, got)) == _plain(built)


def test_empty_repeated_and_extra_columns(spark):
    assert trie.trie(*trie.branched(trie.turns(spark.createDataFrame([], _SCHEMA)))).collect() == []
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a")]
    df = spark.createDataFrame(rows, _SCHEMA).withColumns({c: F.lit("x") for c in ("at", "conv", "depth", "sign", "a.b", "words")})
    assert sorted(map(tuple, trie.trie(*trie.branched(trie.turns(df))).collect())) == _plain(_rebuilt(rows))


def test_running_sums_by_blocks(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.floor(F.col("id") / 3).alias("p"), F.lit(1).cast("long").alias("v"))
    got = common.running_sums(df, "k", "p", ["v"], block=7).collect()
    assert {(r.k, r.p): r.v for r in got} == {(i % 3, i // 3): i // 3 + 1 for i in range(100)}
