"""Importance resampling against a plain count of n-grams."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktrail.llm import resample

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _features(text, longest):
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = _WORD.findall(lower)
    return words, [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def _plain(docs, target, longest, buckets, percent, min_words, seed=2024):
    count = lambda texts: Counter(zlib.crc32(f) % buckets for t in texts for f in _features(t, longest)[1])
    s, t = count(x for _, x in docs), count(target)
    every_s, every_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (every_s + buckets) / ((s[b] + 1) * (every_t + buckets))))
    out = []
    for key, text in docs:
        words, found = _features(text, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(zlib.crc32(f) % buckets) for f in found)
        out.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((-r[3], -1 if r[0] is None else r[0]) for r in out if r[4] >= min_words)
    drawn = {}
    for place, key in enumerate(able[: len(able) * percent // 100], 1):
        drawn.setdefault(key, []).append(place)
    return sorted(((r[0], r[1], r[2], r[3], drawn[k].pop(0) if r[4] >= min_words and drawn.get(k := (-r[3], -1 if r[0] is None else r[0])) else None) for r in out), key=str)


_ODD = [None, "", " \n", "A", "a a a a", "Ünï ünï Ünï x", "one-two_three1 ONE", "x" * 3000, "w " * 5000 + "end", "ab\x00cd ef\x7fgh 中文 text"]


@pytest.mark.parametrize(("longest", "buckets"), [(1, 10_000), (3, 97), (4, 5)])
def test_equal_to_plain_counts(spark, sf_dir, longest, buckets):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()] + _ODD
    docs = [*enumerate(texts), (3, texts[3]), (None, "no id at all, but some words here"), (7, "another text of id seven")]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(10).collect()] + [None, ""]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, weight int, place string").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resampled(df, wanted, percent=40, min_words=3, longest=longest, buckets=buckets).collect()
    assert sorted(map(tuple, got), key=str) == _plain(docs, target, longest, buckets, 40, 3)


def test_blocks_do_not_change_counts():
    texts = [f"a b c {i % 7} a b".encode() for i in range(200)] + [b"", None, b"a " * 500]
    import pyarrow as pa

    for n in (1, 2, 5):
        small = sum(b.counts(n, 50) for b in resample.blocks(pa.array(texts, pa.binary()), n, limit=64))
        large = sum(b.counts(n, 50) for b in resample.blocks(pa.array(texts, pa.binary()), n))
        assert (small == large).all()


def test_runs_hash_each_ngram_once():
    block = resample.Suffixes([b"a b a b a b", b"a b", b""], 2)
    first, occurs, codes = block.runs(2)
    told = {int(c): int(n) for c, n in zip(codes, occurs, strict=True) if n}
    assert told == {zlib.crc32(b"a b"): 4, zlib.crc32(b"b a"): 2}
    assert len(first) == len(codes)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resample.resampled(none, some.select("text")).collect() == []
    assert [r.n_features for r in resample.resampled(some, none.select("text"), longest=1).collect()] == [3]
    assert resample.resampled(some, none.select("text"), longest=1, min_words=1, percent=100).first()["rank"] == 1


def test_ties_are_spread_and_ranked_by_id(spark):
    """A third of the rows are one row; all ranks are given out once."""
    rows = spark.range(900).select((F.col("id") % 3 * F.col("id")).alias("doc_id"), F.lit("same words in all of them").alias("text"))
    got = resample.resampled(rows, rows.select("text").limit(1), percent=50, min_words=1, longest=1).collect()
    ranked = sorted((r["rank"], -r["score"], r["doc_id"]) for r in got if r["rank"])
    assert [r[0] for r in ranked] == list(range(1, 451))
    assert [r[1:] for r in ranked] == sorted(r[1:] for r in ranked)
    assert np.unique([r["n_features"] for r in got]).tolist() == [6]
