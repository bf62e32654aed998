"""Vectors are kept for texts that stay the same and made anew for others."""

import numpy as np

from sparktrail.sources import cache


def test_vectors_are_renewed(spark, tmp_path):
    make = lambda command: spark.createDataFrame([("s", 0, command, None, "why"), ("s", 1, None, " ", None)], "sid string, idx int, command string, path string, purpose string")
    first = cache.renewed(cache.texts(make("ls a")), cache.encoded(cache.texts(make("x")).limit(0)))
    assert {(r.idx, r.dim) for r in first.collect()} == {(0, "command"), (0, "purpose")}
    assert all(abs(np.linalg.norm(r.vector) - 1) < 1e-5 for r in first.collect())
    first = cache.kept(first, str(tmp_path), "vectors")
    changed = cache.texts(make("ls b"))
    assert [(r.dim, r.text) for r in cache.stale(changed, first).collect()] == [("command", "ls b")]
    calls = spark.sparkContext.accumulator(0)

    def encoder(batch):
        calls.add(len(batch))
        return np.ones((len(batch), 2), np.float32)

    got = {r.dim: len(r.vector) for r in cache.renewed(changed, first, encoder).collect()}
    assert got == {"command": 2, "purpose": 384} and calls.value == 1
    assert cache.kept(first.limit(0), str(tmp_path), "vectors").count() == 2, "what is kept is not made again"
    assert cache.kept_path("r", "n", first) != cache.kept_path("r", "n", changed)


def test_tables_are_renewed_when_sources_change(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "kept")
    source.mkdir()
    (source / "a.jsonl").write_text("1\n")
    read = lambda: cache.kept(spark.read.text(str(source)), root, "lines", sources=[str(source)])
    first = read()
    assert first.count() == 1
    (source / "b.jsonl").write_text("2\n3\n")
    assert read().count() == 3 and first.count() == 1, "the table that is being read stays"
    (source / "b.jsonl").write_text("22\n3\n")
    assert {r.value for r in read().collect()} == {"1", "22", "3"}
    assert cache.stamp(spark, [str(tmp_path / "none")]) == ""
