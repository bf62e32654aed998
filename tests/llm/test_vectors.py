"""Exact top-k and the metric range join against brute force, and the shard store."""

import math
import random

import numpy as np
import pytest

from sparktrail.llm import rangejoin, topk
from sparktrail.llm.shards import ShardStore

SCHEMA = "vec_id long, embedding array<float>, label int, v string, rank int"


def _vectors(seed, n=300, dim=8):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        x = base[rng.integers(12)] + rng.normal(size=dim) * rng.choice([0.02, 0.1, 0.6])
        rows.append((i, (x / np.linalg.norm(x)).astype(np.float32).tolist(), int(rng.integers(0, 3))))
    rows += [(n + i, rows[5][1], 0) for i in range(40)]  # copies
    rows += [(900, None, 0), (901, [0.0] * dim, 0), (902, [float("nan")] * dim, 0), (903, [None] + [1.0] * (dim - 1), 0), (904, [float("inf")] * dim, 0), (905, [1.0] * (dim + 1), 0), (906, [1.0] * dim, None), (907, [], 1), (None, rows[0][1], 0), (0, rows[0][1], rows[0][2])]
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def _valid(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("blocks", [(4096, 1024), (50, 7)])
def test_top_k_equals_brute_force(spark, blocks):
    from pyspark.sql import functions as F

    rows = _vectors(1)
    good = [(i, [math.floor(64 * np.float64(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and _valid(v)]
    got = {}
    for r in topk.top_k(_frame(spark, rows), F.col("vec_id") % 20 == 0, k=5, block=blocks[0], query_block=blocks[1]).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = {}
    for i, q in good:
        if i % 20 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good if j != i and len(v) == len(q)))[:5]
            want[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_large_integers_stay_exact(spark):
    from pyspark.sql import functions as F

    rows = [(i, [float(2**20 + i), float(i), -3.0], 0) for i in range(60)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") == 7, k=3).collect()
    q = [math.floor(64 * x) for x in rows[7][1]]
    best = sorted(((-sum(a * math.floor(64 * b) for a, b in zip(q, v, strict=True)), i) for i, v, _ in rows if i != 7))[:3]
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(i, -s) for s, i in best]


def test_any_finite_vector_takes_part(spark):
    from pyspark.sql import functions as F

    rows = [(20, [1e9, 1.0], 0), (1, [1e9, -3.0], 0), (2, [1.0, 2.0], 0), (3, [-1e300, 5.0], 0), (40, [2.0, 2.0], 0), (60, [2.0**40, 0.5], 0), (5, [1e308, 1.0], 0), (80, [0.0, 0.0], 0)]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 20 == 0, k=4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = {i: [math.floor(64 * x) if abs(x) < 2**40 else int(x) * 64 for x in v] for i, v, _ in rows}
    for q in (20, 40, 60, 80):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), i) for i in whole if i != q)[:4]
        assert sorted(got[q]) == [(n + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for n, (s, i) in enumerate(best)]


def test_an_id_with_several_vectors_asks_with_each(spark):
    from pyspark.sql import functions as F

    rows = [(20, [1.0, 0.0], 0), (20, [0.0, 1.0], 0), (1, [2.0, 3.0], 0), (2, [5.0, 1.0], 0)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 20 == 0, k=2, scale=1.0).collect()
    assert sorted(map(tuple, got)) == [(20, 1, 1, 3), (20, 1, 2, 5), (20, 2, 1, 2), (20, 2, 2, 1)]


def test_lists_are_read_no_further_than_needed():
    rng = np.random.default_rng(5)
    skewed = np.floor(rng.exponential(size=(2000, 16)) ** 3 * 20)
    skewed[:30] *= 8
    lists = topk.Lists(np.arange(2000), skewed)
    asked = np.arange(40, 60)
    for q, (ids, scores) in zip(asked, lists.top(skewed[asked], 10, asked), strict=True):
        want = np.lexsort((np.arange(2000), -np.where(np.arange(2000) == q, -1, skewed @ skewed[q])))[:10]
        assert ids.tolist() == want.tolist() and scores.tolist() == (skewed[want] @ skewed[q]).tolist()
    assert lists.read < 0.3 * 20 * skewed.size
    assert lists.products == 0
    even = topk.Lists(np.arange(500), np.floor(64 * rng.normal(size=(500, 64))))
    list(even.top(even.vectors[:5], 10, np.arange(5)))
    assert even.products == 5 and even.read <= 5 * 500 * 64 / 16, "what a product takes over is not counted as read"
    flat = topk.Lists(np.arange(50), np.ones((50, 4)))
    assert next(flat.top(np.ones((1, 4)), 50, [-1]))[0].tolist() == list(range(50)) and flat.read == 0, "with no more candidates than k nothing is read"


def test_top_k_of_nothing(spark):
    from pyspark.sql import functions as F

    assert topk.top_k(_frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize(("cell", "chunk"), [(4096, 4096), (20, 15), (7, 40)])
def test_range_join_equals_brute_force(spark, cell, chunk):
    rows = _vectors(2)
    ids = {i: (v, c) for i, v, c in rows if i is not None}
    good = [(i, np.array(v, np.float64), c) for i, (v, c) in ids.items() if _valid(v) and any(v) and c is not None]
    links, parent = dict.fromkeys(ids, 0), {i: i for i in ids}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in range(len(good)):
        for b in range(a):
            (i, x, c), (j, y, d) = good[a], good[b]
            if c == d and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                links[i], links[j] = links[i] + 1, links[j] + 1
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    got = rangejoin.range_join(_frame(spark, rows), cell=cell, chunk=chunk, pivots=3).collect()
    assert len(got) == len(rows)
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(i, links[i], find(i), find(i) == i) for i in ids} | {(None, 0, None, True)}


def test_several_vectors_of_one_id(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (4, [-1.0, 0.0], 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in rangejoin.range_join(_frame(spark, rows)).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]


def test_cosines_of_tiny_and_huge_vectors(spark):
    """Squares of such components leave the range of doubles; cosines near the bar are still told exactly."""
    base = [(1.0, 0.0), (0.93, math.sqrt(1 - 0.93**2)), (0.9300000001, math.sqrt(1 - 0.9300000001**2)), (0.5, -0.5)]
    rows = [(i + 10 * j, 1 + j, [x * s for x in v]) for j, s in enumerate((1.0, 2.0**-600, 2.0**-1000, 2.0**600)) for i, v in enumerate(base)]
    got = {r.vec_id: r.n_links for r in rangejoin.range_join(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    assert len({tuple(got[i + 10 * j] for i in range(4)) for j in range(4)}) == 1 and got[2] >= 2


def test_range_join_of_nothing(spark):
    assert rangejoin.range_join(_frame(spark, [])).count() == 0


def test_shards(spark, tmp_path):
    from pyspark.sql import functions as F

    store = ShardStore(spark, str(tmp_path / "store"), base=1 << 10, target=1 << 20, fanout=3)
    assert store.manifest()["version"] == 0 and store.versions() == []
    rng = random.Random(0)
    rows = [(i, rng.choice([None, "", "x" * rng.randint(0, 50)]), i % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int")
    store.append(df.filter("part = 0"))
    store.append(df.filter("part = 1"))
    assert store.compact() == [] and store.read(1).count() == 100
    store.append_all(df.filter("part >= 2").withColumn("_a", F.col("part")), "_a")
    before = store.manifest()
    done = store.compact()
    assert len(done) == 1 and len(before["runs"]) == 4 and len(store.manifest()["runs"]) == 1
    assert sorted(store.read().collect(), key=lambda r: r.doc_id) == [tuple(r) for r in sorted(rows)]
    assert store.read(before["version"]).count() == 400, "older versions stay readable"
    assert store.files().agg(F.sum("n_rows")).first()[0] == 400
    store.append(df.limit(0))
    store.vacuum()
    assert store.versions() == [store.manifest()["version"]] and store.read().count() == 400


def test_shards_of_an_empty_table(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "store"))
    assert store.read().count() == 0 and store.read().columns == []
    df = spark.createDataFrame([], "doc_id long, text string, part int")
    assert len(store.append_all(df, "part")) == 1
    assert store.read().count() == 0 and store.read().columns == ["doc_id", "text"] and store.compact() == []
    store.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert [tuple(r) for r in store.read().collect()] == [(1, "a")]


def test_shards_keep_every_column(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "store"), fanout=2)
    store.append(spark.createDataFrame([(1, "x", "a" * 300000)], "id long, extra string, text string"))
    store.append(spark.createDataFrame([(2,), (2,), (None,)], "id long"))
    old = store.manifest()["version"]
    before = sorted(map(str, store.read().collect()))
    assert len(store.compact()) == 1
    store.append(spark.createDataFrame([(3, 7)], "id long, more int"))
    store.compact()
    store.vacuum()
    rows = store.read()
    assert rows.columns == ["id", "extra", "text", "more"] and sorted(map(str, rows.filter("more is null").drop("more").collect())) == before
    assert rows.filter("extra = 'x'").first().text == "a" * 300000 and old not in store.versions()
    for other in ("id string", "ID long"):
        with pytest.raises(ValueError, match="does not go with"):
            store.append(spark.createDataFrame([], other))


def test_concurrent_commits_do_not_lose_runs(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "store")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: ShardStore(spark, root).append(spark.range(i * 10, i * 10 + 10)), range(8)))
    store = ShardStore(spark, root)
    assert store.versions() == list(range(1, 9)) and store.read().distinct().count() == 80
