"""Operators on hand-made tables, at their thresholds."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparktrail.operators import efficiency, evidence, goal, graph, links, normalize, spans, stats, validators, views


def test_duplicate_vote(spark):
    rows = [(0.91, 0.0, 0.0), (0.90, 0.0, 0.0), (0.0, 0.86, 0.0), (0.0, 0.0, 0.86), (0.0, 0.81, 0.81), (0.81, 0.81, 0.0), (0.81, 0.0, 0.81), (None, 0.85, None)]
    got = spark.createDataFrame(rows, "c double, p double, r double").select(efficiency.vote(F.col("c"), F.col("p"), F.col("r")).alias("v")).collect()
    assert [r.v for r in got] == ["command_strong", None, "purpose_strong", "reasoning_strong", "combined_pr", "combined_cp", None, None]


def test_wasted_reads_by_name_and_likeness(spark):
    acts = [("s", i, 1, a, p, c) for i, (a, p, c) in enumerate([("read_file", "/x/abcde", None), ("read_file", "/x/used1", None), ("read_file", "/x/abc", None), ("run_command", None, "cat used1")])]
    df = spark.createDataFrame([(*r, None, None) for r in acts], "sid string, idx int, seg int, action string, path string, command string, purpose string, reasoning string")
    assert [r.idx for r in efficiency.wasted_reads(df).collect()] == [0]
    vectors = spark.createDataFrame([("s", 0, "response", [1.0, 0.0]), ("s", 3, "command", [0.8, 0.6])], "sid string, idx int, dim string, vector array<double>")
    assert efficiency.wasted_reads(df, vectors).count() == 0
    assert [round(r.max_sim, 3) for r in efficiency.wasted_reads(df, vectors, alike=0.8).collect()] == [0.8]
    assert [(r.seg, r.n_reads) for r in efficiency.read_counts(df).collect()] == [(1, 3)]


def test_failures_and_writes(spark):
    rows = [("s", i, 1, 1, "x" if i in (1, 2, 3, 5, 6) else None, i == 7, "modify_file" if i < 3 else "read_file", "/a") for i in range(9)]
    df = spark.createDataFrame(rows, "sid string, idx int, seg int, turn int, error string, blocked boolean, action string, path string")
    assert {(r.first_idx, r.last_idx, r.n) for r in efficiency.failure_groups(df).collect()} == {(1, 3, 3), (5, 7, 3)}
    got = efficiency.multi_writes(df).collect()
    assert [(r.path, r.n, r.density, r.is_single_turn, r["at"]) for r in got] == [("/a", 3, 3.0, True, [0, 1, 2])]


def test_connected(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)], "a int, b int")
    got = {r.id: r.component for r in links.connected(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_graph_of_one_file(spark):
    """Reads and edits of one file; an edit that failed counts for nothing."""
    rows = [(i, "read_file", None) for i in (32, 46, 47, 51, 67, 72)] + [(i, "modify_file", None) for i in (68, 71, 73)] + [(74, "modify_file", "not found")]
    df = spark.createDataFrame([("s", i, 1, a, "/w/a", e) for i, a, e in rows], "sid string, idx int, turn int, action string, path string, error string")
    touched = graph.touches(df)
    ents, edges = graph.entities(touched), graph.edges(touched)
    assert sorted(r.version for r in ents.collect()) == [0, 1, 2, 3]
    used = {r.idx: r.version for r in edges.filter("kind = 'usedBy'").collect()}
    assert used == {32: 0, 46: 0, 47: 0, 51: 0, 67: 0, 68: 0, 71: 1, 72: 2, 73: 2}
    assert graph.violations(ents, edges).count() == 0
    fates = {r.version: r.fate for r in graph.fates(ents, edges).collect()}
    assert fates == {0: "input", 1: "superseded", 2: "superseded", 3: "unconsumed"}
    made = spark.createDataFrame([("s", 1, 1, "create_file", "/w/b", None), ("s", 2, 1, "read_file", "/w/b", None)], df.schema)
    assert sorted(r.version for r in graph.entities(graph.touches(made)).collect()) == [1]
    text = spark.createDataFrame([(500,), (12_000,), (184_000,), (4_980_000,)], "ms long").select(graph.short_duration("ms").alias("t")).collect()
    assert [r.t for r in text] == ["<1s", "12s", "3m 4s", "1h 23m"]


def test_tree_ends_in_cycles(spark):
    sessions = spark.createDataFrame([("a", "c"), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("f", None)], "sid string, parent string")
    got = {(r.root, r.sid, r.depth) for r in evidence.run_tree(sessions, spark.createDataFrame([("a",)], "sid string")).collect()}
    assert got == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3)}


def test_files_and_goal(spark):
    files = spark.createDataFrame([("r", "/o/a/x.json", "2026-01-01 10:00:00"), ("r", "/o/y.json", "2026-01-02 10:00:00"), ("r", "/o/z.txt", "2026-01-01 10:00:00")], "root string, path string, at string").select("root", "path", F.to_timestamp("at").alias("modified_at"))
    patterns = spark.createDataFrame([("R1", "r", "*.json"), ("R2", "r", "y.*")], "req_id string, root string, glob string")
    window = spark.createDataFrame([("r", "2026-01-01 00:00:00", "2026-01-01 23:00:00")], "root string, a string, b string").select("root", F.to_timestamp("a").alias("lower"), F.to_timestamp("b").alias("upper"))
    assert {(r.req_id, r.found, r.strong, r.tier) for r in evidence.files_in_window(files, patterns, window).collect()} == {("R1", 2, 1, "artifact"), ("R2", 1, 0, "derived")}
    reqs = spark.createDataFrame([("a", "strong", "active"), ("b", "strong", "active"), ("c", "weak", "active"), ("CTRL1", "strong", "active")], "id string, strength string, status string")
    findings = lambda a, b, ctrl: spark.createDataFrame([("a", a, False, False), ("b", b, False, False), ("c", "false", False, False), ("CTRL1", ctrl, False, True)], "req_id string, satisfied string, overclaim boolean, synthetic boolean")
    verdict = lambda *x: goal.aggregate(findings(*x), reqs).collect()[0]
    assert [verdict(*x).verdict for x in (("true", "true", "false"), ("true", "unverifiable", "false"), ("true", "false", "false"), ("true", "true", "true"))] == ["PASS", "WEAK_PASS", "FAIL", "INVALID"]
    assert verdict("true", "false", "false").score == 0.5
    capped = spark.createDataFrame([("direct", 2.0, False), ("retrieved", 0.9, True), ("odd", 0.9, False)], "t string, b double, r boolean").select(goal.capped_confidence(F.col("t"), F.col("b"), F.col("r")).alias("c")).collect()
    assert [r.c for r in capped] == [1.0, 0.675, 0.0]


def test_rollup_fills_starts(spark):
    rows = [("s", 1, "2026-01-01 00:00:00", 10.0), ("s", 2, None, 5.0), ("s", 3, None, 1.5), ("s", 4, "2026-01-01 01:00:00", None)]
    df = spark.createDataFrame(rows, "sid string, turn int, t string, dur_s double").withColumn("start_ts", F.to_timestamp("t"))
    got = [str(r.start_ts) for r in stats.session_rollup(df).orderBy("turn").collect()]
    assert got == ["2026-01-01 00:00:00", "2026-01-01 00:00:10", "2026-01-01 00:00:15", "2026-01-01 01:00:00"]


def test_span_documents(spark):
    rows = [("s1", i, 1, "spawn_subagent" if i == 1 else "read_file", "read", "agent-x" if i == 1 else None, None, i != 2, False) for i in range(3)]
    acts = spark.createDataFrame(rows, "sid string, idx int, turn int, action string, tool string, pattern string, error string, completed boolean, blocked boolean").withColumn("ts", F.lit(None).cast("timestamp"))
    doc = json.loads(spans.documents(spans.spans(acts)).collect()[0].document)
    listed = doc["resourceSpans"][0]["scopeSpans"][0]["spans"]
    assert [s["name"] for s in listed] == ["invoke_agent s1", "execute_tool read", "invoke_agent agent-x", "execute_tool read"]
    assert listed[1]["startTimeUnixNano"] == "1700000000000000000" and listed[2]["startTimeUnixNano"] == "1700000000001000000"
    assert listed[1]["parentSpanId"] == listed[0]["spanId"] and [s["status"]["code"] for s in listed] == [1, 1, 1, 0]
    assert {"key": "agent.idx", "value": {"intValue": "1"}} in listed[2]["attributes"]


def test_validators(spark):
    turns = spark.createDataFrame([("s", t) for t in range(1, 7)], "sid string, turn int")
    make = lambda *rows: spark.createDataFrame([("s", *r) for r in rows], "sid string, seg int, start int, stop int, theme string")
    assert validators.segments(make((1, 1, 3, "a"), (2, 4, 6, "b")), turns).count() == 0
    assert {r.seg for r in validators.segments(make((1, 1, 3, "a"), (2, 5, 5, "b")), turns).collect()} == {2}
    reqs = spark.createDataFrame([("a", "t", 1, "action", "active", "strong", "e"), ("b", "", 9, "odd", "active", "strong", "e")], "id string, text string, origin_turn int, verifiable_by string, status string, strength string, expect string")
    assert [(r.id, r.problems) for r in validators.requirements(reqs, 3).collect()] == [("b", ["text", "origin_turn", "verifiable_by"])]
    crit = spark.createDataFrame([("a", ["x"], "*.{a,b}")], "req_id string, anchors array<string>, artifact_glob string")
    assert {(r.req_id, tuple(r.problems)) for r in validators.criteria(crit, reqs).collect()} == {("a", ("artifact_glob",)), ("b", ("missing",))}
    said = spark.createDataFrame([("c", 1, "did", "t", "ok!!"), ("d", 1, "did", "t", "four words here")], "id string, turn int, kind string, text string, quote string")
    assert [r.id for r in validators.claims(said, 3).collect()] == ["c"]


def test_views(spark):
    sessions = spark.createDataFrame([("abc1",), ("abd2",)], "sid string")
    assert views.by_prefix(sessions, "abc").collect()[0].sid == "abc1" and views.by_prefix(sessions, "ab").count() == 0


def test_runs_meet_sessions_without_products(spark):

    runs = spark.createDataFrame([("a", 1, "fix the bug now", "10:00:00", "/w"), ("a", 2, "fix the bug now", "10:30:00", "/w"), ("a", 3, "", "10:40:00", "/w"), ("b", 1, "write docs", "23:58:00", None), ("c", 1, "no time known", None, None)], "sid string, run int, prompt string, t string, cwd string")
    runs = runs.withColumn("started_at", F.try_to_timestamp(F.concat(F.lit("2026-01-01 "), "t"))).drop("t")
    sessions = spark.createDataFrame(
        [("s1", "fix the bug…", "/w", "2026-01-01 10:20:00"), ("s2", "fix the", "/w", "2026-01-01 10:20:00"), ("s3", "fix the bug now", "/other", "2026-01-01 10:00:00"), ("s4", "write", "/x", "2026-01-02 00:02:00"), ("s5", "write", "/x", "2026-01-02 00:04:00"), ("s6", "no time", "/x", "2020-01-01 00:00:00"), ("s7", "...", "/w", "2026-01-01 10:00:00"), ("s8", "no time", "/x", None)],
        "sid string, title string, cwd string, c string",
    ).select("sid", "title", "cwd", F.try_to_timestamp("c").alias("created_at"), F.try_to_timestamp("c").alias("modified_at"))
    got = normalize.attribute_runs(runs, sessions)
    assert {(r.sid, r.run, r.session) for r in got.collect()} == {("a", 1, "s1"), ("a", 2, "s2"), ("a", 3, None), ("b", 1, "s4"), ("c", 1, "s6")}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_bags(spark):
    one, two = (spark.createDataFrame([(x,) for x in rows], "t string") for rows in (["a", "a", "b", None], ["a", "c", None, None]))
    assert {(r.t, r.common, r.only_first, r.only_second) for r in normalize.bag_differences(one, two, ["t"]).collect()} == {("a", 1, 1, 0), ("b", 0, 1, 0), ("c", 0, 0, 1), (None, 1, 0, 1)}


def _plain_clusters(rows, vectors, apart, bars):
    """Clusters by comparing all pairs: rows of (sid, seg, idx), vectors by (idx, dim)."""
    def alike(i, j, dim):
        x, y = vectors.get((i, dim)), vectors.get((j, dim))
        return 0.0 if x is None or y is None or not np.any(x) or not np.any(y) else float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))

    pairs, head = [], {i: i for _, _, i in rows}

    def find(i):
        return i if head[i] == i else find(head[i])

    for s, g, i in rows:
        for s2, g2, j in rows:
            if (s, g) == (s2, g2) and i < j and (i, j) not in apart:
                c, p, r = (alike(i, j, d) for d in ("command", "purpose", "reasoning"))
                both = bars["combined_min"]
                why = "command_strong" if c > bars["command_strong"] else "purpose_strong" if p > bars["purpose_strong"] else "reasoning_strong" if r > bars["reasoning_strong"] else "combined_pr" if p > both and r > both else "combined_cp" if c > both and p > both else None
                if why:
                    pairs.append((i, j, why))
                    a, b = sorted((find(i), find(j)))
                    head[b] = a
    out = {}
    for i, j, why in sorted(pairs):
        out.setdefault(find(i), []).append(why)
    groups = {h: sorted(i for i in head if find(i) == h) for h in out}
    return sorted((groups[h], max(dict.fromkeys(whys), key=lambda w: (whys.count(w), -whys.index(w)))) for h, whys in out.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_those_of_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, 4))
    rows = [("s", int(i % 2), i) for i in range(80)]
    vectors = {(i, d): (base[rng.integers(6)] + rng.choice([0, 0.05, 0.4]) * rng.normal(size=4)).round(2) for _, _, i in rows for d in ("command", "purpose", "reasoning") if rng.random() < 0.7}
    apart = {tuple(sorted(map(int, rng.choice(80, 2, replace=False)))) for _ in range(60)}
    vecs = spark.createDataFrame([("s", i, d, v.tolist()) for (i, d), v in vectors.items()], "sid string, idx int, dim string, vector array<double>")
    commands = spark.createDataFrame([r for r in rows if any((r[2], d) in vectors for d in ("command", "purpose", "reasoning"))], "sid string, seg int, idx int")
    pairs = spark.createDataFrame([("s", *p) for p in apart], "sid string, idx1 int, idx2 int")
    got = efficiency.duplicate_clusters(commands, vecs, pairs, chunk=7).collect()
    assert sorted((list(r.members), r.dominant_reason) for r in got) == _plain_clusters(rows, vectors, apart, efficiency.VOTE)


def test_many_equal_commands_make_one_class(spark):
    n = 30_000
    commands = spark.range(n).select(F.lit("s").alias("sid"), F.lit(1).alias("seg"), F.col("id").cast("int").alias("idx"))
    vectors = commands.select("sid", "idx", F.lit("command").alias("dim"), F.array(F.lit(1.0), (F.col("idx") % 3).cast("double")).alias("vector"))
    got = efficiency.duplicate_clusters(commands, vectors, bars=efficiency.VOTE | {"command_strong": 0.99}).collect()
    assert sorted(len(r.members) for r in got) == [n // 3] * 3


def test_many_small_segments_are_one_call():
    """What Python does for each call is done once for thousands of segments; a task across batches stays in one piece."""
    sizes = [1, 3, 2, 5] * 500
    seg = np.repeat(np.arange(len(sizes)), sizes)
    zero = np.zeros(len(seg), np.int64)
    rows = pa.RecordBatch.from_pydict({"sid": zero, "seg": seg, "ca": zero, "cb": zero})
    slabs = list(efficiency._slabs(rows.slice(at, 1000) for at in range(0, len(seg), 1000)))
    assert len(slabs) == 7 and [n for _, at in slabs for n in np.diff(at)] == sizes
    assert np.concatenate([t["seg"].to_numpy() for t, _ in slabs]).tolist() == seg.tolist()
    wide = pa.RecordBatch.from_pydict({c: np.repeat(np.arange(4), 800) if c == "seg" else np.zeros(3200, np.int64) for c in rows.schema.names})
    assert [at.tolist() for _, at in efficiency._slabs([wide])] == [[0, 800]] * 4


def test_small_segments_group_as_alone(spark):
    """Clusters of many segments in one slab, null vectors and parts without the other side included, by brute force."""
    rng = np.random.default_rng(3)
    data = [(s, g, i, rng.choice([-1.0, 0.0, 1.0], 4).tolist() if rng.random() < 0.9 else None) for s in range(6) for g in range(4) for i in range(g * 20, g * 20 + int(rng.integers(1, 16)))]
    rows = spark.createDataFrame(data, "sid int, seg int, idx int, vector array<double>")
    vectors = rows.select("sid", "idx", F.lit("command").alias("dim"), "vector")
    want = set()
    for key in {d[:2] for d in data}:
        own, head = [(i, np.array(v)) for s, g, i, v in data if (s, g) == key and v is not None], {}
        for i, x in own:
            linked = {head[j] for j, y in own if j < i and x @ y > 0.9 * (x @ x * (y @ y)) ** 0.5 > 0}
            head |= {j: min(linked) for j in head if head[j] in linked} | {i: min(linked, default=i)}
        groups = {h: tuple(sorted(j for j in head if head[j] == h)) for h in head.values()}
        want |= {(*key, members) for members in groups.values() if len(members) > 1}
    for chunk in (3, 1024):
        got = efficiency.duplicate_clusters(rows.select("sid", "seg", "idx"), vectors, chunk=chunk).collect()
        assert {(r.sid, r.seg, tuple(r.members)) for r in got} == want and len(got) == len(want)


def test_retrieval_gives_out_its_finds_bit_by_bit(spark, monkeypatch):
    """Texts come a few at a time and what they hold goes on in parts, with the same result; the session stays as it was."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    words = [f"anchor{i:03d}" for i in range(40)]
    pool = spark.createDataFrame([(i, i, " ".join(words[: i % 41])) for i in range(200)], "doc int, idx int, text string").coalesce(1)
    anchors = spark.createDataFrame([(1, w) for w in words], "req_id int, anchor string")
    want, before, seen = {w: sum(i % 41 > n for i in range(200)) for n, w in enumerate(words)}, spark.conf.get(name), []
    write = evidence.written
    monkeypatch.setattr(evidence, "written", lambda df: seen.append(int(spark.conf.get(name))) or write(df))
    monkeypatch.setattr(evidence, "PASS_FOUND", 7)
    assert {r.anchor: r.df for r in evidence.anchor_frequencies(pool, anchors).collect()} == want
    assert seen[-1] <= evidence.PASS_TEXTS <= 512 and spark.conf.get(name) == before


def test_small_products_do_not_multiply_what_is_shuffled(spark, monkeypatch):
    """Products of five rows, and of parts of a segment, give the same pairs; a row is dealt out once for a part."""
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([("s", 1, i, rng.normal(size=3).tolist()) for i in range(120)], "sid string, seg int, idx int, vector array<double>")
    vectors = rows.select("sid", "idx", F.lit("command").alias("dim"), "vector")
    dealt = []
    tiles = efficiency._tiles
    monkeypatch.setattr(efficiency, "_tiles", lambda *a: dealt.append(tiles(*a)) or dealt[-1])
    found = lambda chunk: sorted(tuple(r) for r in efficiency.duplicate_pairs(rows.select("sid", "seg", "idx"), vectors, chunk=chunk).collect())
    few, many = found(5), found(4096)
    monkeypatch.setattr(efficiency, "TILE", 30)
    assert few == many == found(5) and few and all(r[2] < r[3] for r in few)
    assert [d.count() for d in dealt] == [120, 120, 480]
