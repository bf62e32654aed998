"""Queries over all rows of their tables, against brute force."""

import datetime
import json
import re

from sparktrail.operators import normalize
from sparktrail.plans import q_sessions
from sparktrail.plans.all_queries import QUERIES


def _words(text):
    return re.sub(r"\W+", "", text)


def test_quotes_of_all_conversations(spark, tmp_path):
    """Texts beyond ASCII count, and quotes that are not said fail."""
    rows = [(1, 0, "Où est « l’été » ?"), (1, 1, "Il est là."), (1, 2, "Il est là, dit-elle: où."), (2, 0, "日本語 テスト"), (2, 1, "日本語、テスト!"), (3, 0, "naïve"), (3, 1, "nave"), (4, 0, None), (4, 1, "x y")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {tuple(r) for r in QUERIES["goal_quote_filter"](spark, str(tmp_path)).collect()}
    texts = {(c, t): x for c, t, x in rows}
    claims = [(c, t, name, texts.get(at)) for c, t, _ in rows for name, at in (("own", (c, t)), ("before", (c, t - 1)))]
    claims = [x for x in claims if x[3] is not None]
    want = {x[:3] for x in claims if _words(x[3][:40]) in _words(texts[x[:2]] or "")}
    assert got == want
    assert {(1, 2, "before"), (2, 1, "before"), (3, 0, "own")} <= got and not {(1, 1, "before"), (3, 1, "before")} & got


def test_quotes_of_the_table(spark, sf_dir):
    said = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}
    got = {tuple(r) for r in QUERIES["goal_quote_filter"](spark, sf_dir).collect()}
    claims = [(c, t, name, said.get((c, at))) for c, t in said for name, at in (("own", t), ("before", max((u for d, u in said if d == c and u < t), default=None)))]
    claims = [x for x in claims if x[3] is not None]
    assert got == {x[:3] for x in claims if _words(x[3][:40]) in _words(said[x[:2]])}
    assert {(c, t) for c, t, name in got if name == "own"} == set(said) and len(got) < len(claims)


def test_subsets_are_not_whole(spark, sf_dir):
    """All sessions are roots, all errors centres and flags, and all sessions stand side by side."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type").collect()
    sessions, errors = {r.user_id for r in events}, sum(r.event_type == "error" for r in events)
    tree = {(r.root, r.sid): r.depth for r in QUERIES["ev_run_tree"](spark, sf_dir).collect()}
    want = {}
    for sid in sessions:
        at, depth = sid, 0
        while at in sessions and depth <= 3:
            want[at, sid] = depth
            at, depth = at // 3 or None, depth + 1
    assert tree == want
    assert QUERIES["ev_window_pm2"](spark, sf_dir).select("sid", "centre").distinct().count() == errors
    assert QUERIES["tune_flag_context"](spark, sf_dir).select("flag_id").distinct().count() == errors
    assert QUERIES["norm_side_by_side"](spark, sf_dir).count() == len(events)


def test_side_by_side_needs_both(spark):
    acts = spark.createDataFrame([("a", 0, "read"), ("a", 1, "shell"), ("b", 0, "read"), ("b", 1, "read")], "sid string, idx int, tool string")
    hook = spark.createDataFrame([("a", 0, "fs_read"), ("a", 1, "fs_write"), ("b", 1, "fs_read")], acts.schema)
    assert {(r.sid, r.idx, r.same) for r in normalize.side_by_side(hook, acts).collect()} == {("a", 0, True), ("a", 1, False)}


def _alike(a, b):
    from collections import Counter

    def counts(text):
        words = text.lower().split()
        return Counter([*words, *map(" ".join, zip(words, words[1:], strict=False))])

    x, y = counts(a), counts(b)
    return sum(n * y[w] for w, n in x.items()) / (sum(n * n for n in x.values()) * sum(n * n for n in y.values())) ** 0.5


def test_grades_know_duplicate_work(spark, sf_dir):
    """Clusters of three and more by brute force; with one a segment is at best B, with two C."""
    acts = q_sessions._acts(spark, sf_dir)
    commands, parent = [r for r in acts.filter("action = 'run_command'").collect()], {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    by_segment = {}
    for r in commands:
        by_segment.setdefault((r.sid, r.seg), []).append(r)
    for own in by_segment.values():
        for i, x in enumerate(own):
            for y in own[i + 1 :]:
                c, p = _alike(x.command, y.command), _alike(x.purpose, y.purpose)
                if c > 0.9 or p > 0.85 or c > 0.8 and p > 0.8:
                    parent[root((y.sid, y.seg, y.idx))] = root((x.sid, x.seg, x.idx))
    groups = {}
    for r in commands:
        groups.setdefault(root((r.sid, r.seg, r.idx)), set()).add(r.idx)
    want = {}
    for (sid, seg, _), members in groups.items():
        want[sid, seg] = want.get((sid, seg), 0) + (len(members) >= 3)
    got = {(r.sid, r.seg): r for r in QUERIES["eff_grade_clusters"](spark, sf_dir).collect()}
    before = {(r.sid, r.seg): r.grade for r in QUERIES["eff_grade"](spark, sf_dir).collect()}
    assert {k: r.clusters for k, r in got.items()} == {k: want.get(k, 0) for k in got} and any(want.values())
    for k, r in got.items():
        assert r.grade == max(before[k], "C" if r.clusters >= 2 else "B" if r.clusters else "A")


def test_report_knows_duplicate_work(spark, tmp_path):
    """One session that runs a command three times and nothing else of note."""
    start = datetime.datetime(2024, 1, 1)
    kinds = ["click"] * 3 + ["signup", *["view"] * 3] * 12
    rows = [(7, i, start + datetime.timedelta(minutes=i), kind, 1.0, json.dumps({"k": 5 if kind == "click" else 20 + i})) for i, kind in enumerate(kinds)]
    spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    told = json.loads(QUERIES["eff_report"](spark, str(tmp_path)).collect()[0].report)
    assert told["duplicates"] == [{"seg": 1, "members": [0, 1, 2], "dominant_reason": "command_strong"}]
    assert QUERIES["eff_grade_clusters"](spark, str(tmp_path)).filter("seg = 1").collect()[0].clusters == 1
