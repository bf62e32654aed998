"""Readers of session records and hook logs, on small files."""

import json

import pytest
from pyspark.sql import functions as F

from sparktrail.operators import normalize
from sparktrail.sources import hooks, normalized, official


def _write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))


def _say(mid, *content):
    return {"kind": "AssistantMessage", "data": {"message_id": mid, "content": list(content)}}


def _use(tid, name, **args):
    return {"kind": "toolUse", "data": {"toolUseId": tid, "name": name, "input": args}}


@pytest.fixture(scope="module")
def record(tmp_path_factory):
    d = tmp_path_factory.mktemp("official")
    turns = [
        {"builtin_tool_uses": 3, "total_request_count": 2, "number_of_cycles": 4, "end_reason": "UserTurnEnd", "turn_duration": {"secs": 3, "nanos": 500000000}, "metering_usage": [{"value": 0.1}, {"value": 0.2}], "message_ids": ["m1", "m2"]},
        {"turn_duration": 7, "metering_usage": [], "message_ids": ["m3"]},
    ]
    meta = {"session_id": "s1aaaaaaa", "cwd": "/w", "created_at": "2026-01-01T00:00:00Z", "updated_at": "2026-01-01T00:01:00.5Z", "title": "do it", "parent_session_id": "p0", "session_state": {"agent_name": "dev", "conversation_metadata": {"user_turn_metadatas": turns}}}
    (d / "s1aaaaaaa.json").write_text(json.dumps(meta))
    (d / "broken.json").write_text("{")
    _write(
        d / "s1aaaaaaa.jsonl",
        [
            {"kind": "Prompt", "data": {"content": [{"kind": "text", "data": "hello "}, {"kind": "text", "data": {"text": "you"}}]}},
            _say("m1", {"kind": "thinking", "data": {"text": "hm"}}, {"kind": "text", "data": "ok"}, _use("t1", "fs_read", operations=[{"mode": "Line", "path": "a.py"}, {"mode": "Image", "image_paths": ["x.png", "y.png"]}, 5]), _use("t2", "execute_bash", command="cd /w && make; echo 'a;b'", __tool_use_purpose="build")),
            {"kind": "ToolResults", "data": {"results": {"t1": {"result": {"Success": {"items": []}}}, "t2": {"result": {"Error": "bad"}}}}},
            "not json",
            "",
            {"kind": "Compaction", "data": {}},
            _say("m2", _use("t3", "fs_write", command="str_replace", path="a.py"), _use("t4", "mystery", a=1)),
            {"kind": "ToolResults", "data": {"results": {"t2": {"result": {"Success": 1}}, "t4": {"result": {"Error": "The tool arguments failed validation"}}}}},
            {"kind": "Prompt", "data": {"content": [{"kind": "text", "data": "more"}]}},
            _say("m3", {"kind": "text", "data": "done"}, _use("t5", "subagent", stages=[{"role": "r1", "name": "n1"}, {"role": "r2", "name": "n2"}])),
        ],
    )
    return str(d)


def test_sessions_and_turns(spark, record):
    sessions = official.read_sessions(spark, record)
    assert [(r.sid, r.agent_name, r.parent, r.title) for r in sessions.collect() if r.agent_name] == [("s1aaaaaaa", "dev", "p0", "do it")]
    assert official.read_sessions(spark, record, cwd="/else").count() == 0
    turns = official.turn_meta(sessions).orderBy("turn").collect()
    assert [(t.turn, t.dur_s, t.credits, t.cycles) for t in turns] == [(1, 3.5, 0.3, 4), (2, 7.0, None, None)]
    assert official.children(sessions).collect()[0].children == ["s1aaaaaaa"]


def test_actions_of_a_record(spark, record):
    events = official.read_events(spark, record)
    rows = official.actions(events, with_responses=True).orderBy("idx").collect()
    assert [(r.idx, r.call_idx, r.op_idx, r.turn, r.tool, r.action, r.path, r.pattern) for r in rows] == [
        (0, 0, 0, 1, "read", "read_file", "a.py", None),
        (1, 0, 1, 1, "read", "read_image", "x.png", None),
        (2, 0, 2, 1, "read", "read_image", "y.png", None),
        (3, 1, 0, 1, "shell", "run_command", None, None),
        (4, 2, 0, 1, "write", "modify_file", "a.py", None),
        (5, 3, 0, 1, "mystery", "unknown:mystery", None, None),
        (6, 4, 0, 2, "subagent", "spawn_subagent", None, "r1"),
        (7, 4, 1, 2, "subagent", "spawn_subagent", None, "r2"),
    ]
    shell = rows[3]
    assert shell.subcommands == ["cd /w", "make", "echo 'a;b'"] and shell.cwd == "/w" and shell.purpose == "build" and shell.reasoning == "hm"
    assert shell.completed and shell.error == "bad", "a later success completes, an error once said stays"
    assert rows[0].completed and rows[4].completed and not rows[5].completed and rows[7].command == "n2" and rows[0].ref == "s1aaaaaa#0"
    thoughts = official.thinkings(events, official.actions(events)).collect()
    assert [(t.turn, t.text, t.action_idx) for t in thoughts] == [(1, "hm", [0, 1, 2, 3])]
    assert [(r.turn, r.text) for r in official.prompts(events).orderBy("turn").collect()] == [(1, "hello you"), (2, "more")]
    assert [(r.turn, r.text) for r in official.responses(events).orderBy("line_no").collect()] == [(1, "ok"), (2, "done")]
    assert {(r.kind, r.n) for r in official.kind_counts(events).collect()} == {(None, 1), ("Compaction", 1)}


def test_texts_by_turn(spark, record):
    turns = official.turn_meta(official.read_sessions(spark, record))
    rows = official.texts_by_turn(official.read_events(spark, record), turns).orderBy("turn").collect()
    assert rows[0].assistant_text == "ok" and rows[0].tools == ["fs_read", "execute_bash", "fs_write", "mystery"] and rows[0].rejected == ["mystery"]
    assert rows[1].tools == ["subagent"] and rows[1].rejected == []


@pytest.fixture(scope="module")
def log(tmp_path_factory):
    d = tmp_path_factory.mktemp("hook")
    pre = lambda ts, tool, **a: {"ts": f"2026-01-01T00:00:{ts}Z", "event": "pre_tool_use", "tool": tool, "tool_input": a, "cwd": "/w"}
    post = lambda ts, tool, **a: {"ts": f"2026-01-01T00:00:{ts}Z", "event": "post_tool_use", "tool": tool, "tool_input": a, "response_size": 9}
    _write(
        d / "2026-01-01" / "h1" / "trace.jsonl",
        [
            {"ts": "2026-01-01T00:00:00Z", "event": "agent_spawn", "agent_name": "dev", "cwd": "/w"},
            {"event": "user_prompt", "prompt": "do it now", "ts": "2026-01-01T00:00:01Z"},
            pre("02", "fs_read", operations=[{"mode": "Line", "path": "../x/./a.py"}]),
            pre("03", "shell", command="one"),
            pre("04", "shell", command="two"),
            post("05", "shell", command="one"),
            post("06", "shell", command="other"),
            post("07", "fs_read", operations=[{"mode": "Line", "path": "../x/./a.py"}]),
            post("08", "glob", pattern="*"),
            pre("09", "fs_write", command="create", path="b"),
            {"event": "tool_blocked", "tool": "fs_write", "tool_input": {}},
            "{oops",
            {"event": "user_prompt", "prompt": "again"},
            pre("20", "shell", command="three"),
            {"event": "stop"},
        ],
    )
    return str(d)


def test_hook_pairing(spark, log):
    events = hooks.read_events(spark, log)
    rows = hooks.actions(events).orderBy("idx").collect()
    assert [(r.sid, r.action, r.turn, r.completed, r.blocked, r.duration_ms) for r in rows] == [
        ("h1", "read_file", 1, True, False, 5000),
        ("h1", "run_command", 1, True, False, 2000),
        ("h1", "run_command", 1, True, False, 2000),
        ("h1", "create_file", 1, False, True, None),
        ("h1", "run_command", 2, False, False, None),
    ]
    assert rows[0].path == "/x/a.py" and rows[3].path == "/w/b" and rows[1].cwd == "/w"
    told = {r.warning: r.n for r in hooks.warnings(events).collect()}
    assert told == {"bad lines": 1, "calls without an end": 1, "ends without a call": 1, "turns without a stop": 1}
    run = hooks.runs(events).collect()
    assert [(r.run, r.prompt, r.agent_name, r.cwd) for r in run] == [(1, "do it now", "dev", "/w")]
    assert [r.sid for r in hooks.list_logs(spark, log).collect()] == ["h1"]


def test_runs_find_their_sessions(spark):
    runs = spark.createDataFrame([("h", 1, "do it now please", "2026-01-01 00:00:10", "/w"), ("h", 2, "do it now again", "2026-01-01 00:01:00", "/w"), ("h", 3, "else", "2026-01-01 00:02:00", "/w")], "sid string, run int, prompt string, started_at string, cwd string").withColumn("started_at", F.to_timestamp("started_at"))
    sessions = spark.createDataFrame([("a", "do it now…", "/w", "2026-01-01 00:00:50"), ("b", "do it now…", "/w", "2026-01-01 00:00:12"), ("c", "do it", "/other", "2026-01-01 00:00:10"), ("d", "do it", "/w", "2026-01-01 09:00:10")], "sid string, title string, cwd string, at string")
    sessions = sessions.select("sid", "title", "cwd", F.to_timestamp("at").alias("created_at"), F.to_timestamp("at").alias("modified_at"))
    found = {r.run: r.session for r in normalize.attribute_runs(runs, sessions).collect()}
    assert found == {1: "b", 2: "a", 3: None}


def test_backfill_uses_each_success_once(spark):
    make = lambda rows: spark.createDataFrame(rows, "sid string, idx int, tool string, action string, command string, path string, pattern string, root string, completed boolean, blocked boolean")
    hook = make([("s", i, "shell", "run_command", "make", None, None, None, False, False) for i in range(3)])
    known = make([("s", i, "execute_bash", "run_command", "make", None, None, None, True, False) for i in range(2)])
    assert [(r.idx, r.completed, r.official_verified) for r in normalize.backfilled(hook, known).orderBy("idx").collect()] == [(0, True, True), (1, True, True), (2, False, False)]


def test_tool_differences(spark):
    rows = lambda *tools: spark.createDataFrame([("s", t) for t in tools], "sid string, tool string")
    official_, hook = rows("fs_read", "read", "shell", "grep"), rows("read", "execute_bash", "glob")
    diff = normalize.tool_differences(official_, hook, rows("grep"))
    assert {(r.tool, r.missing, r.extra, r.explained) for r in diff.collect()} == {("read", 1, 0, 0), ("grep", 1, 0, 1), ("glob", 0, 1, 0)}
    assert normalize.coverage(official_, hook, diff).collect()[0].level == "suspected missing record"


def test_normalized_source(spark, tmp_path):
    path = tmp_path / "n.json"
    path.write_text(json.dumps({"session_id": "s", "actions": [{"action": "read_file", "path": "a"}, {"idx": 7, "action": "run_command", "completed": False}]}))
    rows = normalized.read_actions(spark, str(path)).orderBy("idx").collect()
    assert [(r.sid, r.idx, r.action, r.completed) for r in rows] == [("s", 0, "read_file", True), ("s", 7, "run_command", False)]
    config = tmp_path / "c.json"
    config.write_text('{"_doc": 1, "a": {"_x": 2, "b": [3]}}')
    assert normalized.read_config(spark, str(config)) == {"a": {"b": [3]}}


def test_command_line(spark, record, log, tmp_path):
    from sparktrail.__main__ import WHAT, main

    checks = tmp_path / "rules.json"
    checks.write_text(json.dumps({"checks": [{"id": "made", "runs": "make"}, {"id": "no", "never_dispatches": "r2"}]}))
    told = main(["rules", "--official", record, "--rules", str(checks), "--scoring", str(tmp_path / "none.json")]).collect()
    assert [(r.sid, r.verdict, r.health) for r in told] == [("s1aaaaaaa", "FAIL", 0.333)]
    for what in sorted(set(WHAT) - {"rules"}):
        for source in (["--official", record], ["--hook", log]):
            out = str(tmp_path / f"{what}-{source[0][2:]}")
            main([what, *source, "--out", out])
            assert spark.read.json(out).count() > 0, what


def test_long_logs_are_read_in_splits(spark, tmp_path):
    """One file in many splits, another in one: numbers are those of the lines, blank ones counted."""
    from sparktrail.sources.lines import numbered

    texts = {"long": [f"line {i} " + "x" * (i % 50) if i % 7 else "" for i in range(4000)], "short": ["a", "", "b"]}
    for name, own in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "trace.jsonl").write_text("\n".join(own) + ("\n" if name == "long" else ""))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = numbered(spark, str(tmp_path), "trace.jsonl", nested=True)
        got = {(r.file.split("/")[-2], r.line_no): r.line for r in rows.collect()}
        assert spark.read.text(f"{tmp_path}/long").rdd.getNumPartitions() > 5
        events = hooks.read_events(spark, str(tmp_path)).groupBy("sid").count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(name, i): line for name, own in texts.items() for i, line in enumerate(own)}
    assert {r["sid"]: r["count"] for r in events} == {"long": sum(i % 7 > 0 for i in range(4000)), "short": 2}
