"""Pairing over micro-batches gives what pairing of the whole log gives."""

import json
import random

from sparktrail.operators.normalize import pair_calls
from sparktrail.streaming import live


def test_pairing_over_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for sid in ("s1", "s2", "s3"):
        for n in range(60):
            event = rng.choice(["pre_tool_use", "pre_tool_use", "post_tool_use", "tool_blocked", "user_prompt"])
            rows.append({"n": n, "session_id": sid, "event": event, "tool": rng.choice(["a", "b"]), "tool_input": {"k": rng.randint(0, 2)}})
    src = tmp_path / "in" / "x"
    src.mkdir(parents=True)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for part, lo in enumerate(range(0, 60, 20)):
        (src / f"{part}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows if lo <= r["n"] < lo + 20))
        query = live.write(live.paired(live.follow(spark, str(tmp_path / "in"))), out, check)
        assert query.awaitTermination(120)
    got = {(r.sid, r.call, r.line_no, r.end_no, r.outcome) for r in spark.read.parquet(out).collect()}
    whole = spark.createDataFrame([(r["session_id"], r["n"], r["event"], r["tool"], json.dumps(r["tool_input"])) for r in rows], "sid string, line_no int, event string, tool string, tool_input string")
    want = pair_calls(whole).collect()
    assert {(g[0], g[1], g[2]) for g in got} == {(r.sid, r.call, r.line_no) for r in want if r.end_no is not None or r.blocked}
    assert {(g[0], g[1], g[3]) for g in got if g[4] == "ended"} == {(r.sid, r.call, r.end_no) for r in want if r.end_no is not None}


def test_silent_sessions_leave_orphans(spark, tmp_path):
    src = tmp_path / "in" / "x"
    src.mkdir(parents=True)
    rows = [{"n": i, "session_id": "s", "event": "pre_tool_use", "tool": "a", "tool_input": {"k": i}} for i in range(3)] + [{"n": 3, "session_id": "s", "event": "post_tool_use", "tool": "a", "tool_input": {"k": 1}}]
    (src / "0.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    query = live.write(live.paired(live.follow(spark, str(tmp_path / "in")), timeout_ms=500), str(tmp_path / "out"), str(tmp_path / "check"), once=False)
    try:
        for _ in range(60):
            query.awaitTermination(2)
            got = {(r.call, r.outcome) for r in spark.read.schema(live.CALL).parquet(str(tmp_path / "out")).collect()} if list((tmp_path / "out").glob("*.parquet")) else set()
            if len(got) == 3:
                break
    finally:
        query.stop()
    assert got == {(0, "orphan"), (1, "ended"), (2, "orphan")}
