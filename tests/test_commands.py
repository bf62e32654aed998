"""What commands touch, set and reach."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparktrail.functions import commands
from sparktrail.functions.shell import subcommands
from sparktrail.operators import graph


@pytest.mark.parametrize(
    ("command", "cwd", "want"),
    [
        ("cat a.py > out.log", "/w", {("/w/a.py", "read"), ("/w/out.log", "write")}),
        ("python3 -u /x/run.py cfg.yaml 2>/dev/null", "/w", {("/x/run.py", "read"), ("/w/cfg.yaml", "read")}),
        ("/opt/venv/bin/python run.py", "/w", {("/w/run.py", "read")}),
        ("grep 'a b' x.txt | tee -a y.log", "/w", {("/w/x.txt", "read"), ("/w/y.log", "write")}),
        ("echo hi | tee y.log", "/w", {("/w/y.log", "write")}),
        ("sed -i s/a/b/ conf.ini", "/w", {("/w/conf.ini", "write")}),
        ("sed s/a/b/ conf.ini", "/w", {("/w/conf.ini", "read")}),
        ("chmod +x go.sh && ./go.sh", "/w", {("/w/go.sh", "write")}),
        ("cat > run.sh <<'EOF'\ncat in.txt\nEOF\n", "/w", {("/w/run.sh", "write")}),
        ("cat > run.sh <<'EOF'\ncat in.txt\nEOF\nbash run.sh", "/w", {("/w/run.sh", "write"), ("/w/in.txt", "read"), ("/w/run.sh", "read")}),
        ('LOG="/t/a.log" && tail "$LOG"', None, {("/t/a.log", "read")}),
        ("tail $LOG", None, set()),
        ("X=$(cat /t/p.txt)", None, {("/t/p.txt", "read")}),
        ("cat rel.txt", None, set()),
        ("cat *.txt", "/w", set()),
        ("cat /proc/x.txt", "/w", set()),
        ("cat ~/k.txt", "/w", {("~/k.txt", "read")}),
        ("ls a.py", "/w", set()),
        ("", "/w", set()),
        (None, None, set()),
    ],
)
def test_touched(command, cwd, want):
    assert set(commands.touched(command, cwd)) == want


def test_python_files():
    source = "from pathlib import Path\np = Path('a') / 'b.txt'\np.write_text('x')\np = 'c.csv'\ndf = read_csv(p)\nopen(f'{p}.bak', 'w')\nopen(q)\nshutil.copy('x', 'y')\nwith open('z.json') as f: pass"
    assert commands.python_files(source) == [("a/b.txt", "write"), ("c.csv", "read"), ("c.csv.bak", "write"), ("x", "read"), ("y", "write"), ("z.json", "read")]
    assert commands.python_files("not python (") == []


def test_canonical():
    same = [commands.canonical(c)[:2] for c in ("cd /w && python3 -c \"a = 1; print(a)\"", "FOO=1 python -c 'bb = 22; print(bb)' | head -5")]
    assert same[0] == same[1] and same[0][0] == "python"
    assert commands.canonical("cd /a && nohup  make   all")[1] == "make all"
    assert commands.canonical(None) == ("shell", "", "")


def test_subcommands():
    assert subcommands("a && b || c; d\ne | f & g") == ["a", "b", "c", "d", "e | f & g"]
    assert subcommands("echo 'x; y' \"a && b\"; z") == ["echo 'x; y' \"a && b\"", "z"]
    assert subcommands("echo \"a\\\"; b\"; c") == ['echo "a\\"; b"', "c"]
    assert subcommands("") == [] and subcommands(None) == [] and subcommands(" ;; ") == []


def test_variables_and_versions(spark):
    rows = [
        ("s", 0, "modify_file", "/w/a.py", None),
        ("s", 1, "run_command", None, "OUT=/w/o.log"),
        ("s", 2, "run_command", None, "python3 /w/a.py > $OUT"),
        ("s", 3, "run_command", None, "cat $OUT"),
        ("s", 4, "run_command", None, "OUT=$(date)"),
        ("s", 5, "run_command", None, "cat $OUT"),
        ("s", 6, "run_command", None, "sed -i s/a/b/ /w/a.py"),
        ("s", 7, "modify_file", "/w/a.py", None),
        ("s", 8, "read_file", "/w/a.py", None),
    ]
    acts = spark.createDataFrame([(*r, 1, None) for r in rows], "sid string, idx int, action string, path string, command string, turn int, error string")
    found = graph.command_touches(acts)
    assert {(r.idx, r.path, r.is_write) for r in found.collect()} == {(2, "/w/a.py", False), (2, "/w/o.log", True), (3, "/w/o.log", False), (6, "/w/a.py", True)}
    ents, edges = graph.with_commands(graph.touches(acts), found)
    assert {(r.key, r.version, r.producer_idx) for r in ents.collect()} == {("/w/a.py", 0, None), ("/w/a.py", 1, 0), ("/w/a.py", 2, 7), ("/w/a.py", 3, 6), ("/w/o.log", 1, 2)}
    used = {(r.idx, r.key, r.version, r.confidence) for r in edges.filter("kind = 'usedBy'").collect()}
    assert used == {(0, "/w/a.py", 0, "certain"), (7, "/w/a.py", 1, "certain"), (8, "/w/a.py", 2, "certain"), (2, "/w/a.py", 1, "likely"), (3, "/w/o.log", 1, "likely")}
    assert graph.violations(ents, edges).count() == 0
    pids = spark.createDataFrame([("s", 123, 1)], "sid string, pid int, born_idx int")
    talk = spark.createDataFrame([("s", 0, "kill 123"), ("s", 2, "kill 51234"), ("s", 3, "kill -9 123")], "sid string, idx int, command string")
    assert [r.idx for r in graph.pid_mentions(pids, talk).collect()] == [3]
    reach = spark.createDataFrame([("s", 1, "ssh -p 22 me@box ls; docker exec -it web sh"), ("s", 2, "ssh $HOST")], "sid string, idx int, command string")
    assert {(r.idx, r.key) for r in graph.host_edges(reach).collect()} == {(1, "ssh://me@box"), (1, "docker://web")}


RUN = "/w/out/run_20260811_101500.log"


def _told(output):
    import json

    return json.dumps({"Success": {"items": [{"Json": {"exit_status": "0", "stdout": output, "stderr": ""}}]}})


CASES = [
    # command, output, files touched by what the output tells, words left
    ("nohup python3 run.py > /w/out/run_$(date +%Y%m%d_%H%M%S).log 2>&1 &", f"PID=3301766\nLOG={RUN}\n", [(RUN, True)], []),
    ('tail -50 "$LOGFILE"', f"LOG={RUN}\n", [(RUN, False)], []),
    ("tail -50 /w/out/run_*.log", f"{RUN}\n", [(RUN, False)], []),
    ('echo x > "$LOGFILE"', f"LOG={RUN}\n", [(RUN, True)], []),
    ('tail -50 "$LOGFILE"', f"{RUN}\n/w/out/run_20260811_162941.log\n", [], []),
    ("tail -5 /w/other/run_*.log", f"{RUN}\n", [], ["/w/other/run_*.log"]),
    ("cat /w/a.log", f"{RUN}\n", [], []),
    ("ls -t /w/out/run_*.log", "", [], ["/w/out/run_*.log"]),
    ("D=/w/out; tail $D/run_*.log", f"LOG={RUN}\nTraceback (most recent call last):\n  File \"/w/src/run.py\", line 9, in <module>\n", [(RUN, False)], []),
    ("cat $X.txt", "made /w/b.txt here", [], ["$X.txt"]),
]


def test_what_outputs_tell(spark):
    rows = [("s", i, "run_command", c, _told(o)) for i, (c, o, _, _) in enumerate(CASES)]
    acts = spark.createDataFrame(rows, "sid string, idx int, action string, command string, response string")
    got, left = {}, {}
    for r in graph.resolved_touches(acts).collect():
        got.setdefault(r.idx, []).append((r.path, r.is_write))
    for r in graph.unresolved_words(acts).collect():
        left.setdefault(r.idx, []).append(r.word)
    for i, (_, _, want, open_) in enumerate(CASES):
        assert got.get(i, []) == want and sorted(left.get(i, [])) == open_, CASES[i]
    pids = graph.pids(acts)
    assert [tuple(r) for r in pids.collect()] == [("s", "3301766", 0)]
    later = spark.createDataFrame([("s", 20, "kill 3301766"), ("s", 21, "kill 33017660")], "sid string, idx int, command string")
    assert [r.idx for r in graph.pid_mentions(pids, later).collect()] == [20]


def test_outputs_of_other_forms(spark):
    df = spark.createDataFrame([("/a/b.c\n",), ("Successfully created /tmp/out.sh (10 lines).",), ("Successfully replaced 3 occurrence(s) in /tmp/x.py.",), ("{not json",), (None,), ('{"Success": {"items": [{"Text": "A=/q"}]}}',), ("  PID STAT ELAPSED",)], "response string")
    from pyspark.sql import functions as F

    from sparktrail.functions.commands import paths_said, said_by_tool

    assert [r[0] for r in df.select(paths_said(said_by_tool(F.col("response")))).collect()] == [["/a/b.c"], ["/tmp/out.sh"], ["/tmp/x.py"], [], [], ["/q"], []]


@pytest.mark.parametrize(
    ("command", "want"),
    [
        ("for f in a.yaml b.yaml; do grep -q x \"$f\"; done", {("/w/a.yaml", "read"), ("/w/b.yaml", "read")}),
        ("for s in A B; do for t in 1 2; do cat /d/${s}$t.txt; done; done", {(f"/d/{s}{t}.txt", "read") for s in "AB" for t in "12"}),
        ("for f in $(ls); do cat $f.txt; done; cat z.txt", {("/w/z.txt", "read")}),
        ("for f in one; do echo x > $f.log; done && cat two.log", {("/w/one.log", "write"), ("/w/two.log", "read")}),
        ("timeout 240 python3 /w/run.py", {("/w/run.py", "read")}),
        ("sudo nohup env A=b timeout 1.5s python3 -u run.py > out.log", {("/w/run.py", "read"), ("/w/out.log", "write")}),
        ("git diff --stat /w/d.md", {("/w/d.md", "read")}),
        ("git add d.md e.md && git commit -m x", {("/w/d.md", "write"), ("/w/e.md", "write")}),
        ("git show HEAD > s.txt", {("/w/s.txt", "write")}),
        ("git push origin x.md", set()),
        ("diff <(sed s/a/b/ /w/one.sh) /w/two.sh", {("/w/one.sh", "read"), ("/w/two.sh", "read")}),
        ("rm a.txt; ls b.txt; touch c.txt", set()),
        ("ls > names.txt", {("/w/names.txt", "write")}),
    ],
)
def test_wrappers_loops_and_version_control(command, want):
    assert want <= set(commands.touched(command, "/w")) and {p for p, _ in commands.touched(command, "/w")} == {p for p, _ in want}


@pytest.mark.parametrize(
    ("command", "want"),
    [
        ("(cd sub && cat a.txt); cat b.txt", {("/w/sub/a.txt", "read"), ("/w/b.txt", "read")}),
        ("cd sub | cat a.txt; cat b.txt", {("/w/a.txt", "read"), ("/w/b.txt", "read")}),
        ("cd sub && cat a.txt && cat b.txt", {("/w/sub/a.txt", "read"), ("/w/sub/b.txt", "read")}),
        ("cd /d; for i in 1 2; do cd x; cat a.txt; done; cat b.txt", {("/d/x/a.txt", "read"), ("/d/x/x/a.txt", "read"), ("/d/b.txt", "read")}),
        ("if cd k; then cat a.txt; else cat b.txt; fi; cat c.txt", {("/w/k/a.txt", "read"), ("/w/k/b.txt", "read"), ("/w/c.txt", "read")}),
        ("(cd a; (cd b; cat 1.txt); cat 2.txt) && cat 3.txt", {("/w/a/b/1.txt", "read"), ("/w/a/2.txt", "read"), ("/w/3.txt", "read")}),
        ("cd a & cat b.txt", {("/w/b.txt", "read")}),
        ("cd $UNKNOWN && cat a.txt; cat /b.txt", {("/b.txt", "read")}),
        ("D=/d; cd $D && cat a.txt", {("/d/a.txt", "read")}),
        ("gcc -O2 -o /w/a.out /w/b.c c.c", {("/w/a.out", "write"), ("/w/b.c", "read"), ("/w/c.c", "read")}),
        ("sort --output=s.txt t.txt", {("/w/s.txt", "write"), ("/w/t.txt", "read")}),
        ("python3 - <<'EOF'\nopen('x.csv')\nopen('/t/%s.txt' % 'y', 'w')\nEOF\ncat z.txt", {("/w/x.csv", "read"), ("/t/y.txt", "write"), ("/w/z.txt", "read")}),
        ("python3 -c \"open('q.json')\"", {("/w/q.json", "read")}),
        ("cat > a.py <<EOF\nopen('in.csv')\nEOF\npython3 a.py", {("/w/a.py", "write"), ("/w/in.csv", "read"), ("/w/a.py", "read")}),
        ("cat > a.py <<EOF\nopen('in.csv')\nEOF\n", {("/w/a.py", "write")}),
        ("bash <<EOF\ncat a.txt > b\nEOF", {("/w/a.txt", "read"), ("/w/b", "write")}),
        ("bash -c 'cat p.txt'", {("/w/p.txt", "read")}),
        ("cat <<A > one.txt; cat <<B > two.txt\n1 > no.txt\nA\n2\nB\n", {("/w/one.txt", "write"), ("/w/two.txt", "write")}),
        ("cat a.txt >/dev/null 2>&1; echo x &> all.log", {("/w/a.txt", "read"), ("/w/all.log", "write")}),
        ("ssh me@box cat /x.txt", set()),
        ("grep a.txt b.log; grep -e a.txt c.log", {("/w/b.log", "read"), ("/w/c.log", "read")} | {("/w/a.txt", "read")}),
        ("python -m py_compile m.py", {("/w/m.py", "read")}),
    ],
)
def test_scopes_programs_and_outputs(command, want):
    assert set(commands.touched(command, "/w")) == want


def test_loops_are_written_out_up_to_a_length():
    text = "".join(f"for v{i} in 1 2 3 4 5 6 7 8 9; do " for i in range(9)) + "cat /x/$v0.txt; " + "done; " * 9 + "cat /y.txt"
    assert len(commands.unrolled(text)) <= commands.UNROLLED and ("/y.txt", "read") in commands.touched(text)


def test_python_environment_and_format():
    source = "import os\nopen(os.environ['D'] + '/a.txt')\nopen(os.getenv('E', '/e') + '/b.txt')\nopen('%s/%d' % (x, 1))\nopen('%s/c.txt' % os.environ.get('D'))"
    assert commands.python_files(source, {"D": "/d"}) == [("/d/a.txt", "read"), ("/e/b.txt", "read"), ("/d/c.txt", "read")]


_ACTION = "sid string, idx int, action string, path string, root string, pattern string, command string, response string, turn int, error string"


def _acts(spark, *rows):
    named = [c.split()[0] for c in _ACTION.split(", ")]
    return spark.createDataFrame([tuple({"sid": "s", "action": "run_command", "turn": 1, **r}.get(n) for n in named) for r in rows], _ACTION)


def test_provenance_of_everything(spark):
    acts = _acts(
        spark,
        {"idx": 0, "command": "cat /w/later.txt; tail /w/log.txt"},
        {"idx": 1, "action": "create_file", "path": "/w/later.txt"},
        {"idx": 2, "command": "nohup python3 run.py > /w/out/r_$(date +%s).log & echo PID=$!", "root": "/w", "response": _told("PID=3304381\nLOG=/w/out/../out/r_1.log\n/w/out\n")},
        {"idx": 3, "command": "ps -p 3304381; kill 33043812; cat /w/later.txt"},
        {"idx": 4, "command": "ssh me@box; bash $TOOLS/x.sh; cat $OUT/y.log"},
        {"idx": 5, "command": "OUT=$(date); ps -p 3304381", "response": _told("PID=3304381\n")},
    )
    ents, edges = graph.provenance(acts)
    got = {(r.idx, r.key, r.version, r.kind, r.confidence) for r in edges.collect()}
    assert got == {
        (0, "/w/log.txt", 0, "usedBy", "likely"),
        (1, "/w/later.txt", 1, "generatedBy", "certain"),
        (2, "/w/run.py", 0, "usedBy", "likely"),
        (2, "/w/out/r_1.log", 1, "generatedBy", "likely"),
        (2, "3304381", 1, "generatedBy", "likely"),
        (3, "3304381", 1, "usedBy", "likely"),
        (3, "/w/later.txt", 1, "usedBy", "likely"),
        (4, "ssh://me@box", 0, "connectedBy", "likely"),
        (4, "$TOOLS/x.sh", 0, "usedBy", "weak"),
        (5, "3304381", 1, "generatedBy", "likely"),
        (5, "3304381", 1, "usedBy", "likely"),
    }
    assert {(r.key, r.entity) for r in ents.filter("entity <> 'file'").collect()} == {("ssh://me@box", "host"), ("3304381", "pid")}
    assert ents.groupBy("sid", "key", "version").count().filter("count > 1").count() == 0


def test_provenance_of_nothing(spark):
    ents, edges = graph.provenance(_acts(spark, {"idx": 0, "command": None}))
    assert ents.count() == 0 and edges.count() == 0


def test_reads_of_a_key_are_not_joined_with_its_versions(spark):
    acts = _acts(spark, {"idx": 0, "command": "cat /a.txt"})
    plan = graph.provenance(acts)[1]._jdf.queryExecution().optimizedPlan().toString()
    assert "BETWEEN UNBOUNDED PRECEDING" in plan.upper() or "unboundedpreceding" in plan
    rows = [{"idx": i, "command": "cat /a.log" if i % 3 else "echo x > /a.log"} for i in range(3000)]
    edges = graph.provenance(_acts(spark, *rows))[1]
    assert {(r.idx, r.version) for r in edges.filter("kind = 'usedBy'").collect()} == {(i, i // 3 + 1) for i in range(3000) if i % 3}


def test_probes_meet_what_lies_below(spark):
    acts = _acts(spark, {"idx": 0, "action": "read_file", "path": "/w/a/x.py"}, {"idx": 1, "action": "read_file", "path": "/w/ab/y.py"}, {"idx": 2, "action": "search_content", "path": "/w/a/", "root": "/w/a/", "pattern": "z"}, {"idx": 3, "action": "list_dir", "path": "/"}, {"idx": 4, "action": "search_files", "root": "/w/ab/y.py"}, {"idx": 5, "action": "code_search_symbols"})
    found = graph.probes(acts)
    assert {(r.idx, r.pattern, r.path, r.root) for r in found.collect()} == {(2, "z", "/w/a/", None), (3, None, "/", None), (4, None, None, "/w/ab/y.py")}
    met = graph.probed_artifacts(found, graph.entities(graph.touches(acts)))
    assert {(r.idx, r.key) for r in met.collect()} == {(2, "/w/a/x.py"), (3, "/w/a/x.py"), (3, "/w/ab/y.py"), (4, "/w/ab/y.py")}


def test_mentions_without_an_edge(spark):
    acts = _acts(spark, *({"idx": i, "command": c} for i, c in enumerate(["echo '/w/deep/report.md'", "grep report.md", "x report.m", "vi /q.c", "ls q.c", "see /a", "cat"])))
    ents = spark.createDataFrame([("s", k) for k in ("/w/deep/report.md", "/q.c", "/a", "/x/cat.py")], "sid string, key string")
    edges = spark.createDataFrame([("s", 1, "/w/deep/report.md")], "sid string, idx int, key string")
    assert {(r.idx, r.key) for r in graph.unlinked_mentions(acts, ents, edges).collect()} == {(0, "/w/deep/report.md"), (3, "/q.c"), (5, "/a")}


def test_equal_commands_of_a_batch_are_read_once():
    """What Python makes of a command depends on it, its directory and its variables alone."""
    seen = []

    def read(command, env):
        seen.append(command)
        return [command, len(env)]

    envs = [[("A", "1")], {"A": "1"}, [], [("A", "1")]]
    got = commands._once(read, pd.Series(["x", "x", "x", "y"]), pd.Series(envs, dtype=object))
    assert got.tolist() == [["x", 1], ["x", 1], ["x", 0], ["y", 1]] and seen == ["x", "x", "y"]


def test_a_record_is_parsed_once(spark):
    """Its parsed form is named once in the plan; records of other forms, and empty ones, are as they are."""
    rows = [('{"Success": {"items": [{"Json": {"stdout": "a", "stderr": ""}}, {"Text": "b"}]}}',), ('{"Error": {"items": [{"Json": {"stderr": "c"}}]}}',), ('{"Success": {"items": []}}',), ("plain",), ("",), (None,)]
    df = spark.createDataFrame(rows, "response string").select(commands.said_by_tool(F.col("response")).alias("said"))
    assert [r.said for r in df.collect()] == ["a\nb", "c", '{"Success": {"items": []}}', "plain", "", ""]
    assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1
