"""Shapes of documents that models write, and rule files by agent."""

import json

import pytest
from pyspark.sql import functions as F

from sparktrail.operators import goal, validators
from sparktrail.sources import normalized


def _docs(spark, *docs):
    return spark.createDataFrame([(str(i), d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "sid string, text string").select("sid", F.try_parse_json("text").alias("data"))


GOOD = {"global_grade": "A", "global_reason": "r", "per_segment": [{"seg": s, "grade": "B", "reason": "x"} for s in (1, 2)], "recommendations": ["do 1", "do 2", "do 3"]}


def test_judgements(spark):
    op = "words " * 30 + "12"
    docs = [GOOD, GOOD | {"global_grade": "E"}, GOOD | {"per_segment": GOOD["per_segment"][:1]}, "[]", GOOD | {"recommendations": ["none"] * 3}]
    docs += [GOOD | {"per_segment": [GOOD["per_segment"][0] | {"suspicious_ops": ops}, GOOD["per_segment"][1]]} for ops in ([op] * 6, [op] * 7, [op + " Seg 2"], ["short 12"], "text", None, [op[:-1]], [3])]
    known = spark.createDataFrame([(str(i), s) for i in range(len(docs)) for s in (1, 2)], "sid string, seg int")
    got = {r.sid: list(r.problems) for r in validators.judgement_documents(_docs(spark, *docs), known).collect()}
    every = ["document", "global_grade", "global_reason", "segments", "recommendations"]
    assert got == {"1": ["global_grade"], "2": ["segments"], "3": every, "4": ["recommendations"], **{str(i): ["operations"] for i in (6, 7, 8, 9, 11, 12)}}


def test_agent_maps(spark):
    good = {k: "x" for k in validators.AGENT_MAP} | {"skills": [{k: "x" for k in validators.SKILL}]}
    docs = [good, {k: v for k, v in good.items() if k != "hooks"}, good | {"skills": {}}, good | {"skills": [{"name": "x"}]}, "3"]
    got = {r.sid: list(r.problems) for r in validators.agent_maps(_docs(spark, *docs), "sid").collect()}
    assert got == {"1": ["fields"], "2": ["skills"], "3": ["skill"], "4": ["document", "fields", "skills"]}


def test_one_rule_file_for_an_agent(spark, tmp_path):
    for name, agent in (("a", "x"), ("b", "y"), ("c", "y")):
        (tmp_path / f"{name}.checks.json").write_text(json.dumps({"target_agent": agent, "checks": [name]}))
    (tmp_path / "d.checks.json").write_text("no json")
    files = normalized.rule_files(spark, str(tmp_path))
    agents = spark.createDataFrame([("x",), ("y",), ("z",)], "agent string")
    assert {(r.agent, r.problem, len(r.files)) for r in validators.sole_rules(files, agents).collect()} == {("y", "several", 2), ("z", "none", 0)}
    assert normalized.rules_of(spark, str(tmp_path), "x")["checks"] == ["a"]
    with pytest.raises(ValueError, match="2 rule files for y"):
        normalized.rules_of(spark, str(tmp_path), "y")


def test_packs_keep_to_their_budget(spark):
    lines = spark.createDataFrame([("s", "r1", 0, 0, "x" * 10, None), ("s", "r1", 1, 0, "y" * 10, "s#1"), ("s", "r2", 1, 0, "z" * 10, "s#2"), ("s", None, 5, 0, "c", None), ("t", "r1", 0, 0, "w" * 50, "t#1")], "sid string, req string, part int, place long, line string, ref string")
    texts, refs = goal.packs(lines, ["sid"], 22)
    assert {(r.sid, r.text, r.shown, r.left_out) for r in texts.collect()} == {("s", "x" * 10 + "\n" + "y" * 10, 2, 2), ("t", "", 0, 1)}
    assert {tuple(r) for r in refs.collect()} == {("s", "r1", "s#1")}
    cited = spark.createDataFrame([("s", "r1", ["s#1", "s#2"])], "sid string, req_id string, evidence_actions array<string>")
    assert [tuple(r) for r in goal.uncited(cited, refs, ("sid",)).collect()] == [("s", "r1", "s#2")]
