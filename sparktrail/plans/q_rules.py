"""Queries: predicates, rules, verdicts and grading of rules over the stand-in sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrail.operators import rules
from sparktrail.operators.predicates import find, matches, reading, running, serialised, writing
from sparktrail.plans.catalog import query
from sparktrail.sources.standin import ACTIONS_SQL, actions, with_matcher_fields


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_matcher_fields(actions(spark, sf_dir))


#: The searchable text of an action in SQL.
TEXT_SQL = "concat_ws(chr(10), action, tool, coalesce(command, ''), coalesce(path, ''), '', '')"
_FIRST = lambda cond, n: f"list_slice(list_sort(coalesce(list(idx) FILTER (WHERE {cond}), [])), 1, {n})"


def _one(spark: SparkSession, sf_dir: str, rule: dict) -> DataFrame:
    out = rules.evaluate(_sessions(spark, sf_dir), [rule])
    return out.select("sid", "passed", F.round("score", 6).alias("score"), F.concat_ws(",", "evidence").alias("evidence"))


def _one_sql(passed: str, evidence: str, score: str | None = None) -> str:
    return f"{ACTIONS_SQL} SELECT sid, passed, {score or 'CAST(passed AS DOUBLE)'} AS score, array_to_string(evidence, ',') AS evidence FROM (SELECT sid, {passed} AS passed, {evidence} AS evidence FROM actions GROUP BY sid)"


@query("pred_match_mixed", f"{ACTIONS_SQL} SELECT sid, idx, action FROM actions WHERE action = 'run_command' AND contains(coalesce(command, ''), 'run_1') AND regexp_matches({TEXT_SQL}, 'python3 run_1[0-5]')")
def pred_match_mixed(spark, sf_dir):
    spec = {"action": "run_command", "command": "run_1", "regex": "python3 run_1[0-5]"}
    return _sessions(spark, sf_dir).filter(matches(spec)).select("sid", "idx", "action")


_VERBS = "cat|bat|sed|awk|grep|egrep|rg|head|tail|less|more|nl|wc|xxd|od|jq|yq"


@query("pred_reads", f"{ACTIONS_SQL} SELECT sid, idx FROM actions WHERE regexp_matches({TEXT_SQL}, '(?s)^(read_file|list_dir|read_image|search_content|search_files)\\b.*f1.\\.py') OR regexp_matches({TEXT_SQL}, '\\b({_VERBS})\\b[^\\n]*f1.\\.py')")
def pred_reads(spark, sf_dir):
    return _sessions(spark, sf_dir).filter(matches(reading("f1?.py"))).select("sid", "idx")


@query("pred_runs", f"{ACTIONS_SQL} SELECT sid, idx FROM actions WHERE action = 'run_command' AND regexp_matches(trim(split_part(command, '&&', 2)), '^(timeout\\s+[0-9]+\\s+|sudo\\s+)*python3 run_2')")
def pred_runs(spark, sf_dir):
    return _sessions(spark, sf_dir).filter(matches(running("python3 run_2*"))).select("sid", "idx")


@query("pred_never_writes", f"{ACTIONS_SQL} SELECT sid, idx FROM actions WHERE regexp_matches({TEXT_SQL}, '(?s)^(create_file|modify_file|append_file)\\b.*f3') OR regexp_matches({TEXT_SQL}, '(>>|>|\\btee\\b|\\bdd\\b)[^\\n]*f3')")
def pred_never_writes(spark, sf_dir):
    return _sessions(spark, sf_dir).filter(matches(writing("f3"))).select("sid", "idx")


@query("pred_serialised", f"{ACTIONS_SQL} SELECT sid, idx, md5({TEXT_SQL}) AS text_md5 FROM actions")
def pred_serialised(spark, sf_dir):
    return _sessions(spark, sf_dir).select("sid", "idx", F.md5(serialised()).alias("text_md5"))


@query("rule_exists", _one_sql("count(*) FILTER (WHERE path LIKE '%/f7.py%') > 0", _FIRST("path LIKE '%/f7.py%'", 5)))
def rule_exists(spark, sf_dir):
    return _one(spark, sf_dir, {"id": "x", "type": "Exists", "match": {"path": "/f7.py"}})


@query("rule_count", _one_sql("count(*) FILTER (WHERE action = 'modify_file') BETWEEN 5 AND 15", _FIRST("action = 'modify_file'", 10)))
def rule_count(spark, sf_dir):
    return _one(spark, sf_dir, {"id": "x", "type": "Count", "match": {"action": "modify_file"}, "min_count": 5, "max_count": 15})


@query("rule_forbidden_exclude", _one_sql("count(*) FILTER (WHERE action = 'modify_file' AND contains(path, 'f9') AND NOT contains(path, 'f99')) = 0", _FIRST("action = 'modify_file' AND contains(path, 'f9') AND NOT contains(path, 'f99')", 5)))
def rule_forbidden_exclude(spark, sf_dir):
    return _one(spark, sf_dir, {"id": "x", "type": "Forbidden", "match": {"action": "modify_file", "path": "f9"}, "exclude": {"path": "f99"}})


_A, _B = "min(idx) FILTER (WHERE action = 'read_file' AND regexp_matches(path, 'f1?[0-9]\\.py'))", "min(idx) FILTER (WHERE action = 'modify_file' AND regexp_matches(path, 'f1?[0-9]\\.py'))"


@query("rule_before", _one_sql(f"coalesce({_A} < {_B}, true)", f"CASE WHEN {_A} IS NOT NULL AND {_B} IS NOT NULL THEN [{_A}, {_B}] ELSE [] END"))
def rule_before(spark, sf_dir):
    small = r"/f1?\d\.py"
    return _one(spark, sf_dir, {"id": "x", "type": "Before", "a": {"action": "read_file", "regex": small}, "b": {"action": "modify_file", "regex": small}})


@query(
    "rule_milestone",
    f"""{ACTIONS_SQL}, s AS (SELECT DISTINCT sid FROM actions),
    a AS (SELECT sid, min(idx) i FROM actions WHERE action = 'read_file' AND k < 10 GROUP BY sid),
    b AS (SELECT x.sid, min(x.idx) i FROM actions x JOIN a USING (sid) WHERE x.action = 'modify_file' AND x.k < 10 AND x.idx > a.i GROUP BY x.sid),
    c AS (SELECT x.sid, min(x.idx) i FROM actions x JOIN b USING (sid) WHERE x.action = 'run_command' AND x.k < 10 AND x.idx > b.i GROUP BY x.sid)
    SELECT s.sid, c.i IS NOT NULL AS passed, round(((a.i IS NOT NULL)::INT + (b.i IS NOT NULL)::INT + (c.i IS NOT NULL)::INT) / 3.0, 6)::DOUBLE AS score, concat_ws(',', a.i, b.i, c.i) AS evidence
    FROM s LEFT JOIN a USING (sid) LEFT JOIN b USING (sid) LEFT JOIN c USING (sid)""",
)
def rule_milestone(spark, sf_dir):
    steps = [{"action": "read_file", "regex": r"/f\d\.py"}, {"action": "modify_file", "regex": r"/f\d\.py"}, {"action": "run_command", "regex": r"run_\d\.py"}]
    return _one(spark, sf_dir, {"id": "x", "type": "Milestone", "steps": steps})


@query("rule_ifthen", _one_sql("count(*) FILTER (WHERE error IS NOT NULL AND contains(command, 'run_5.py')) = 0 OR count(*) FILTER (WHERE path = '/w/f5.py') > 0", f"CASE WHEN count(*) FILTER (WHERE contains(command, 'run_5.py')) > 0 THEN {_FIRST(chr(99) + 'ontains(command, ' + chr(39) + 'run_5.py' + chr(39) + ')', 3)} || {_FIRST('path = ' + chr(39) + '/w/f5.py' + chr(39), 3)} ELSE [] END").replace("error IS NOT NULL AND ", ""))
def rule_ifthen(spark, sf_dir):
    return _one(spark, sf_dir, {"id": "x", "type": "IfThen", "a": {"command": "run_5.py"}, "b": {"path": "/w/f5.py"}})


@query("rule_produces", _one_sql("count(*) FILTER (WHERE action = 'modify_file' AND contains(path, 'f4') AND completed) >= 2", _FIRST("action = 'modify_file' AND contains(path, 'f4') AND completed", 10)))
def rule_produces(spark, sf_dir):
    return _one(spark, sf_dir, {"id": "x", "type": "Produces", "name": "f4", "min_count": 2})


#: A rule set of every kind, as intents and checks.
RULES = [
    {"id": "reads_small", "reads": "f1?.py", "importance": "required"},
    {"id": "runs_two", "runs": "python3 run_2*"},
    {"id": "order", "before": ["reads f1*.py", "runs python3 run_1*"]},
    {"id": "steps", "pipeline": ["reads f?.py", "runs python3 run_3*", "f4*.py"], "importance": "recommended"},
    {"id": "no_42", "never_writes": "f42"},
    {"id": "made", "write": "f4", "at_least": 1, "importance": "optional"},
]
_R = f"""{ACTIONS_SQL}, t AS (SELECT *, {TEXT_SQL} AS text FROM actions), f AS (
  SELECT sid, idx, action = 'run_command' AND regexp_matches(coalesce(split_part(command, '&&', 2), ''), '^\\s*python3 run_2') AS m2,
    regexp_matches(text, '(?s)^read_file\\b.*f1.\\.py') AS r1,
    regexp_matches(text, '(?s)^read_file\\b.*f1.*\\.py') AS b1, regexp_matches(coalesce(split_part(command, '&&', 2), ''), '^\\s*python3 run_1') AS b2,
    regexp_matches(text, '(?s)^read_file\\b.*f.\\.py') AS s1, regexp_matches(coalesce(split_part(command, '&&', 2), ''), '^\\s*python3 run_3') AS s2, regexp_matches(text, 'f4.*\\.py') AS s3,
    regexp_matches(text, '(?s)^modify_file\\b.*f42') AS w, action = 'modify_file' AND contains(path, 'f4') AS p
  FROM t), m1 AS (SELECT sid, min(idx) i FROM f WHERE s1 GROUP BY sid),
  m2 AS (SELECT f.sid, min(idx) i FROM f JOIN m1 USING (sid) WHERE s2 AND idx > m1.i GROUP BY f.sid),
  m3 AS (SELECT f.sid, min(idx) i FROM f JOIN m2 USING (sid) WHERE s3 AND idx > m2.i GROUP BY f.sid),
  r AS (SELECT f.sid, bool_or(r1) AS reads_small, bool_or(m2) AS runs_two, coalesce(min(idx) FILTER (WHERE b1) < min(idx) FILTER (WHERE b2), true) AS ord,
    bool_or(m3.i IS NOT NULL) AS steps, NOT bool_or(w) AS no_42, coalesce(bool_or(p), false) AS made
    FROM f LEFT JOIN m3 USING (sid) GROUP BY f.sid)"""


@query(
    "rule_verdict_health",
    f"""{_R} SELECT sid, CASE WHEN NOT (reads_small AND ord AND no_42) THEN 'FAIL' WHEN NOT (runs_two AND steps) THEN 'WEAK_PASS' ELSE 'PASS' END AS verdict,
    round((reads_small::INT + ord::INT + no_42::INT + 0.5 * (runs_two::INT + steps::INT) + 0.25 * made::INT) / 4.25, 6)::DOUBLE AS health FROM r""",
)
def rule_verdict_health(spark, sf_dir):
    return rules.verdicts(rules.evaluate(_sessions(spark, sf_dir), RULES)).select("sid", "verdict", F.round("health", 6).alias("health"))


@query(
    "rule_results_long",
    f"""{_R} SELECT sid, u.checkpoint_id, u.passed FROM r, (SELECT unnest([{{'checkpoint_id': 'reads_small', 'passed': reads_small}}, {{'checkpoint_id': 'runs_two', 'passed': runs_two}},
    {{'checkpoint_id': 'order', 'passed': ord}}, {{'checkpoint_id': 'steps', 'passed': steps}}, {{'checkpoint_id': 'no_42', 'passed': no_42}}, {{'checkpoint_id': 'made', 'passed': made}}]) AS u)""",
)
def rule_results_long(spark, sf_dir):
    return rules.evaluate(_sessions(spark, sf_dir), RULES).select("sid", "checkpoint_id", "passed")


@query(
    "rule_calibrate",
    f"""{_R}, rates AS (SELECT unnest([{{'id': 'reads_small', 'x': avg(reads_small::INT)}}, {{'id': 'runs_two', 'x': avg(runs_two::INT)}}, {{'id': 'order', 'x': avg(ord::INT)}},
    {{'id': 'steps', 'x': avg(steps::INT)}}, {{'id': 'no_42', 'x': 1 - avg(no_42::INT)}}, {{'id': 'made', 'x': avg(made::INT)}}]) AS u, count(*) AS n FROM r)
    SELECT u.id AS id, round(u.x, 3) AS hit_rate, CASE WHEN u.id = 'no_42' THEN CASE WHEN u.x > 0 THEN 'DROPPED' ELSE 'forbidden' END
      WHEN u.x = 1 THEN CASE WHEN u.id IN ('order', 'steps') OR n < 5 THEN 'recommended' ELSE 'required' END WHEN u.x > 0 THEN 'recommended' ELSE 'optional' END AS severity,
      NOT (u.id = 'no_42' AND u.x > 0) AS kept FROM rates""",
)
def rule_calibrate(spark, sf_dir):
    return rules.calibrate(_sessions(spark, sf_dir), RULES)


#: Policies of a file: tools, command patterns and path patterns that are denied, in that order.
POLICY = {"denied_tools": ["prompt"], "denied_commands": [r"run_1\d\.py"], "denied_paths": [r"/f[89]\d?\.py$"]}


@query(
    "policy_filter",
    f"""{ACTIONS_SQL} SELECT sid, idx, CASE WHEN tool = 'prompt' THEN 'tool' WHEN tool = 'shell' AND regexp_matches(command, 'run_1[0-9]\\.py') THEN 'command'
    WHEN regexp_matches(path, '/f[89][0-9]?\\.py$') THEN 'path' END AS denied_by FROM actions
    WHERE tool = 'prompt' OR (tool = 'shell' AND regexp_matches(command, 'run_1[0-9]\\.py')) OR regexp_matches(path, '/f[89][0-9]?\\.py$')""",
)
def policy_filter(spark, sf_dir):
    from sparktrail.operators.policy import denied_by

    return _sessions(spark, sf_dir).select("sid", "idx", denied_by(POLICY).alias("denied_by")).filter("denied_by is not null")


@query(
    "pred_find",
    f"""{ACTIONS_SQL}, h AS (SELECT sid, idx, count(*) OVER (PARTITION BY sid) AS total, row_number() OVER (PARTITION BY sid ORDER BY idx) AS r FROM actions WHERE action = 'run_command' AND contains(command, 'run_1') AND idx >= 5 AND turn <= 9)
    SELECT sid, idx, total, total > 5 AS has_more FROM h WHERE r BETWEEN 3 AND 5""",
)
def pred_find(spark, sf_dir):
    """The third to fifth hit of each session within a scope."""
    out = find(_sessions(spark, sf_dir), {"action": "run_command", "command": "run_1"}, {"idx_gte": 5, "turn_lte": 9}, limit=3, offset=2)
    return out.select("sid", "idx", "total", "has_more")


@query(
    "rule_policies",
    f"""{ACTIONS_SQL}, p AS (SELECT sid * 1000 + idx AS ord, 'S' || sid AS scope_id, 'policy ' || idx AS policy, CASE WHEN k % 10 = 0 THEN 'judge_only' WHEN k % 10 = 1 THEN 'unobservable' ELSE 'deterministic' END AS seen,
      CASE WHEN k % 4 = 0 THEN 'write' WHEN k % 4 = 1 THEN 'never_runs' ELSE 'reads' END AS intent, CASE WHEN k % 4 = 0 THEN 'out/*_' || k || '.log' ELSE 't' || k END AS target, k % 3 = 0 AS hard FROM actions),
    o AS (SELECT intent, CASE WHEN intent = 'write' THEN replace(target, 'out/*', '') ELSE target END AS target, ord, scope_id, hard FROM p WHERE seen = 'deterministic'),
    f AS (SELECT intent, target, min(ord) AS place, arg_min(scope_id, ord) AS scope, arg_min(hard, ord) AS h, count(*) FILTER (WHERE hard) AS hards, count(*) AS n FROM o GROUP BY intent, target)
    SELECT scope || '_' || intent || '_' || trim(regexp_replace(target, '[^a-z0-9]+', '_', 'g'), '_') AS id, target, CASE WHEN hards > h::INT THEN 'required' WHEN intent = 'never_runs' THEN 'forbidden' WHEN h THEN 'required' ELSE 'recommended' END AS importance, n FROM f
    UNION ALL SELECT 'judge_reasoning_quality', 'reasoning_quality', 'recommended', count(*) FROM p WHERE seen = 'judge_only'""",
)
def rule_policies(spark, sf_dir):
    """Policies of all sessions, one for each action, as rules."""
    k, write = F.col("k"), F.col("k") % 4 == 0
    seen = F.when(k % 10 == 0, "judge_only").when(k % 10 == 1, "unobservable").otherwise("deterministic")
    intent = F.when(write, "write").when(k % 4 == 1, "never_runs").otherwise("reads")
    target = F.when(write, F.concat(F.lit("out/*_"), k, F.lit(".log"))).otherwise(F.concat(F.lit("t"), k))
    policies = _sessions(spark, sf_dir).select((F.col("sid") * 1000 + F.col("idx")).alias("ord"), F.concat(F.lit("S"), "sid").alias("scope_id"), F.concat(F.lit("policy "), "idx").alias("policy"), seen.alias("observability"), intent.alias("intent"), target.alias("target"), F.when(k % 3 == 0, "required").otherwise("recommended").alias("severity_hint"))
    made, _, _ = rules.policy_rules(policies, spark.createDataFrame([], "name string"))
    return made.select("id", "target", "importance", F.size("policies").cast("long").alias("n"))
