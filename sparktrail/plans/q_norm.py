"""Queries: normalisation over the stand-in sessions and the conversations table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparktrail.functions.shell import split_subcommands
from sparktrail.functions.text import command_dir, resolved_path
from sparktrail.operators import normalize
from sparktrail.plans.catalog import query
from sparktrail.sources import cache, hooks, official
from sparktrail.sources.standin import ACTIONS_SQL, actions, with_matcher_fields

A = ACTIONS_SQL


@query("norm_turn_idx", f"{A} SELECT sid, event_id, idx, turn, seg FROM actions")
def norm_turn_idx(spark, sf_dir):
    return actions(spark, sf_dir).select("sid", "event_id", "idx", "turn", "seg")


@query("norm_alias_action", f"{A} SELECT sid, idx, raw_tool, tool FROM actions")
def norm_alias_action(spark, sf_dir):
    return actions(spark, sf_dir).select("sid", "idx", "raw_tool", normalize.canonical_tool(F.col("raw_tool")).alias("tool"))


@query(
    "norm_fanout_posexplode",
    f"""{A} SELECT sid, idx, CAST(o AS INTEGER) AS op_idx, CASE (k + o) % 3 WHEN 0 THEN 'read_file' WHEN 1 THEN 'list_dir' ELSE 'search_content' END AS action, '/w/f' || (k + o) AS path
    FROM (SELECT *, unnest(range(0, k % 4 + 1)) AS o FROM actions WHERE action = 'read_file')""",
)
def norm_fanout_posexplode(spark, sf_dir):
    mode = lambda n: F.when(n % 3 == 0, "Line").when(n % 3 == 1, "Directory").otherwise("SEARCH")
    ops = F.transform(F.sequence(F.lit(0), F.col("k") % 4), lambda o: F.struct(mode(F.col("k") + o).alias("mode"), F.concat(F.lit("/w/f"), F.col("k") + o).alias("path")))
    reads = actions(spark, sf_dir).filter("action = 'read_file'").withColumn("args", F.parse_json(F.to_json(F.struct(ops.alias("operations")))))
    return reads.select("sid", "idx", F.posexplode(normalize.fan_out(F.col("raw_tool"), F.col("args"))).alias("op_idx", "p")).select("sid", "idx", "op_idx", "p.action", "p.path")


@query("norm_subcommands", f"{A} SELECT sid, idx, 'cd /w|python3 run_' || k || '.py|echo \"a;b && c\"' AS parts, '/w' AS cwd FROM actions WHERE command IS NOT NULL")
def norm_subcommands(spark, sf_dir):
    commands = actions(spark, sf_dir).filter("command is not null").withColumn("subs", split_subcommands(F.concat("command", F.lit('; echo "a;b && c"'))))
    return commands.select("sid", "idx", F.array_join("subs", "|").alias("parts"), command_dir("subs").alias("cwd"))


@query("norm_paths", f"{A} SELECT sid, idx, '/x/f' || k || '.py' AS path FROM actions WHERE path IS NOT NULL")
def norm_paths(spark, sf_dir):
    odd = F.concat(F.lit("./../x//y/../f"), F.col("k"), F.lit(".py"))
    return actions(spark, sf_dir).filter("path is not null").select("sid", "idx", resolved_path(odd, F.lit("/w")).alias("path"))


@query(
    "norm_turn_counters",
    """SELECT conv_id, turn, greatest(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w, 1)::INTEGER AS prompt_no, greatest(sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER w, 1)::INTEGER AS run_no
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""",
)
def norm_turn_counters(spark, sf_dir):
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    event = F.when(F.col("role") == "user", "user_prompt").when(F.col("role") == "system", "agent_spawn")
    out = hooks.with_turns(said.select(F.col("conv_id").alias("sid"), F.col("turn").alias("line_no"), event.alias("event")))
    return out.select(F.col("sid").alias("conv_id"), F.col("line_no").alias("turn"), F.col("turn").alias("prompt_no"), F.col("run").alias("run_no"))


@query(
    "norm_orphan_backfill",
    f"""{A}, o AS (SELECT sid, idx, command, row_number() OVER (PARTITION BY sid, command ORDER BY idx) AS n FROM actions WHERE action = 'run_command' AND error IS NOT NULL),
    c AS (SELECT sid, command, count(*) AS ok FROM actions WHERE action = 'run_command' AND error IS NULL GROUP BY sid, command)
    SELECT a.sid, a.idx, a.error IS NULL OR coalesce(o.n <= c.ok, false) AS completed, a.error IS NOT NULL AND coalesce(o.n <= c.ok, false) AS verified
    FROM actions a LEFT JOIN o ON o.sid = a.sid AND o.idx = a.idx LEFT JOIN c ON c.sid = o.sid AND c.command = o.command WHERE a.action = 'run_command'""",
)
def norm_orphan_backfill(spark, sf_dir):
    hook = with_matcher_fields(actions(spark, sf_dir)).filter("action = 'run_command'").withColumn("blocked", F.lit(False))
    return normalize.backfilled(hook, hook.filter("error is null")).select("sid", "idx", "completed", F.col("official_verified").alias("verified"))


@query(
    "norm_bag_diff",
    f"""{A}, o AS (SELECT sid, tool, count(*) AS n FROM actions WHERE turn % 2 = 1 GROUP BY sid, tool), h AS (SELECT sid, tool, count(*) AS n FROM actions WHERE turn % 2 = 0 GROUP BY sid, tool)
    SELECT sid, tool, greatest(coalesce(o.n, 0) - coalesce(h.n, 0), 0) AS missing, greatest(coalesce(h.n, 0) - coalesce(o.n, 0), 0) AS extra FROM o FULL JOIN h USING (sid, tool) WHERE coalesce(o.n, 0) <> coalesce(h.n, 0)""",
)
def norm_bag_diff(spark, sf_dir):
    acts = actions(spark, sf_dir)
    out = normalize.tool_differences(acts.filter("turn % 2 = 1"), acts.filter("turn % 2 = 0"), acts.limit(0))
    return out.select("sid", "tool", "missing", "extra")


def _log(spark, sf_dir):
    """The events as a hook log: views start calls of ten inputs, clicks end them, errors block."""
    kind = F.col("event_type")
    event = F.when(kind == "signup", "user_prompt").when(kind == "view", "pre_tool_use").when(kind == "click", "post_tool_use").when(kind == "error", "tool_blocked").otherwise("stop")
    acts = actions(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type"), "event_id")
    return acts.select(F.col("sid").cast("string").alias("sid"), F.col("idx").alias("line_no"), event.alias("event"), F.concat(F.lit("tool"), F.col("k") % 3).alias("tool"), F.to_json(F.struct((F.col("k") % 10).alias("n"))).alias("tool_input"))


def _as_log(acts):
    """Actions as a hook log in which every call starts and never ends; prompts are prompts."""
    event = F.when(F.col("action") == "user_prompt", "user_prompt").otherwise("pre_tool_use")
    given = F.to_json(F.struct(F.coalesce("command", F.lit("")).alias("command"), F.coalesce("path", F.lit("")).alias("path")))
    lacks = {c: F.lit(None).cast("string") for c in ("cwd", "prompt", "agent_name", "tool_response")} | {"response_size": F.lit(None).cast("long")}
    return acts.select(F.col("sid").cast("string").alias("sid"), F.col("idx").alias("line_no"), event.alias("event"), F.col("raw_tool").alias("tool"), given.alias("tool_input"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts")).withColumns(lacks)


@query(
    "norm_dense_order",
    f"""{A} SELECT CAST(sid AS VARCHAR) AS sid, CAST(row_number() OVER (PARTITION BY sid ORDER BY idx) - 1 AS INTEGER) AS idx, turn, tool, CASE tool WHEN 'read' THEN 'read_file' WHEN 'write' THEN 'modify_file' ELSE 'run_command' END AS action
    FROM actions WHERE NOT is_prompt""",
)
def norm_dense_order(spark, sf_dir):
    """Calls of hook logs numbered without gaps, by turns that prompts begin."""
    return hooks.actions(_as_log(actions(spark, sf_dir))).select("sid", "idx", "turn", "tool", "action")


@query("norm_run_prompts", "SELECT CAST(conv_id AS VARCHAR) AS conv_id, arg_min(text, turn) AS prompt FROM conversations WHERE role = 'user' GROUP BY conv_id")
def norm_run_prompts(spark, sf_dir):
    """The first prompt of a run, conversations read as hook logs of one run."""
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    event = F.when(F.col("role") == "user", "user_prompt").otherwise("stop")
    lacks = {c: F.lit(None).cast("string") for c in ("ts", "cwd", "agent_name")}
    log = said.select(F.col("conv_id").cast("string").alias("sid"), F.col("turn").alias("line_no"), event.alias("event"), F.col("text").alias("prompt")).withColumns(lacks)
    return hooks.runs(log).filter("prompt is not null").select(F.col("sid").alias("conv_id"), "prompt")


@query(
    "norm_official_results",
    f"""{A}, r AS (SELECT sid, k, arg_max(error, idx) AS error, arg_max(error IS NULL, idx) AS ok FROM actions WHERE action = 'run_command' GROUP BY sid, k)
    SELECT CAST(a.sid AS VARCHAR) AS sid, CAST(row_number() OVER (PARTITION BY a.sid ORDER BY a.idx) - 1 AS INTEGER) AS idx, a.path, r.error, coalesce(r.ok, true) AS completed
    FROM actions a LEFT JOIN r ON r.sid = a.sid AND r.k = a.k WHERE a.action = 'read_file'""",
)
def norm_official_results(spark, sf_dir):
    """Reads as calls and commands as results of official records: the last result counts, an error once said stays."""
    acts = actions(spark, sf_dir).filter("action in ('read_file', 'run_command')")
    use = F.struct(F.lit("toolUse").alias("kind"), F.struct(F.lit("fs_read").alias("name"), F.col("k").cast("string").alias("toolUseId"), F.struct("path").alias("input")).alias("data"))
    said = F.to_json(F.struct(F.array(use).alias("content")))
    result = F.when(F.col("error").isNull(), F.to_json(F.struct(F.lit("done").alias("Success")))).otherwise(F.to_json(F.struct(F.col("error").alias("Error"))))
    results = F.concat(F.lit('{"results": {"'), "k", F.lit('": {"result": '), result, F.lit("}}}"))
    reads = F.col("action") == "read_file"
    events = acts.select(F.col("sid").cast("string").alias("sid"), F.col("idx").alias("line_no"), "turn", F.when(reads, "AssistantMessage").otherwise("ToolResults").alias("kind"), F.parse_json(F.when(reads, said).otherwise(results)).alias("data"))
    return official.actions(events).select("sid", "idx", "path", "error", "completed")


def _records(spark, sf_dir):
    """Conversations as session records: what users say are prompts, what assistants say are messages with a thought and a
    call, and every second call of an assistant was turned away before it ran."""
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("role in ('user', 'assistant')")
    turn = F.col("turn").cast("string")
    item = lambda kind, data: F.concat(F.lit(f'{{"kind": "{kind}", "data": '), data, F.lit("}"))
    text = F.expr("substring(to_json(struct(text)), 9, length(to_json(struct(text))) - 9)")  # the text alone, as JSON
    call = F.concat(F.lit('{"name": "fs_read", "toolUseId": "'), turn, F.lit('", "input": {"operations": [{"path": "/a"}, {"path": "/b"}]}}'))
    message = F.concat(F.lit('{"message_id": "m'), turn, F.lit('", "content": ['), item("thinking", F.concat(F.lit('{"text": "T'), turn, F.lit('"}'))), F.lit(", "), item("text", text), F.lit(", "), item("toolUse", call), F.lit("]}"))
    asked = F.concat(F.lit('{"content": ['), item("text", text), F.lit("]}"))
    away = F.concat(F.lit('{"results": {"'), turn, F.lit('": {"result": {"Error": "The tool arguments failed validation"}}}}'))
    is_user, line = F.col("role") == "user", F.col("turn") * 2
    rows = F.array(F.struct(line.alias("line_no"), F.when(is_user, "Prompt").otherwise("AssistantMessage").alias("kind"), F.when(is_user, asked).otherwise(message).alias("said")), F.when(~is_user & (F.col("turn") % 4 == 3), F.struct((line + 1).alias("line_no"), F.lit("ToolResults").alias("kind"), away.alias("said"))))
    flat = said.select(F.col("conv_id").cast("string").alias("sid"), F.inline(F.array_compact(rows)))
    so_far = Window.partitionBy("sid").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return flat.select("sid", F.col("line_no").cast("int").alias("line_no"), "kind", F.parse_json("said").alias("data")).withColumn("turn", F.sum((F.col("kind") == "Prompt").cast("int")).over(so_far).cast("int"))


@query(
    "norm_official_turns",
    """SELECT CAST(conv_id AS VARCHAR) AS sid, CAST(turn // 2 + 1 AS INTEGER) AS turn, string_agg(text, '' ORDER BY turn) AS assistant_text, string_agg('T' || turn, '' ORDER BY turn) AS thinking_text,
    string_agg('fs_read', ',' ORDER BY turn) AS tools, coalesce(string_agg('fs_read', ',' ORDER BY turn) FILTER (WHERE turn % 4 = 3), '') AS rejected FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn // 2""",
)
def norm_official_turns(spark, sf_dir):
    """What was said, thought, called and turned away in each turn, messages found by the turn that names their ids."""
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("role = 'assistant'")
    turns = said.groupBy(F.col("conv_id").cast("string").alias("sid"), (F.floor(F.col("turn") / 2) + 1).cast("int").alias("turn")).agg(F.collect_list(F.concat(F.lit("m"), "turn")).alias("message_ids"))
    out = official.texts_by_turn(_records(spark, sf_dir), turns)
    return out.withColumns({c: F.array_join(c, ",") for c in ("tools", "rejected")})


@query(
    "norm_thoughts",
    """WITH c AS (SELECT conv_id, turn, role, greatest(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn), 1) AS t FROM conversations WHERE role IN ('user', 'assistant')),
    a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM c WHERE role = 'assistant')
    SELECT CAST(conv_id AS VARCHAR) AS sid, CAST(t AS INTEGER) AS turn, 'T' || turn AS text, (2 * n) || ',' || (2 * n + 1) AS actions FROM a""",
)
def norm_thoughts(spark, sf_dir):
    """Thoughts and the actions that each led to: a call of two operations makes two."""
    events = _records(spark, sf_dir)
    return official.thinkings(events, official.actions(events)).select("sid", "turn", "text", F.array_join("action_idx", ",").alias("actions"))


@query(
    "norm_pairing_exact",
    f"""{A}, s AS (SELECT CAST(sid AS VARCHAR) AS sid, idx, idx // 6 AS grp, 'tool' || k % 2 AS tool, k % 3 AS n, (idx // 6) * 12 + idx % 6 AS line_no, k % 7 > 0 AS ends FROM actions),
    b AS (SELECT *, row_number() OVER (PARTITION BY sid, grp, tool, n ORDER BY line_no DESC) AS r, row_number() OVER (PARTITION BY sid ORDER BY line_no) - 1 AS call FROM s),
    e AS (SELECT sid, grp, tool, n, line_no + 6 AS end_no, row_number() OVER (PARTITION BY sid, grp, tool, n ORDER BY line_no) AS r FROM s WHERE ends)
    SELECT b.sid, CAST(b.call AS INTEGER) AS call, CAST(b.line_no AS INTEGER) AS line_no, CAST(e.end_no AS INTEGER) AS end_no, false AS blocked FROM b LEFT JOIN e USING (sid, grp, tool, n, r)""",
)
def norm_pairing_exact(spark, sf_dir):
    """Six calls start, then some of them end by tool and input: the last one open ends first, others stay open for good."""
    acts = actions(spark, sf_dir)
    begin = F.floor(F.col("idx") / 6) * 12 + F.col("idx") % 6
    events = F.array(F.struct(begin.alias("line_no"), F.lit("pre_tool_use").alias("event")), F.struct((begin + 6).alias("line_no"), F.lit("post_tool_use").alias("event")))
    log = acts.select("sid", "k", F.inline(events)).filter("event = 'pre_tool_use' or k % 7 > 0")
    log = log.select(F.col("sid").cast("string").alias("sid"), F.col("line_no").cast("int").alias("line_no"), "event", F.concat(F.lit("tool"), F.col("k") % 2).alias("tool"), F.to_json(F.struct((F.col("k") % 3).alias("n"))).alias("tool_input"))
    return normalize.pair_calls(log)


@query(
    "norm_pairing_fallback",
    f"""{A}, s AS (SELECT CAST(sid AS VARCHAR) AS sid, k, idx // 3 AS grp, idx % 3 AS place, idx % 3 = 0 AS first, 'tool' || (idx // 3) % 5 || '_' || idx // 3 AS tool, k % 5 AS how FROM actions),
    c AS (SELECT sid, CAST(row_number() OVER (PARTITION BY sid ORDER BY grp, place) - 1 AS INTEGER) AS call, grp, place, grp * 100 + place AS line_no, tool, how FROM s)
    SELECT sid, call, CAST(line_no AS INTEGER) AS line_no, CAST(CASE WHEN how < 3 THEN grp * 100 + 50 - place END AS INTEGER) AS end_no, how = 3 AS blocked FROM c""",
)
def norm_pairing_fallback(spark, sf_dir):
    """Up to three calls of one tool start one after another and end in the opposite order: by their input, by another
    input (so that the latest open call of the tool is meant), by a block, or not at all, which is told by what follows."""
    acts = actions(spark, sf_dir)
    group, place, how = F.floor(F.col("idx") / 3), F.col("idx") % 3, F.col("k") % 5
    tool = F.concat(F.lit("tool"), group % 5, F.lit("_"), group)
    # a call that stays open has a tool of its own, or the next end without its input would be taken for its own
    tool = F.concat(tool, F.when(how == 4, F.concat(F.lit("_open"), place)).otherwise(""))
    given = F.when(how == 1, F.lit('{"odd": 1}')).when(how == 2, F.lit(None).cast("string")).otherwise(F.to_json(F.struct(F.col("idx").alias("n"))))
    begin = F.struct((group * 100 + place).alias("line_no"), F.lit("pre_tool_use").alias("event"), F.to_json(F.struct(F.col("idx").alias("n"))).alias("tool_input"))
    end = F.struct((group * 100 + 50 - place).alias("line_no"), F.when(how == 3, "tool_blocked").otherwise("post_tool_use").alias("event"), given.alias("tool_input"))
    log = acts.select(F.col("sid").cast("string").alias("sid"), tool.alias("tool"), F.inline(F.when(how == 4, F.array(begin)).otherwise(F.array(begin, end))))
    return normalize.pair_calls(log.withColumn("line_no", F.col("line_no").cast("int")))


_SAID = """said AS (SELECT conv_id, turn, left(text, 40) AS head, timestamp '2026-01-01' + to_days(CAST(conv_id AS INTEGER)) + to_minutes(CAST(10 * turn AS INTEGER)) AS at FROM conversations WHERE role = 'user' AND length(trim(left(text, 40), ' .…')) > 0)"""


@query(
    "norm_run_attribution",
    f"""WITH {_SAID}, fits AS (SELECT r.conv_id, r.turn, s.turn AS of, abs(epoch_us(r.at) - epoch_us(s.at)) AS away FROM said r JOIN said s ON s.conv_id = r.conv_id AND starts_with(r.head, rtrim(s.head, '.… ')))
    SELECT CAST(conv_id AS VARCHAR) AS sid, CAST(turn AS INTEGER) AS run, conv_id || '/' || turn || '/a' AS session FROM fits WHERE of = turn""",
)
def norm_run_attribution(spark, sf_dir):
    """User turns as runs of logs, each with two sessions created a minute before and after it (the smaller id is taken),
    and one of the same title in another directory; every other log has no directory."""
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("role = 'user' and length(trim(BOTH ' .…' FROM left(text, 40))) > 0")
    at = F.timestamp_seconds(F.unix_seconds(F.lit("2026-01-01 00:00:00").cast("timestamp")) + F.col("conv_id") * 86_400 + F.col("turn") * 600)
    sid = F.col("conv_id").cast("string")
    runs = said.select(sid.alias("sid"), F.col("turn").cast("int").alias("run"), F.col("text").alias("prompt"), at.alias("started_at"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("/w/"), sid)).alias("cwd"))
    minute = F.expr("interval 1 minute")
    three = F.array(*(F.struct(F.lit(n).alias("n"), t.alias("created_at"), F.lit(d).alias("of")) for n, t, d in (("a", at - minute, "/w/"), ("b", at + minute, "/w/"), ("0", at + F.expr("interval 30 days"), "/other/"))))
    sessions = said.select("conv_id", "turn", "text", F.inline(three)).select(F.concat_ws("/", "conv_id", "turn", "n").alias("sid"), F.left("text", F.lit(40)).alias("title"), F.concat("of", "conv_id").alias("cwd"), "created_at", F.col("created_at").alias("modified_at"))
    return normalize.attribute_runs(runs, sessions)


@query(
    "norm_bags",
    f"""{A}, o AS (SELECT sid, tool, error, count(*) AS a FROM actions WHERE turn % 2 = 1 GROUP BY ALL), h AS (SELECT sid, tool, error, count(*) AS b FROM actions WHERE turn % 2 = 0 GROUP BY ALL)
    SELECT coalesce(o.sid, h.sid) AS sid, coalesce(o.tool, h.tool) AS tool, coalesce(o.error, h.error) AS error, least(coalesce(a, 0), coalesce(b, 0)) AS common, greatest(coalesce(a, 0) - coalesce(b, 0), 0) AS only_first, greatest(coalesce(b, 0) - coalesce(a, 0), 0) AS only_second
    FROM o FULL JOIN h ON o.sid = h.sid AND o.tool = h.tool AND o.error IS NOT DISTINCT FROM h.error""",
)
def norm_bags(spark, sf_dir):
    """Odd and even turns of a session as bags of tools and errors."""
    acts = actions(spark, sf_dir)
    return normalize.bag_differences(acts.filter("turn % 2 = 1"), acts.filter("turn % 2 = 0"), ["sid", "tool", "error"])


@query("norm_pairing")
def norm_pairing(spark, sf_dir):
    return normalize.pair_calls(_log(spark, sf_dir))


@query(
    "cache_stale_texts",
    f"""{A}, t AS (SELECT sid, idx, 'command' AS dim, command AS text FROM actions WHERE command IS NOT NULL UNION ALL SELECT sid, idx, 'path', path FROM actions WHERE path IS NOT NULL
    UNION ALL SELECT sid, idx, 'purpose', purpose FROM actions UNION ALL SELECT sid, idx, 'error', error FROM actions WHERE error IS NOT NULL)
    SELECT sid, idx, dim, substring(sha1(text), 1, 16) AS sha1 FROM t WHERE NOT (dim = 'purpose' AND idx % 3 > 0) AND NOT (dim = 'path' AND idx % 2 = 0)""",
)
def cache_stale_texts(spark, sf_dir):
    """What has to be encoded when the paths of even actions and two purposes in three are known already."""
    wanted = cache.texts(with_matcher_fields(actions(spark, sf_dir)))
    known = wanted.filter("(dim = 'purpose' and idx % 3 > 0) or (dim = 'path' and idx % 2 = 0)")
    other = wanted.filter("dim = 'command'").withColumn("sha1", F.lit("another text"))
    return cache.stale(wanted, known.unionByName(other)).select("sid", "idx", "dim", "sha1")


_SIDES_SQL = f"{A} SELECT sid, idx, tool AS hook_tool, tool AS official_tool, true AS same FROM actions"


@query("norm_side_by_side", _SIDES_SQL)
def norm_side_by_side(spark, sf_dir):
    """Every action of every session in both sources."""
    acts = actions(spark, sf_dir)
    return normalize.side_by_side(acts.withColumn("tool", F.col("raw_tool")), acts)
