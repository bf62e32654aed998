"""Session records: ``<dir>/<sid>.json`` with a session's data and ``<dir>/<sid>.jsonl`` with its messages, in order.

Session data is read whole, messages by line: a long file is read by several tasks, and lines keep their numbers.
Everything that a record may lack is null; what cannot be parsed is left out and counted, never raised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparktrail.functions.text import blank, filled
from sparktrail.operators.normalize import ACTION_PARTS, canonical_tool, fan_out, text_of
from sparktrail.sources.lines import numbered

_META = """session_id STRING, cwd STRING, created_at STRING, updated_at STRING, title STRING, parent_session_id STRING, session_created_reason STRING,
session_state STRUCT<agent_name: STRING, conversation_metadata: STRUCT<user_turn_metadatas: ARRAY<STRUCT<builtin_tool_uses: INT, total_request_count: INT, number_of_cycles: INT, end_reason: STRING, turn_duration: STRING,
metering_usage: ARRAY<STRUCT<value: DOUBLE>>, context_usage_percentage: DOUBLE, input_token_count: BIGINT, output_token_count: BIGINT, user_prompt_length: INT, message_ids: ARRAY<STRING>,
loop_id: STRUCT<agent_id: STRUCT<name: STRING, parent_id: STRING>>>>>>"""
# What says that a call was rejected before it ran.
REJECTED = ("The tool arguments failed validation", "failed validation")


def _files(spark: SparkSession, folder: str, ending: str) -> DataFrame:
    """(sid, value, modified_at) of the files of a folder with an ending."""
    raw = spark.read.option("pathGlobFilter", f"*{ending}").text(folder, wholetext=True)
    sid = F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*)\{ending}$", 1)
    return raw.select(sid.alias("sid"), "value", F.col("_metadata.file_modification_time").alias("modified_at"))


def read_sessions(spark: SparkSession, folder: str, cwd: str | None = None) -> DataFrame:
    """(sid, agent_name, cwd, created_at, updated_at, title, parent, reason, modified_at, turns): one row for each
    session that can be read, of one working directory if asked for."""
    meta = _files(spark, folder, ".json").withColumn("m", F.from_json("value", _META))
    out = meta.filter("m is not null").select(
        "sid", "m.session_state.agent_name", "m.cwd", F.try_to_timestamp("m.created_at").alias("created_at"), F.try_to_timestamp("m.updated_at").alias("updated_at"), "m.title",
        F.col("m.parent_session_id").alias("parent"), F.col("m.session_created_reason").alias("reason"), "modified_at", F.col("m.session_state.conversation_metadata.user_turn_metadatas").alias("turns"),
    )
    return out if cwd is None else out.filter(F.col("cwd") == cwd)


def children(sessions: DataFrame) -> DataFrame:
    """(parent, children) by the parent link alone."""
    return sessions.filter("parent is not null").groupBy("parent").agg(F.array_sort(F.collect_list("sid")).alias("children"))


def turn_meta(sessions: DataFrame) -> DataFrame:
    """One row for each turn of the session's data: usage, cost (six places, 0 as null), duration with nanoseconds."""
    t = sessions.select("sid", F.posexplode("turns").alias("pos", "t"))
    as_struct = F.from_json("t.turn_duration", "secs DOUBLE, nanos DOUBLE")
    duration = F.when(F.startswith("t.turn_duration", F.lit("{")), F.coalesce(as_struct["secs"], F.lit(0.0)) + F.coalesce(as_struct["nanos"], F.lit(0.0)) / 1e9).otherwise(F.col("t.turn_duration").try_cast("double"))
    cost = F.aggregate(F.coalesce("t.metering_usage", F.array().cast("array<struct<value:double>>")), F.lit(0.0), lambda s, v: s + F.coalesce(v["value"], F.lit(0.0)))
    return t.select(
        "sid", (F.col("pos") + 1).alias("turn"), F.col("t.builtin_tool_uses").alias("tool_uses"), F.col("t.total_request_count").alias("llm_reqs"), F.col("t.number_of_cycles").alias("cycles"), "t.end_reason", duration.alias("dur_s"),
        F.nullif(F.round(cost, 6), F.lit(0.0)).alias("credits"), F.col("t.context_usage_percentage").alias("ctx_pct"), F.col("t.input_token_count").alias("input_tokens"), F.col("t.output_token_count").alias("output_tokens"),
        F.col("t.user_prompt_length").alias("prompt_len"), F.col("t.loop_id.agent_id.name").alias("agent"), F.col("t.loop_id.agent_id.parent_id").alias("parent_agent"), F.col("t.message_ids").alias("message_ids"),
    )


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """(sid, line_no, kind, data, turn): parsed lines with the running number of prompts; ``kind`` is null for bad lines."""
    sid = F.regexp_extract("file", r"([^/]*)\.jsonl$", 1)
    rec = numbered(spark, folder, "*.jsonl").filter(F.trim("line") != "").select(sid.alias("sid"), "line_no", F.try_parse_json("line").alias("v"))
    kind = F.try_variant_get("v", "$.kind", "string")
    so_far = Window.partitionBy("sid").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    out = rec.select("sid", "line_no", kind.alias("kind"), F.try_variant_get("v", "$.data", "variant").alias("data"))
    return out.withColumn("turn", F.coalesce(F.sum(F.when(F.col("kind") == "Prompt", 1).otherwise(0)).over(so_far), F.lit(0)).cast("int"))


def kind_counts(events: DataFrame) -> DataFrame:
    """(sid, kind, n) of records other than messages and results; a null kind counts lines that cannot be parsed."""
    return events.filter(~F.coalesce(F.col("kind").isin("Prompt", "AssistantMessage", "ToolResults"), F.lit(False))).groupBy("sid", "kind").agg(F.count("*").alias("n"))


def _content(events: DataFrame) -> DataFrame:
    """Rows of messages with their content, in order."""
    items = F.try_variant_get("data", "$.content", "array<variant>")
    return events.withColumn("items", F.coalesce(items, F.array().cast("array<variant>")))


def _joined(kind: str) -> Column:
    own = F.filter("items", lambda c: F.try_variant_get(c, "$.kind", "string") == kind)
    return F.array_join(F.transform(own, text_of), "")


def prompts(events: DataFrame) -> DataFrame:
    """(sid, turn, text) of what the user said."""
    said = _content(events.filter("kind = 'Prompt'"))
    return said.select("sid", "turn", F.array_join(F.transform("items", text_of), "").alias("text"))


def responses(events: DataFrame) -> DataFrame:
    """(sid, turn, line_no, text) of what the agent said, where it said anything."""
    return _content(events.filter("kind = 'AssistantMessage'")).select("sid", "turn", "line_no", _joined("text").alias("text")).filter("text <> ''")


def _results(events: DataFrame) -> DataFrame:
    """(sid, tool_use_id, ok, error, size, response): the last result of each call; an error once said stays."""
    rows = events.filter("kind = 'ToolResults'").select("sid", "line_no", F.explode(F.try_variant_get("data", "$.results", "map<string,variant>")).alias("tool_use_id", "entry"))
    result = F.try_variant_get("entry", "$.result", "variant")
    said = F.try_variant_get("entry", "$.result.Error", "variant")
    rows = rows.select("sid", "line_no", "tool_use_id", said.isNull().alias("ok"), F.left(said.cast("string"), F.lit(300)).alias("error"), F.length(F.to_json(result)).alias("size"), F.coalesce(F.try_variant_get("entry", "$.result", "string"), F.to_json(result)).alias("response"))
    last = F.max_by(F.struct("ok", "size", "response"), "line_no")
    return rows.groupBy("sid", "tool_use_id").agg(last.alias("l"), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("line_no"))).alias("error")).select("sid", "tool_use_id", "l.ok", "error", "l.size", "l.response")


def _calls(events: DataFrame) -> DataFrame:
    """(sid, turn, line_no, item_no, raw_tool, args, tool_use_id, reasoning) of every tool call."""
    said = _content(events.filter("kind = 'AssistantMessage'")).withColumn("reasoning", _joined("thinking"))
    item = said.select("sid", "turn", "line_no", "reasoning", F.posexplode("items").alias("item_no", "c")).filter(F.try_variant_get("c", "$.kind", "string") == "toolUse")
    return item.select(
        "sid", F.greatest("turn", F.lit(1)).alias("turn"), "line_no", "item_no", F.coalesce(filled(F.try_variant_get("c", "$.data.name", "string")), F.lit("unknown")).alias("raw_tool"),
        F.try_variant_get("c", "$.data.input", "variant").alias("args"), F.try_variant_get("c", "$.data.toolUseId", "string").alias("tool_use_id"), "reasoning",
    )


def actions(events: DataFrame, with_responses: bool = False) -> DataFrame:
    """The actions of official records: calls fanned out, numbered, and joined with their results.

    A call without a result counts as completed.
    """
    calls = _calls(events).withColumn("call_idx", F.row_number().over(Window.partitionBy("sid").orderBy("line_no", "item_no")) - 1)
    parts = calls.select("*", F.posexplode(fan_out(F.col("raw_tool"), F.col("args"))).alias("op_idx", "part"))
    order = Window.partitionBy("sid").orderBy("call_idx", "op_idx")
    numbered = parts.withColumn("idx", F.row_number().over(order) - 1)
    out = numbered.join(_results(events), ["sid", "tool_use_id"], "left")
    return out.select(
        "sid", "idx", "call_idx", "op_idx", F.concat(F.left("sid", F.lit(8)), F.lit("#"), F.col("idx").cast("string")).alias("ref"), F.lit(None).cast("timestamp").alias("ts"), "turn", F.lit(1).alias("run"),
        "raw_tool", canonical_tool(F.col("raw_tool")).alias("tool"), *(F.col(f"part.{c}").alias(c) for c in ACTION_PARTS), F.try_variant_get("args", "$.__tool_use_purpose", "string").alias("purpose"), blank("reasoning").alias("reasoning"),
        F.coalesce("ok", F.lit(True)).alias("completed"), F.lit(False).alias("blocked"), F.lit(None).cast("long").alias("duration_ms"), F.col("size").alias("resp_size"), "error", "tool_use_id",
        (F.col("response") if with_responses else F.lit(None).cast("string")).alias("response"), F.to_json("args").alias("args"),
    )


def thinkings(events: DataFrame, done: DataFrame) -> DataFrame:
    """(sid, turn, text, action_idx): thoughts, and the actions that each led to."""
    thoughts = _content(events.filter("kind = 'AssistantMessage'")).select("sid", F.greatest("turn", F.lit(1)).alias("turn"), "line_no", _joined("thinking").alias("text")).filter("text <> ''")
    led = _calls(events).select("sid", "line_no", "tool_use_id").join(done.select("sid", "tool_use_id", "idx"), ["sid", "tool_use_id"])
    led = led.groupBy("sid", "line_no").agg(F.array_sort(F.collect_set("idx")).alias("action_idx"))
    return thoughts.join(led, ["sid", "line_no"], "left").select("sid", "turn", "text", F.coalesce("action_idx", F.array().cast("array<int>")).alias("action_idx"))


def texts_by_turn(events: DataFrame, turns: DataFrame) -> DataFrame:
    """(sid, turn, assistant_text, thinking_text, tools, rejected): messages by the turn that names their id."""
    ids = turns.select("sid", "turn", F.explode("message_ids").alias("message_id"))
    said = _content(events.filter("kind = 'AssistantMessage'")).withColumn("message_id", F.try_variant_get("data", "$.message_id", "string")).drop("turn").join(ids, ["sid", "message_id"])
    parts = said.select("sid", "turn", "line_no", _joined("text").alias("text"), _joined("thinking").alias("thinking"))
    row = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.col(c).alias("t")))), lambda s: s["t"]), "")
    texts = parts.groupBy("sid", "turn").agg(row("text").alias("assistant_text"), row("thinking").alias("thinking_text"))
    uses = said.select("sid", "turn", "line_no", F.posexplode("items").alias("n", "c")).filter(F.try_variant_get("c", "$.kind", "string") == "toolUse")
    uses = uses.select("sid", "turn", "line_no", "n", F.try_variant_get("c", "$.data.name", "string").alias("name"), F.try_variant_get("c", "$.data.toolUseId", "string").alias("tool_use_id")).filter(filled("name").isNotNull())
    raw = events.filter("kind = 'ToolResults'").select("sid", "line_no", F.explode(F.try_variant_get("data", "$.results", "map<string,variant>")).alias("tool_use_id", "entry"))
    last = raw.groupBy("sid", "tool_use_id").agg(F.max_by(F.to_json(F.try_variant_get("entry", "$.result", "variant")), "line_no").alias("said"))
    turned_away = ~F.startswith(blank("said"), F.lit('{"Success"')) & (F.contains("said", F.lit(REJECTED[0])) | F.contains("said", F.lit(REJECTED[1])))
    uses = uses.join(last, ["sid", "tool_use_id"], "left").withColumn("no", F.coalesce(turned_away, F.lit(False)))
    names = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("line_no", "n", "name")))), lambda s: s["name"])
    tools = uses.groupBy("sid", "turn").agg(names(F.lit(True)).alias("tools"), names(F.col("no")).alias("rejected"))
    return turns.select("sid", "turn").join(texts, ["sid", "turn"], "left").join(tools, ["sid", "turn"], "left")
