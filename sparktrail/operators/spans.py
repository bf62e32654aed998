"""Trace spans of sessions: ids, times, names, statuses and attributes, and an OTLP document for each session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktrail.functions.text import blank, filled

# Nanoseconds that actions without a time start from, and between two of them.
BASE_NS, STEP_NS = 1_700_000_000_000_000_000, 1_000_000
# Kinds of tools.
TOOL_TYPES = {"read": "function", "write": "function", "code": "function", "grep": "function", "glob": "function", "introspect": "function", "todo_list": "function", "shell": "extension", "use_aws": "extension", "knowledge": "datastore"}
_VALUE = "struct<stringValue:string,intValue:string,boolValue:boolean>"


def trace_id(sid: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit("trace:"), sid.cast("string")), 256), 1, 32)


def span_id(sid: Column, *parts: Column) -> Column:
    text = F.concat(F.lit("span:"), sid.cast("string"), F.lit(":"), F.concat_ws(":", *(p.cast("string") for p in parts)))
    return F.substring(F.sha2(text, 256), 1, 16)


def _has(actions: DataFrame, column: str, default: Column) -> Column:
    return F.col(column) if column in actions.columns else default


def _value(c: Column, kind: str) -> Column:
    """A value as OTLP spells it: integers as strings."""
    fields = {"stringValue": c.cast("string") if kind == "string" else None, "intValue": c.cast("string") if kind == "int" else None, "boolValue": c if kind == "bool" else None}
    return F.when(c.isNotNull(), F.struct(*((F.lit(None) if v is None else v).cast("boolean" if n == "boolValue" else "string").alias(n) for n, v in fields.items())))


def spans(actions: DataFrame, prefix: str = "agent", with_io: bool = False) -> DataFrame:
    """(sid, run, idx, trace_id, span_id, parent_id, name, status, start_ns, end_ns, attributes) of each action.

    ``prefix`` heads the attributes that no convention names. Arguments and results are left out unless asked for.
    """
    text = lambda c: filled(_has(actions, c, F.lit(None).cast("string")))
    flag = lambda c: F.coalesce(_has(actions, c, F.lit(False)), F.lit(False))
    run = _has(actions, "run", F.lit(1))
    dispatch = F.col("action") == "spawn_subagent"
    operation = F.when(dispatch, "invoke_agent").otherwise("execute_tool")
    name = F.rtrim(F.concat(operation, F.lit(" "), F.when(dispatch, blank(text("pattern"))).otherwise(F.coalesce(text("tool"), text("raw_tool"), F.lit("")))))
    status = F.when(text("error").isNotNull() | flag("blocked"), "ERROR").when(flag("completed"), "OK").otherwise("UNSET")
    start = F.coalesce(F.unix_micros("ts") * 1000, F.lit(BASE_NS).cast("long") + F.col("idx") * F.lit(STEP_NS).cast("long"))
    end = start + F.coalesce(_has(actions, "duration_ms", F.lit(0)), F.lit(0)).cast("long") * 1_000_000
    types = F.create_map(*[x for k, v in TOOL_TYPES.items() for x in (F.lit(k), F.lit(v))])
    other = lambda c: F.when(~dispatch, c)
    attributes: list[tuple[str, Column, str]] = [
        ("gen_ai.operation.name", operation, "string"),
        ("gen_ai.agent.name", F.when(dispatch, text("pattern")), "string"),
        ("gen_ai.tool.name", other(text("tool")), "string"),
        ("gen_ai.tool.call.id", other(text("tool_use_id")), "string"),
        ("gen_ai.tool.type", other(types[text("tool")]), "string"),
        ("error.type", text("error"), "string"),
        (f"{prefix}.action", F.col("action"), "string"),
        (f"{prefix}.raw_tool", text("raw_tool"), "string"),
        (f"{prefix}.reasoning", text("reasoning"), "string"),
        (f"{prefix}.tool.purpose", text("purpose"), "string"),
        (f"{prefix}.blocked", flag("blocked"), "bool"),
        (f"{prefix}.completed", flag("completed"), "bool"),
        (f"{prefix}.turn", F.col("turn"), "int"),
        (f"{prefix}.run", run, "int"),
        (f"{prefix}.idx", F.col("idx"), "int"),
    ]
    if with_io:
        given = F.struct(*(text(c).alias(c) for c in ("path", "command", "pattern", "root")))
        attributes += [("gen_ai.tool.call.arguments", other(F.nullif(F.to_json(given), F.lit("{}"))), "string"), ("gen_ai.tool.call.result", other(text("response")), "string")]
    listed = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), _value(c, kind).cast(_VALUE).alias("value")) for k, c, kind in attributes)), lambda a: a["value"].isNotNull())
    sid = F.col("sid")
    return actions.select(
        "sid", run.alias("run"), "idx", trace_id(sid).alias("trace_id"), span_id(sid, F.lit("act"), run, F.col("idx")).alias("span_id"), span_id(sid, F.lit("run"), run).alias("parent_id"),
        name.alias("name"), status.alias("status"), start.alias("start_ns"), F.greatest(end, start).alias("end_ns"), listed.alias("attributes"),
    )


def roots(action_spans: DataFrame) -> DataFrame:
    """(sid, run, trace_id, span_id, start_ns, end_ns, children): one span for each run, from the first to the last
    start of its actions."""
    out = action_spans.groupBy("sid", "run", "trace_id", F.col("parent_id").alias("span_id"))
    return out.agg(F.min("start_ns").alias("start_ns"), F.max("start_ns").alias("end_ns"), F.count("*").alias("children"))


def documents(action_spans: DataFrame, service: str = "agent") -> DataFrame:
    """(sid, document): an OTLP/JSON export request for each session, its root spans first."""
    code = F.when(F.col("status") == "OK", 1).when(F.col("status") == "ERROR", 2).otherwise(0)

    def span(parent: Column, name: Column, attributes: Column, status: Column) -> Column:
        fields = {"traceId": F.col("trace_id"), "spanId": F.col("span_id"), "parentSpanId": parent, "name": name, "kind": F.lit(1), "startTimeUnixNano": F.col("start_ns").cast("string"), "endTimeUnixNano": F.col("end_ns").cast("string"), "attributes": attributes, "status": F.struct(status.alias("code"))}
        return F.struct(*(c.alias(n) for n, c in fields.items()))

    string = lambda key, c: F.struct(F.lit(key).alias("key"), _value(c, "string").cast(_VALUE).alias("value"))
    of_root = F.array(string("gen_ai.operation.name", F.lit("invoke_agent")), string("gen_ai.conversation.id", F.col("sid").cast("string")))
    top = roots(action_spans).select("sid", F.struct(F.lit(0).alias("o"), F.col("run").alias("i"), span(F.lit(None).cast("string"), F.concat(F.lit("invoke_agent "), F.left(F.col("sid").cast("string"), F.lit(8))), of_root, F.lit(1)).alias("span")).alias("s"))
    own = action_spans.select("sid", F.struct(F.lit(1).alias("o"), F.col("idx").alias("i"), span(F.col("parent_id"), F.col("name"), F.col("attributes"), code).alias("span")).alias("s"))
    # sorted by kind and position alone: what follows is unique by then
    ordered = F.array_sort(F.collect_list("s"), lambda x, y: F.when(x["o"] != y["o"], x["o"] - y["o"]).otherwise((x["i"] - y["i"]).cast("int")))
    spans_of = F.transform(ordered, lambda s: s["span"])
    scope = F.struct(F.struct(F.lit("sparktrail").alias("name")).alias("scope"), spans_of.alias("spans"))
    resource = F.struct(F.array(string("service.name", F.lit(service)), string("gen_ai.conversation.id", F.col("sid").cast("string"))).alias("attributes"))
    grouped = top.unionByName(own).groupBy("sid").agg(scope.alias("scope"))
    return grouped.select("sid", F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array("scope").alias("scopeSpans"))).alias("resourceSpans"))).alias("document"))
