"""Event logs that hooks write: ``<dir>/[<date>/]<sid>/trace.jsonl``, one JSON event a line, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparktrail.functions.text import resolved_path
from sparktrail.operators.normalize import ACTION_PARTS, canonical_tool, fan_out, pair_calls
from sparktrail.sources.lines import numbered

EVENT = "ts STRING, event STRING, session_id STRING, cwd STRING, agent_name STRING, prompt STRING, prompt_length INT, tool STRING, summary STRING, tool_input STRING, success BOOLEAN, response_size BIGINT, tool_response STRING, reason STRING, turn INT, response_length INT, response_preview STRING"


def _sid(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def list_logs(spark: SparkSession, folder: str) -> DataFrame:
    """(sid, path, modified_at, bytes) of the logs in a folder, changed last first."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "trace.jsonl").load(folder)
    return raw.select(_sid(F.col("path")).alias("sid"), "path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("bytes")).orderBy(F.col("modified_at").desc(), "path")


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """(sid, line_no, event fields, bad): the events of all logs below a folder; ``bad`` marks lines that are not JSON."""
    return parsed(numbered(spark, folder, "trace.jsonl", nested=True).filter(F.trim("line") != "").select(_sid(F.col("file")).alias("sid"), "line_no", "line"))


def parsed(lines: DataFrame) -> DataFrame:
    """Lines (sid, line_no, line) as events."""
    return lines.select("sid", "line_no", F.from_json("line", EVENT).alias("e"), F.try_parse_json("line").isNull().alias("bad")).select("sid", "line_no", "e.*", "bad")


def with_turns(events: DataFrame) -> DataFrame:
    """``events`` with the running numbers of prompts (turn) and agent starts (run), both at least 1."""
    so_far = Window.partitionBy("sid").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda kind: F.greatest(F.sum(F.when(F.col("event") == kind, 1).otherwise(0)).over(so_far), F.lit(1)).cast("int")
    return events.drop("turn").withColumns({"turn": count("user_prompt"), "run": count("agent_spawn")})


def runs(events: DataFrame) -> DataFrame:
    """(sid, run, prompt, started_at, cwd, agent_name): the first prompt, time and directory of each run."""
    own = with_turns(events)
    first = lambda c, kind: F.min_by(c, F.when(F.col("event") == kind, F.col("line_no")))
    return own.groupBy("sid", "run").agg(first("prompt", "user_prompt").alias("prompt"), F.try_to_timestamp(first("ts", "agent_spawn")).alias("started_at"), F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("line_no"))).alias("cwd"), first("agent_name", "agent_spawn").alias("agent_name"))


def prompts(events: DataFrame) -> DataFrame:
    """(sid, turn, text)."""
    return with_turns(events).filter("event = 'user_prompt'").select("sid", "turn", F.coalesce("prompt", F.lit("")).alias("text"))


def actions(events: DataFrame, with_responses: bool = False) -> DataFrame:
    """The actions of hook logs: calls paired with their ends, fanned out, numbered, their paths resolved."""
    numbered = with_turns(events)
    ends = numbered.select(F.col("sid").alias("_s"), F.col("line_no").alias("_e"), F.col("ts").alias("end_ts"), "response_size", "tool_response")
    starts = numbered.select("sid", "line_no", "ts", "turn", "run", "cwd", F.col("tool").alias("raw_tool"), F.try_parse_json("tool_input").alias("args"))
    calls = pair_calls(events).join(starts.withColumnRenamed("cwd", "process_cwd"), ["sid", "line_no"]).join(ends, (F.col("sid") == F.col("_s")) & (F.col("end_no") == F.col("_e")), "left")
    parts = calls.select("*", F.posexplode(fan_out(F.coalesce("raw_tool", F.lit("")), F.col("args"))).alias("op_idx", "part"))
    idx = F.row_number().over(Window.partitionBy("sid").orderBy("call", "op_idx")) - 1
    own = {c: F.col(f"part.{c}") for c in ACTION_PARTS}
    at = F.col("process_cwd")
    own |= {"path": resolved_path(own["path"], at), "root": resolved_path(own["root"], at), "cwd": F.when(own["action"] == "run_command", resolved_path(F.coalesce(own["cwd"], at), at))}
    begun, ended = F.try_to_timestamp("ts"), F.try_to_timestamp("end_ts")
    out = parts.withColumn("idx", idx)
    return out.select(
        "sid", "idx", F.col("call").alias("call_idx"), "op_idx", F.concat(F.left("sid", F.lit(8)), F.lit("#"), F.col("idx").cast("string")).alias("ref"), begun.alias("ts"), "turn", "run",
        "raw_tool", canonical_tool(F.col("raw_tool")).alias("tool"), *(c.alias(n) for n, c in own.items()), F.try_variant_get("args", "$.__tool_use_purpose", "string").alias("purpose"), F.lit("").alias("reasoning"),
        F.col("end_no").isNotNull().alias("completed"), "blocked", (F.unix_millis(ended) - F.unix_millis(begun)).alias("duration_ms"), F.col("response_size").alias("resp_size"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("tool_use_id"),
        (F.col("tool_response") if with_responses else F.lit(None).cast("string")).alias("response"), F.to_json("args").alias("args"),
    )


def warnings(events: DataFrame) -> DataFrame:
    """(sid, warning, n): bad lines, calls that never ended, ends without a call, several starts, missing stops."""
    own = pair_calls(events)
    posts = F.count_if(F.col("event") == "post_tool_use")
    sizes = events.groupBy("sid").agg(F.count_if("bad").alias("bad lines"), F.count_if(F.col("event") == "agent_spawn").alias("s"), F.count_if(F.col("event") == "user_prompt").alias("p"), F.count_if(F.col("event") == "stop").alias("e"), posts.alias("posts"))
    paired = own.groupBy("sid").agg(F.count_if(F.col("end_no").isNull() & ~F.col("blocked")).alias("calls without an end"), F.count("end_no").alias("paired"))
    out = sizes.join(paired, "sid", "left").fillna(0)
    kinds = {"bad lines": F.col("bad lines"), "calls without an end": F.col("calls without an end"), "ends without a call": F.col("posts") - F.col("paired"), "agent starts": F.when(F.col("s") > 1, F.col("s")).otherwise(0), "turns without a stop": F.when(F.col("e") > 0, F.greatest(F.col("p") - F.col("e"), F.lit(0))).otherwise(0)}
    return out.select("sid", F.explode(F.array(*(F.struct(F.lit(k).alias("warning"), v.cast("long").alias("n")) for k, v in kinds.items()))).alias("w")).select("sid", "w.*").filter("n > 0")
