"""Sessions in the driver's tables: ``events`` read as actions, and tables derived from it.

A user is a session, an event an action. What an event lacks is derived from ``k``, the number in its props:
signups are prompts (and turn boundaries), views reads, purchases writes, clicks and errors commands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktrail.functions.text import utc_instant

#: The same actions in SQL: a common table expression to put before a query.
ACTIONS_SQL = """
WITH ev AS (
  SELECT user_id AS sid, event_id, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
), numbered AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY sid ORDER BY ts, event_id) - 1 AS INTEGER) AS idx,
    CAST(greatest(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 1) AS INTEGER) AS turn
  FROM ev
), actions AS (
  SELECT sid, idx, turn, CAST((turn - 1) // 4 + 1 AS INTEGER) AS seg, event_id, ts, k, value AS credits,
    CASE event_type WHEN 'view' THEN 'fs_read' WHEN 'purchase' THEN 'fs_write' WHEN 'signup' THEN 'prompt' ELSE 'execute_bash' END AS raw_tool,
    CASE event_type WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'write' WHEN 'signup' THEN 'prompt' ELSE 'shell' END AS tool,
    CASE event_type WHEN 'view' THEN 'read_file' WHEN 'purchase' THEN 'modify_file' WHEN 'signup' THEN 'user_prompt' ELSE 'run_command' END AS action,
    CASE WHEN event_type IN ('view', 'purchase') THEN '/w/f' || k || '.py' END AS path,
    CASE WHEN event_type IN ('click', 'error') THEN 'cd /w && python3 run_' || k || '.py' END AS command,
    CASE WHEN event_type = 'error' THEN 'E' END AS error,
    'p' || k % 10 AS purpose, event_type <> 'error' AS completed, event_type = 'signup' AS is_prompt
  FROM numbered
)
"""


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The actions of all sessions; one shuffle, on the session, which later windows and groups by session reuse."""
    kind = F.col("event_type")
    by_time = Window.partitionBy("sid").orderBy("ts", "event_id")
    running = by_time.rowsBetween(Window.unboundedPreceding, 0)
    named = lambda view, purchase, signup, other: F.when(kind == "view", view).when(kind == "purchase", purchase).when(kind == "signup", signup).otherwise(other)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("sid", F.col("user_id")).withColumn("k", _k())
    if isinstance(events.schema["ts"].dataType, T.TimestampNTZType):
        events = events.withColumn("ts", utc_instant("ts"))
    out = events.select(
        "sid",
        (F.row_number().over(by_time) - 1).alias("idx"),
        F.greatest(F.sum(F.when(kind == "signup", 1).otherwise(0)).over(running), F.lit(1)).cast("int").alias("turn"),
        "event_id",
        "ts",
        "k",
        F.col("value").alias("credits"),
        named("fs_read", "fs_write", "prompt", "execute_bash").alias("raw_tool"),
        named("read", "write", "prompt", "shell").alias("tool"),
        named("read_file", "modify_file", "user_prompt", "run_command").alias("action"),
        F.when(kind.isin("view", "purchase"), F.concat(F.lit("/w/f"), "k", F.lit(".py"))).alias("path"),
        F.when(kind.isin("click", "error"), F.concat(F.lit("cd /w && python3 run_"), "k", F.lit(".py"))).alias("command"),
        F.when(kind == "error", "E").alias("error"),
        F.concat(F.lit("p"), F.col("k") % 10).alias("purpose"),
        (kind != "error").alias("completed"),
        (kind == "signup").alias("is_prompt"),
    )
    seg = F.floor((F.col("turn") - 1) / 4).cast("int") + 1
    return out.select("sid", "idx", "turn", seg.alias("seg"), *[c for c in out.columns if c not in ("sid", "idx", "turn")])


def with_matcher_fields(actions: DataFrame) -> DataFrame:
    """The columns that matchers look at and the stand-in lacks."""
    return actions.withColumns({"root": F.lit(None).cast("string"), "pattern": F.lit(None).cast("string"), "subcommands": F.when(F.col("command").isNull(), F.array().cast("array<string>")).otherwise(F.split("command", " && "))})
