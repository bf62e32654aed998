"""Actions that were normalised before, and small files of rules, segments and the like."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ACTION = """idx INT, call_idx INT, op_idx INT, ts STRING, turn INT, run INT, raw_tool STRING, tool STRING, action STRING, sid STRING, ref STRING, path STRING, root STRING, cwd STRING, command STRING, subcommands ARRAY<STRING>,
pattern STRING, purpose STRING, reasoning STRING, response STRING, completed BOOLEAN, blocked BOOLEAN, duration_ms BIGINT, resp_size BIGINT, tool_use_id STRING, error STRING, official_verified BOOLEAN, args STRING"""


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """The actions of JSON documents ``{"session_id": …, "actions": […]}``, one or more files."""
    raw = spark.read.option("multiLine", True).schema(f"session_id STRING, actions ARRAY<STRUCT<{', '.join(': '.join(f.strip().split(' ', 1)) for f in ACTION.split(','))}>>").json(path)
    out = raw.select("session_id", F.posexplode("actions").alias("pos", "a")).select("session_id", "pos", "a.*")
    return out.withColumns({"sid": F.coalesce("sid", "session_id"), "idx": F.coalesce("idx", "pos"), "completed": F.coalesce("completed", F.lit(True)), "blocked": F.coalesce("blocked", F.lit(False)), "subcommands": F.coalesce("subcommands", F.array().cast("array<string>"))}).drop("session_id", "pos")


def read_config(spark: SparkSession, path: str) -> Any:
    """A small JSON file from any store that Spark reads; keys that begin with an underscore are comments."""
    text = spark.read.text(path, wholetext=True).first()[0]

    def clean(x: Any) -> Any:
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items() if not k.startswith("_")}
        return [clean(v) for v in x] if isinstance(x, list) else x

    return clean(json.loads(text))


def segments(spark: SparkSession, sid: str, data: Any) -> DataFrame:
    """(sid, seg, start, stop, theme) from ``{"segments": […]}`` or a list."""
    rows = data["segments"] if isinstance(data, dict) else data
    return spark.createDataFrame([(sid, i, r["start"], r["end"], r.get("theme")) for i, r in enumerate(rows, 1)], "sid STRING, seg INT, start INT, stop INT, theme STRING")


def flags(spark: SparkSession, data: dict) -> DataFrame:
    """(flag_id, tag, sid, ref, idx, note) of flags in any of the three shapes they come in."""
    rows = []
    for i, f in enumerate(data.get("flags") or []):
        step = f.get("step") or (f.get("context") or {}).get("flagged") or f
        rows.append((i, f.get("tag"), step.get("sid") or data.get("session"), step.get("ref") or f.get("ref"), step.get("idx", f.get("idx")), f.get("note")))
    return spark.createDataFrame(rows, "flag_id INT, tag STRING, sid STRING, ref STRING, idx INT, note STRING")


def rule_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, target_agent) of the rule files ``*.checks.json`` of a folder; files that are no JSON have no agent."""
    raw = spark.read.option("pathGlobFilter", "*.checks.json").text(folder, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.try_variant_get(F.try_parse_json("value"), "$.target_agent", "string").alias("target_agent"))


def rules_of(spark: SparkSession, folder: str, agent: str) -> Any:
    """The rules of the one file that is meant for an agent; an error if there is none, or several."""
    found = [r.path for r in rule_files(spark, folder).filter(F.col("target_agent") == agent).orderBy("path").collect()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} rule files for {agent}, one is needed: {', '.join(found) or 'none'}")
    return read_config(spark, found[0])
