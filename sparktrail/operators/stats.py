"""Statistics of sessions and of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktrail.functions.text import filled
from sparktrail.functions.vocabulary import WRITES_STATS


def _measures() -> list[Column]:
    write, read = F.col("action").isin(*WRITES_STATS), F.col("action") == "read_file"
    open_ = ~F.coalesce(F.col("completed"), F.lit(False)) & ~F.coalesce(F.col("blocked"), F.lit(False))
    return [
        F.count("*").alias("actions"),
        F.count_distinct("sid", "call_idx").alias("calls"),
        F.count_distinct(F.when(read, F.col("path"))).alias("files_read"),
        F.count_distinct(F.when(write, F.col("path"))).alias("files_written"),
        F.sum(F.size("subcommands")).alias("subcommands"),
        F.count_if(open_).alias("orphans"),
        F.count_if("blocked").alias("blocked"),
    ]


def session_stats(actions: DataFrame) -> DataFrame:
    """Counts of calls, files, sub-commands and unfinished actions of each session."""
    return actions.groupBy("sid").agg(*_measures())


def corpus_stats(actions: DataFrame) -> DataFrame:
    """The same of each session and, in the row with a null session, of all of them."""
    return actions.rollup("sid").agg(*_measures())


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """(column, n), most frequent first."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column)


def calls_per_turn(actions: DataFrame) -> DataFrame:
    """(sid, turn, calls, tools): distinct calls, and their tools in order, once for each call."""
    once = actions.groupBy("sid", "turn", "call_idx").agg(F.min_by("tool", "idx").alias("tool"))
    tools = F.transform(F.array_sort(F.collect_list(F.struct("call_idx", "tool"))), lambda s: s["tool"])
    return once.groupBy("sid", "turn").agg(F.count("*").alias("calls"), tools.alias("tools"))


def session_rollup(turns: DataFrame) -> DataFrame:
    """(sid, turn, start_ts, end_ts, …): turns with a start where there was none: the end of the turn before.

    A missing start is the last known start plus the durations since, which a sum over the turns since then gives.
    """
    order = Window.partitionBy("sid").orderBy("turn")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    known = turns.withColumn("_group", F.count("start_ts").over(upto))
    within = Window.partitionBy("sid", "_group").orderBy("turn")
    first = F.first("start_ts").over(within)
    spent = F.coalesce(F.sum(F.coalesce("dur_s", F.lit(0.0))).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    start = F.timestamp_micros((F.unix_micros(first) + spent * 1_000_000).cast("long"))
    out = known.withColumn("start_ts", start)
    return out.withColumn("end_ts", F.timestamp_micros((F.unix_micros("start_ts") + F.coalesce("dur_s", F.lit(0.0)) * 1_000_000).cast("long"))).drop("_group")


def tool_counts(pre_events: DataFrame) -> DataFrame:
    """(tool, n) of raw tool calls."""
    return histogram(pre_events.filter(filled("tool").isNotNull()), "tool")
