"""Rows behind the text and picture views: timelines, tables, replay scripts, charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktrail.functions.text import blank, filled, first_filled


# Symbols of actions on a timeline.
SYMBOLS = {"run_command": "$", "read_file": "r", "list_dir": "l", "create_file": "w", "modify_file": "w", "search_files": "g", "search_content": "g", "summarize": "S", "spawn_subagent": ">"}


def timeline(actions: DataFrame, symbols: dict[str, str] = SYMBOLS, width: int = 70) -> DataFrame:
    """(sid, cell, symbol): actions on a line of ``width`` cells by time, by idx where there are not two times.

    The later of two actions in one cell shows; one that was not completed shows as x.
    """
    whole = Window.partitionBy("sid")
    at = F.unix_micros("ts")
    lo, hi, first, last = F.min(at).over(whole), F.max(at).over(whole), F.min("idx").over(whole), F.max("idx").over(whole)
    by_time = hi > lo
    place = F.when(by_time, F.try_divide(at - lo, hi - lo)).otherwise(F.coalesce(F.try_divide(F.col("idx") - first, last - first), F.lit(0.0)))
    cell = F.floor(place * (width - 1)).cast("int")
    symbol = F.when(~F.coalesce(F.col("completed"), F.lit(False)), "x").otherwise(F.coalesce(F.create_map(*[x for k, v in symbols.items() for x in (F.lit(k), F.lit(v))])[F.col("action")], F.lit("?")))
    placed = actions.select("sid", "idx", cell.alias("cell"), symbol.alias("symbol"))
    return placed.groupBy("sid", "cell").agg(F.max_by("symbol", "idx").alias("symbol"))


def _capped(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("…"))).otherwise(text)


def judge_line(cap: int = 200) -> Column:
    """An action for a judge: ``[idx] action(tool) target``, what went wrong, then its purpose and thought."""
    target = _capped(blank(first_filled("command", "path", "pattern", "root")), cap)
    state = (
        F.when(F.coalesce(F.col("blocked"), F.lit(False)), " [BLOCKED]")
        .when(filled("error").isNotNull(), F.concat(F.lit(" [ERROR:"), _capped(F.col("error"), 40), F.lit("]")))
        .when(~F.coalesce(F.col("completed"), F.lit(True)), " [incomplete]")
        .otherwise("")
    )
    head = F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("] "), F.col("action"), F.lit("("), F.col("tool"), F.lit(") "), target, state)
    purpose = F.concat(F.lit("    ↳ purpose: "), _capped(filled("purpose"), 300))
    thought = F.concat(F.lit("    ↳ think: "), filled("reasoning"))
    return F.concat_ws("\n", head, purpose, thought)


def judge_view(actions: DataFrame) -> DataFrame:
    """(sid, text): the lines of a session in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("idx", judge_line().alias("line")))), lambda s: s["line"])
    return actions.groupBy("sid").agg(F.array_join(lines, "\n").alias("text"))


def replay(actions: DataFrame) -> DataFrame:
    """(sid, idx, line): a script to read of what a session did; what a shell can't repeat becomes a comment."""
    mark = F.when(F.coalesce(F.col("completed"), F.lit(False)), "").otherwise("   # ✗ incomplete/failed")
    named = lambda c: F.coalesce(filled(c), F.lit("?"))
    text = (
        F.when(F.col("action") == "run_command", F.rtrim(blank("command")))
        .when(F.col("action") == "read_file", F.concat(F.lit("cat "), named("path")))
        .when(F.col("action") == "list_dir", F.concat(F.lit("ls "), named("path")))
        .when(F.col("action").isin("create_file", "modify_file"), F.concat(F.lit("# [side effect: "), F.col("action"), F.lit("] "), named("path")))
        .when(F.col("action").isin("search_files", "search_content"), F.concat(F.lit("# [search] "), blank("pattern"), F.lit(" @ "), blank("root")))
        .when(F.col("action") == "spawn_subagent", F.concat(F.lit("# >>> dispatch sub-agent: "), named("pattern"), F.lit(" (stage="), blank("command"), F.lit(")")))
        .when(F.col("action") == "summarize", F.concat(F.lit("# [report] "), F.left(blank("pattern"), F.lit(70))))
        .otherwise(F.concat(F.lit("# ["), F.col("action"), F.lit("]")))
    )
    return actions.select("sid", "idx", F.concat(text, mark).alias("line"))


def turn_spans(actions: DataFrame) -> DataFrame:
    """(sid, turn, started, ended, actions): the bars of a chart by turn."""
    return actions.groupBy("sid", "turn").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("actions"))


def gantt(actions: DataFrame) -> DataFrame:
    """(sid, chart): a Mermaid chart of the turns of each session."""
    form = "yyyy-MM-dd'T'HH:mm:ss"
    bar = F.format_string("turn %d :%s, %s", F.col("turn"), F.date_format("started", form), F.date_format("ended", form))
    bars = F.transform(F.array_sort(F.collect_list(F.struct("turn", bar.alias("bar")))), lambda s: s["bar"])
    head = "gantt\ndateFormat YYYY-MM-DDTHH:mm:ss\n"
    return turn_spans(actions).groupBy("sid").agg(F.concat(F.lit(head), F.array_join(bars, "\n")).alias("chart"))


def flow(all_edges: DataFrame) -> DataFrame:
    """(sid, graph): a Mermaid graph of what actions wrote and read."""
    node = F.concat(F.lit("e"), F.substring(F.sha1(F.concat_ws("@", "key", "version")), 1, 8))
    act = F.concat(F.lit("a"), F.col("idx").cast("string"))
    line = F.when(F.col("kind") == "generatedBy", F.concat(act, F.lit(" --> "), node)).otherwise(F.concat(node, F.lit(" --> "), act))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("idx", "key", "version", line.alias("line")))), lambda s: s["line"])
    return all_edges.groupBy("sid").agg(F.concat(F.lit("graph LR\n"), F.array_join(lines, "\n")).alias("graph"))


def by_prefix(sessions: DataFrame, prefix: str) -> DataFrame:
    """The session whose id begins so; none if several do."""
    found = sessions.filter(F.startswith(F.col("sid").cast("string"), F.lit(prefix)))
    one = found.agg(F.count("*").alias("n"), F.any_value(F.struct(*sessions.columns)).alias("s")).filter("n = 1")
    return one.select("s.*")


def latest(sessions: DataFrame, n: int = 200) -> DataFrame:
    """The ``n`` sessions changed last."""
    return sessions.orderBy(F.col("modified_at").desc(), "sid").limit(n)


def flag_contexts(flags: DataFrame, actions: DataFrame, before: int = 2, after: int = 2) -> DataFrame:
    """(flag_id, tag, sid, centre, idx, action): the actions around each flagged one.

    A flag names its action by ``ref`` or, where that is not found, by ``idx``.
    """
    order = Window.partitionBy("sid").orderBy("idx")
    spread = actions.withColumn("_near", F.collect_list(F.struct(F.col("idx").alias("near"), F.col("action").alias("what"))).over(order.rowsBetween(-before, after))).select("sid", "idx", "ref", "_near")
    by_ref = flags.join(spread.select(F.col("ref").alias("_ref"), F.col("sid").alias("_sid"), F.col("idx").alias("_idx"), "_near"), F.col("ref") == F.col("_ref"))
    rest = flags.join(by_ref.select("flag_id"), "flag_id", "left_anti")
    by_idx = rest.join(spread.select(F.col("sid").alias("_sid"), F.col("idx").alias("_idx"), "_near"), (F.col("sid") == F.col("_sid")) & (F.col("idx") == F.col("_idx")))
    cols = ["flag_id", "tag", F.col("_sid").alias("sid"), F.col("_idx").alias("centre"), F.inline("_near").alias("idx", "action")]
    return by_ref.select(*cols).unionByName(by_idx.select(*cols))
